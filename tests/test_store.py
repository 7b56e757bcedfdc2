"""Stored tables: buckets, repeated and killed appends, merges, key filters; and the syncs over them."""

from __future__ import annotations

import datetime
import json
import os
import re
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barline.operators import indicators, lookup, reconcile
from barline.sources import payloads, store

HERE = str(Path(__file__).resolve().parent.parent)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def kept(spark, path):
    return sorted(r["k"] for r in store.appended(spark, path).collect())


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.append_batch(numbers(spark, 1, 2), path, 0) == {"rows": 2}
    assert store.append_batch(numbers(spark, 3), path, 1, F.max("k").alias("most")) == {"rows": 1, "most": 3}
    store.append_batch(numbers(spark, 4, 5), path, 1)
    assert kept(spark, path) == [1, 2, 4, 5] and store.appended(spark, path, without=1).count() == 2
    store.append_batch(numbers(spark, 4).where("false"), path, 1)
    assert kept(spark, path) == [1, 2]


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append_batch(numbers(spark, 1), path, 0)
    with pytest.raises(Exception, match="twice"):
        store.append_batch(reconcile.staged_rows(store.appended(spark, path), numbers(spark, 2, 3, 3).withColumn("b", F.lit(0)), ["k"], F.lit(True), "b"), path, 1)
    with pytest.raises(Exception, match="null"):
        store.append_batch(reconcile.staged_rows(store.appended(spark, path), numbers(spark, 2, None).withColumn("b", F.lit(0)), ["k"], F.lit(True), "b"), path, 1)
    assert kept(spark, path) == [1]


KILLED = """
import sys, time
from pyspark.sql import SparkSession
from barline.sources.store import append_batch
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[2]).getOrCreate()
def slow(batches):
    for b in batches:
        yield b
        if 7 in b.column(0).to_pylist():
            time.sleep(600)
append_batch(spark.range(8, numPartitions=4).withColumnRenamed("id", "k").mapInArrow(slow, "k long"), sys.argv[1], 1)
"""


def test_a_killed_writer_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append_batch(numbers(spark, 100), path, 0)
    writer = subprocess.Popen([sys.executable, "-c", KILLED, path, str(tmp_path / "local")], env=os.environ | {"PYTHONPATH": HERE}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        until = time.time() + 90
        while time.time() < until and len(list(Path(path).rglob("*.parquet"))) < 4:  # the stored one and three of this batch
            time.sleep(0.2)
        assert writer.poll() is None and len(list(Path(path).rglob("*.parquet"))) >= 4
    finally:
        os.killpg(writer.pid, 9)  # the group of the process that this test started
        writer.wait()
    assert kept(spark, path) == [100]
    store.append_batch(numbers(spark, *range(8)), path, 1)
    assert kept(spark, path) == [*range(8), 100]


def bars(spark, symbols=20, days=40):
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"S{s}", day + datetime.timedelta(days=d), 1.0 * d, d + 2.0, d - 1.0, d + s % 3 / 2, d * s) for s in range(symbols) for d in range(days)]
    return spark.createDataFrame(rows, "symbol string, date timestamp, open double, high double, low double, close double, volume long")


def test_bucketed_bars_need_no_shuffle(spark):
    store.store_bars(bars(spark), "bars_in_buckets", 6)
    try:
        panel = indicators.rsi(indicators.macd(indicators.kvo(store.stored_bars(spark, "bars_in_buckets"))))
        plan = panel._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan
        want = indicators.rsi(bars(spark)).select("symbol", "date", "rsi")
        assert panel.select("symbol", "date", "rsi").exceptAll(want).count() == 0 and panel.count() == 800
        one = store.stored_bars(spark, "bars_in_buckets", "S7")
        assert "SelectedBucketsCount: 1 out of 6" in one._jdf.queryExecution().executedPlan().toString()
        assert [(r["place"], r["date"].day) for r in one.collect()[:3]] == [(1, 1), (2, 2), (3, 3)] and one.count() == 40
    finally:
        spark.sql("DROP TABLE bars_in_buckets")


def test_merges_leave_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    companies = spark.createDataFrame([(f"{k:04}", f"old {k}", "tools") for k in range(200)], "cik string, name string, sector string")
    feed = spark.createDataFrame([("0007", "new 7"), ("9999", "fresh")], "cik string, name string")
    store.store_keyed(companies, path, "cik", 16)
    before = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    touched = store.merge_stored(spark, path, "cik", 16, feed, reconcile.merge_companies)
    after = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert 1 <= len(touched) <= 2
    for f, when in before.items():
        assert (f"bucket={touched[0]}/" in str(f) or f"bucket={touched[-1]}/" in str(f)) != (after.get(f) == when)
    want = sorted(map(tuple, reconcile.merge_companies(companies, feed).collect()))
    assert sorted(map(tuple, store.keyed(spark, path).select("cik", "name", "sector").collect())) == want
    assert store.merge_stored(spark, path, "cik", 16, feed, reconcile.merge_companies) == touched  # again changes nothing
    assert sorted(map(tuple, store.keyed(spark, path).select("cik", "name", "sector").collect())) == want
    assert store.merge_stored(spark, path, "cik", 16, feed.where("false"), reconcile.merge_companies) == []


def test_key_filter(spark, tmp_path):
    stored = spark.range(20_000).select((F.col("id") % 50).alias("part"), (F.col("id") * 2).alias("k"))
    stored.write.partitionBy("part").parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    known = store.key_filter(stored, ["k"], 200_000)
    incoming = spark.range(2_000).select((F.col("id") % 50).alias("part"), (F.col("id") * 37).alias("k"), F.lit("x").alias("extra")).unionByName(spark.createDataFrame([(0, None, "x")], "part long, k long, extra string"))
    judged = {r["k"]: r["surely_new"] for r in store.surely_new(incoming, ["k"], known, 200_000).collect()}
    old = {2 * k for k in range(20_000)}
    assert len(judged) == 2001 and not any(v for k, v in judged.items() if k in old)
    unknown = [v for k, v in judged.items() if k not in old]
    assert sum(unknown) > 0.95 * len(unknown)
    # the part is that of the stored key, where it is stored
    incoming = incoming.withColumn("part", F.coalesce(F.col("k") / 2 % 50, F.lit(0)).cast("int"))
    got = store.new_rows_of(incoming, stored, ["k"], "part", known, 200_000)
    want = lookup.new_rows(incoming, stored, ["k"])
    assert sorted(map(str, got.select("k", "part").collect())) == sorted(map(str, want.select("k", "part").collect()))
    few = incoming.where("part = 3")
    plan = store.new_rows_of(few, stored, ["k"], "part", known, 200_000)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(part#\d+ = 3\)", plan)
    assert store.new_rows_of(incoming.where("false"), stored, ["k"], "part", known, 200_000).count() == 0


def test_price_sync(spark):
    securities = spark.createDataFrame([(1, "A"), (2, "B")], "id long, symbol string")
    day = datetime.datetime(2024, 1, 1)
    price = lambda symbol, d, low=1.0: (symbol, day + datetime.timedelta(days=d), "2", 3.0, low, 2.0, 10)
    kind = "symbol string, date timestamp, open string, high double, low double, close double, volume int"
    stored = spark.createDataFrame([(1, day, 2.0)], "security_id long, date timestamp, close double")
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    table, staged, count = reconcile.sync_prices(stored, rows(price(" a", 0), price("A", 1), price("b", 0, low=-1.0), price("b", 1)), securities)
    assert count == 1 and table.count() == 2
    assert [tuple(r) for r in staged.select("security_id", "open", "dividends").collect()] == [(1, 2.0, 0.0)]
    for bad, error in ((price("Z", 0), "not found"), (price(" ", 0), "blank"), (("A", None, "2", 3.0, 1.0, 2.0, 1), "conform"), (("A", day, "x", 3.0, 1.0, 2.0, 1), "conform")):
        with pytest.raises(Exception, match=error):
            reconcile.sync_prices(stored, rows(bad), securities)
    with pytest.raises(ValueError, match="twice"):
        reconcile.sync_prices(stored, rows(price("A", 2), price("A", 2)), securities)


def test_the_first_of_duplicates_stays(spark):
    companies = spark.createDataFrame([(1,)], "id long")
    securities = spark.createDataFrame([("A", 1)], "symbol string, company_id long")
    kind = "symbol string, title string, publisher string, summary string, url string, published_at timestamp"
    stored = spark.createDataFrame([], "company_id long, title string, publisher string, summary string, url string, published_at timestamp")
    rows = [("A", t, "p", "s", u, None) for t, u in (("later", "u"), ("first", "u"), ("other", "v"))]
    for order in ([0, 1, 2], [2, 1, 0]):
        news = spark.createDataFrame([(*rows[k], {"first": 0}.get(rows[k][1], 5)) for k in order], kind + ", pos long").repartition(3)
        table, staged, count = reconcile.sync_news(stored, news, securities, companies)
        assert count == 2 and sorted(r["title"] for r in staged.collect()) == ["first", "other"] and "pos" not in table.columns
        plain = reconcile.sync_news(stored, news.drop("pos"), securities, companies)[1]
        assert sorted(r["title"] for r in plain.collect()) == ["first", "other"]


def test_null_keys_abort(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    assert reconcile.null_keys(df, ["k"]).count() == 1
    with pytest.raises(Exception, match="a key is null"):
        reconcile.require_keys(df, ["k", "v"]).collect()
    assert reconcile.require_keys(df.where("k = 1"), ["k", "v"]).count() == 1


def test_listings_are_written_back(spark):
    companies = spark.createDataFrame([(1, "X", "Y", "one"), (2, "old", "OTC", "two")], "id long, symbol string, exchange string, name string")
    securities = spark.createDataFrame([(8, 1, "B", "NYSE"), (5, 1, "A", None)], "id long, company_id long, symbol string, exchange string")
    got = sorted(map(tuple, reconcile.write_representatives(companies, securities).collect()))
    assert got == [(1, "A", None, "one"), (2, "old", "OTC", "two")]


def test_work_folder_is_shared_off_one_machine(spark, monkeypatch):
    assert "barline-" in store.work_folder(spark)

    class Far:
        sparkContext = type("Context", (), {"master": "spark://far:7077", "getConf": lambda self: {}})()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        store.work_folder(Far())


def test_wanted_facts_are_those_of_the_whole_document(spark):
    fact = {"end": "2020-12-31", "val": 1.5, "form": "10-K", "fp": "FY", "filed": "2021-02-01"}
    document = {"facts": {"us-gaap": {"Other": {"units": {"USD": [fact]}}, "Revenues": {"units": {"ZAR": [fact], "USD": [fact, fact], "AUD": []}}}}}
    raw = spark.createDataFrame([("1", json.dumps(document)), ("2", "{}"), ("3", None)], "cik string, json string")
    whole = payloads.parse_facts(raw).where("tag = 'Revenues'")
    wanted = payloads.parse_facts(raw, ["Revenues", "Missing"])
    assert sorted(map(str, wanted.collect())) == sorted(map(str, whole.collect()))
    assert [r["unit"] for r in wanted.orderBy("unit_pos").select("unit", "unit_pos").distinct().orderBy("unit_pos").collect()] == ["ZAR", "USD", "AUD"]


def test_payloads_in_turn(spark):
    payload = lambda *names: json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [[7, n, "a", "NYSE"] for n in names]})
    raw = spark.createDataFrame([(payload("c"), 1), (payload("a", "b"), 0)], "json string, number int")
    rows = payloads.parse_universe(raw, "number")
    assert [r["name"] for r in rows.orderBy("pos").collect()] == ["a", "b", "c"]
    assert [r["name"] for r in reconcile.dedupe_universe(rows).collect()] == ["c"]
