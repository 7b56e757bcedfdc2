"""Series in blocks and appended bars give what whole series give."""

from __future__ import annotations

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from barline.functions import series
from barline.functions.series import Blocks, laid_out
from barline.operators import indicators, long_series
from barline.operators.indicators import REGISTRY
from barline.operators.long_series import append_bars, history, in_blocks, over_blocks
from barline.operators.parabolic import Stop, parabolic_sar, stops
from barline.plans import bars, catalogue

FREE = [name for name in REGISTRY if name != "i10_parabolic_sar"]
GROUPS = [FREE[k::9] for k in range(9)]


def walk(spark, lengths, seed=1, date="timestamp"):
    """Random bars, with flat stretches and days without volume; dates are uneven."""
    rng = random.Random(seed)
    rows = []
    for symbol, n in lengths.items():
        price, at = 100.0, 0
        for i in range(n):
            at += 1 if i % 500 < 400 else rng.randint(1, 300)
            price = max(5.0, price + (rng.random() - 0.5 if i % 50 > 3 else 0.0))
            high, low = price + rng.random() * (i % 37 > 0), price - rng.random() * (i % 37 > 0)
            when = datetime.datetime(2000, 1, 1) + datetime.timedelta(hours=at) if date == "timestamp" else at
            rows.append((symbol, when, price, high, low, low + (high - low) * rng.random(), rng.randrange(1000) * (i % 41 > 0)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, f"symbol string, date {date}, open double, high double, low double, close double, volume long").repartition(4)


@pytest.fixture(scope="module")
def long_bars(spark):
    return walk(spark, {"A": 2500, "B": 700, "C": 90, "D": 3, None: 400}).cache()


def close_to(got, want, columns):
    got = {(r["symbol"], r["date"]): r for r in got}
    assert len(got) == len(want)
    for r in want:
        g = got[r["symbol"], r["date"]]
        for c in columns:
            assert (g[c] is None) == (r[c] is None), (c, r, g)
            assert r[c] is None or g[c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (c, r, g)


def together(names):
    """These indicators as one, their columns told apart by name."""

    def run(df, window: int = 130):
        for name in names:
            function, columns = REGISTRY[name]
            df = function(df).withColumnsRenamed({c: f"{name}_{c}" for c in columns})
        return df

    return run, [f"{name}_{c}" for name in names for c in REGISTRY[name][1]]


@pytest.mark.parametrize("names", GROUPS)
def test_blocks_give_the_rows_of_whole_series(long_bars, names):
    function, columns = together(names)
    want = function(long_bars)
    got = over_blocks(function, long_bars, rows=300)
    assert got.columns == want.columns
    close_to(got.select("symbol", "date", *columns).collect(), want.select("symbol", "date", *columns).collect(), columns)


def appended(spark, names, bars, shares, folder):
    function, columns = together(names)
    dates = sorted(r["date"] for r in bars.select("date").distinct().collect())
    cuts = [dates[int(len(dates) * p)] for p in shares]
    got, state = [], None
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = bars.where((F.lit(a).isNull() | (F.col("date") >= F.lit(a))) & (F.lit(b).isNull() | (F.col("date") < F.lit(b))))
        rows, after = append_bars(function, part, state)
        got += rows.select("symbol", "date", *columns).collect()
        after.write.parquet(f"{folder}/state{k}")
        state = spark.read.parquet(f"{folder}/state{k}")
    close_to(got, function(bars).select("symbol", "date", *columns).collect(), columns)
    assert {r["symbol"]: r["n"] for r in state.collect()} == {"A": 330, "B": 150, "C": 20}


SCANS = [("i02_ema", "i12_obv", "i22_trix"), ("i08_supertrend", "i32_kvo", "i30_nvi"), ("i33_chaikin_oscillator", "i03_macd", "i18_cci")]


@pytest.mark.parametrize("names", SCANS)
def test_appended_bars_give_the_rows_of_one_run(spark, names, tmp_path):
    appended(spark, names, walk(spark, {"A": 330, "B": 150, "C": 20}, seed=4).cache(), (0.1, 0.6), tmp_path)


def test_ten_parts(spark, tmp_path):
    """A short first part, and parts in which symbols have nothing."""
    names = ("i02_ema",)
    appended(spark, names, walk(spark, {"A": 330, "B": 150, "C": 20}, seed=5).cache(), (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.6, 0.8, 0.9), tmp_path)


def test_old_bars_raise(spark):
    bars = walk(spark, {"A": 100}, date="long")
    _, state = append_bars(indicators.sma, bars)
    with pytest.raises(Exception, match="not later"):
        append_bars(indicators.sma, bars.limit(1), state)[0].collect()


def test_blocks_are_bounded(long_bars):
    laid = in_blocks(long_bars, 200, 60)
    sizes = laid.groupBy("symbol", "bar_block").agg(F.count("*").alias("n"), F.count_if("bar_halo").alias("halo"), F.min("bar_row").alias("first"), F.max("bar_row").alias("last")).collect()
    by_symbol = {s: [r for r in sizes if r["symbol"] == s] for s in ("A", "B", "C", "D", None)}
    assert len(by_symbol["A"]) > 8 and len(by_symbol["C"]) == len(by_symbol["D"]) == 1 and len(by_symbol[None]) == 2
    for r in sizes:
        assert r["n"] <= 200 + 60 + 3 * 25 + 200 and r["last"] - r["first"] + 1 == r["n"]
        assert (r["halo"] >= 60) == (r["bar_block"] > 0) and (r["bar_block"] or r["first"] == 0)
    own = laid.where("not bar_halo").groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("bar_row").alias("places")).collect()
    assert {r["symbol"]: (r["n"], r["places"]) for r in own} == {"A": (2500,) * 2, "B": (700,) * 2, "C": (90,) * 2, "D": (3, 3), None: (400,) * 2}


def test_tasks_hold_blocks(long_bars):
    """Bars are shuffled by symbol and block, none to a single task."""
    made = over_blocks(indicators.ema, long_bars, rows=300)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"Exchange hashpartitioning\(symbol#\d+, bar_block#\d+, ", plan)
    assert "SinglePartition" not in plan


def test_one_date_and_short_series(spark):
    same = spark.createDataFrame([("A", 5, 1.0)] * 300, "symbol string, date long, close double")
    assert over_blocks(indicators.sma, same, rows=60, period=3).count() == 300
    assert over_blocks(indicators.sma, same.limit(10), rows=60).count() == 10
    assert over_blocks(indicators.sma, same.where("false"), rows=60).count() == 0
    with pytest.raises(ValueError):
        in_blocks(same, 5, 10)


def test_history():
    assert history(indicators.sma) == 54 and history(indicators.kst) == 122 and history(indicators.sma, period=500) == 502


def test_stops_are_carried_from_batch_to_batch(spark, long_bars):
    want: dict = {}
    for r in long_bars.orderBy("date").collect():
        want.setdefault(r["symbol"], []).append(r)
    want = {(s, r["date"]): v for s, rows in want.items() for r, v in zip(rows, stops([r["high"] for r in rows], [r["low"] for r in rows], 0.02, 0.2), strict=True)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = parabolic_sar(long_bars).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["symbol"], r["date"]): r["psar"] for r in got} == want
    assert parabolic_sar(long_bars.where("false")).count() == 0


def test_the_state_machine_holds_a_few_numbers():
    state = Stop(0.02, 0.2)
    for k in range(100_000):
        state.next(100.0 + k % 17, 99.0 + k % 13 / 20)
    assert len(state.recent) == 2


@pytest.mark.parametrize(("name", "falls"), [("nvi", True), ("pvi", False)])
def test_products_beyond_the_range_of_doubles(spark, tmp_path, name, falls):
    """Every second price falls to a thousandth, with (nvi) or against (pvi) its volume: the product of 300 falls is no double."""
    prices = [0.0 if k % 2 else 1e9 for k in range(600)]
    volumes = [1.0 if (k % 2 == 1) == falls else 2.0 for k in range(600)]
    lines = [(k, 1, v, p, 0.0, 0.0, "A") for k, (v, p) in enumerate(zip(volumes, prices, strict=True))]
    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    query = catalogue.queries()[f"long_i30_{name}" if falls else f"long_i31_{name}"]
    got = [r[f"{name}_ln"] for r in query(spark, str(tmp_path)).orderBy("date").collect()]
    step = math.log(1000.0 / 1_001_000.0)
    assert got == pytest.approx([math.log(1000) + (k + 1) // 2 * step for k in range(600)], abs=1e-3)


def test_logarithms_of_products(spark, long_bars):
    """In blocks as well; null from the first price of zero on."""
    whole = indicators.nvi(long_bars).select("symbol", "date", F.log("nvi").alias("nvi_ln")).collect()
    close_to(over_blocks(indicators.nvi, long_bars, rows=300, ln=True).collect(), whole, ["nvi_ln"])
    few = spark.createDataFrame([("A", k, c, 9 - k) for k, c in enumerate([2.0, 1.0, 0.0, 5.0, 6.0])], "symbol string, date long, close double, volume long")
    got = [r["nvi_ln"] for r in indicators.nvi(few, ln=True).orderBy("date").collect()]
    assert got[:2] == pytest.approx([math.log(1000), math.log(500)]) and got[2:] == [None] * 3


def test_carries_look_at_the_last_blocks_only(long_bars):
    """What a carry gathers doesn't grow with the blocks of a series, and the tables of carries are broadcast."""
    plan = over_blocks(indicators.macd, long_bars, rows=300)._jdf.queryExecution()
    frames = re.findall(r"collect_list\(.*?specifiedwindowframe\(RowFrame, ([^,]+),", plan.optimizedPlan().toString())
    assert frames and all(re.fullmatch(r"-\d+", f) for f in frames)
    assert "SortMergeJoin" not in plan.sparkPlan().toString()


def test_halos_stay_small(long_bars, monkeypatch):
    """Blocks grow where a series has no more cells, so that a halo of a whole cell is a small part of its block."""
    monkeypatch.setattr(long_series, "_MOST_CELLS", 16)
    laid = in_blocks(long_bars, 100, 60)
    assert laid.where("symbol = 'A' and bar_halo").count() < 2500 / 4
    assert "aggregate(" not in laid._jdf.queryExecution().optimizedPlan().toString()  # rows aren't copied with their cuts


def test_blocks_of_longest_series_stay_a_share_of_a_task(spark, monkeypatch):
    """Series with more cells than quantiles are cut between these as well, and blocks don't grow with the series; where
    dates are uneven too."""
    monkeypatch.setattr(long_series, "_QUANTILES", 16)
    monkeypatch.setattr(long_series, "_TASK_ROWS", 1600)
    bars = walk(spark, {"A": 9000, "B": 700, None: 400}, seed=10, date="long").cache()
    laid = in_blocks(bars, 100, 60)
    sizes = laid.where("symbol = 'A'").groupBy("bar_block").agg(F.count("*").alias("n"), F.count_if("bar_halo").alias("halo")).collect()
    assert len(sizes) > 20 and max(r["n"] for r in sizes) < 9000 / 8
    assert all(r["halo"] >= 60 for r in sizes if r["bar_block"] > 0)
    close_to(over_blocks(indicators.macd, bars, rows=130).collect(), indicators.macd(bars).collect(), ["macd", "signal", "histogram"])
    assert long_series._spaced([3, 5, 905], 4) == [3, 4, 5, 230, 455, 680, 905]


def test_tasks_hold_a_share_of_rows(long_bars, monkeypatch):
    monkeypatch.setattr(long_series, "_TASK_ROWS", 100)
    made = over_blocks(indicators.sma, long_bars, rows=300)
    sizes = made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) > 4
    close_to(made.collect(), indicators.sma(long_bars).collect(), ["sma"])


WARM = ("i03_macd", "i17_keltner", "i22_trix", "i32_kvo", "i33_chaikin_oscillator")


@pytest.mark.parametrize("name", WARM)
def test_long_halos_give_the_rows_of_whole_series(spark, monkeypatch, name):
    """Series much longer than exponential means reach back: no carries of these, and scans that begin in halos. Here a mean
    forgets after 20 digits, so that series of a few thousand bars are long enough."""
    monkeypatch.setattr(series, "forgotten", lambda decay: math.ceil(20 / -math.log10(decay)))
    monkeypatch.setattr(long_series, "_WARM", 2)
    function, columns = REGISTRY[name]
    bars = walk(spark, {"A": 9000, "B": 7000, "C": 90, None: 400}, seed=7, date="long").cache()
    made = over_blocks(function, bars, rows=300)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    close_to(made.select("symbol", "date", *columns).collect(), function(bars).select("symbol", "date", *columns).collect(), columns)


def test_running_values_of_halos(spark, monkeypatch):
    """Running sums and held values are right on the rows of halos too, where means begin."""
    monkeypatch.setattr(series, "forgotten", lambda decay: 100)
    monkeypatch.setattr(long_series, "_WARM", 2)

    def scans(df, window: int = 60):
        df = series.running_sum(df, "volume", "sum")
        df = series.last_known(df.withColumn("now_and_then", F.when(F.col("date") % 97 == 0, F.col("close"))), "now_and_then", "held")
        return series.exponential(df, "close", "ema", 2, 1)

    bars = walk(spark, {"A": 3000, "B": 50}, seed=8, date="long").cache()
    laid = in_blocks(bars, 300, 60, reach=100)
    with laid_out(Blocks(300, True)):
        rows = scans(laid).collect()
    want = {(r["symbol"], r["date"]): r for r in scans(bars).collect()}
    assert sum(r["bar_halo"] for r in rows) > 500 and len(rows) - sum(r["bar_halo"] for r in rows) == 3050
    for r in rows:
        w = want[r["symbol"], r["date"]]
        assert (r["sum"], r["held"]) == (w["sum"], w["held"])
        assert r["bar_halo"] or (r["ema"] is None) == (w["ema"] is None)
        assert r["bar_halo"] or w["ema"] is None or r["ema"] == pytest.approx(w["ema"], rel=1e-12)


def lines_of(spark, folder, copies):
    """Lines of which each is there several times with another price: bars of several lines."""
    rng = random.Random(9)
    lines = [(k, 1, float(rng.randrange(1, 50)), rng.random() * 1e5, 0.05, 0.02, "AN"[k % 2]) for k in range(6000) for _ in range(copies)]
    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, kinds).repartition(3).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("name", ["sma", "vwap", "macd"])
def test_bars_made_of_lines_in_blocks(spark, tmp_path, name):
    """The tape's bars are made in their blocks, several lines each, and are those of whole series."""
    lines_of(spark, tmp_path, 3)
    function = getattr(indicators, name)
    column = "signal" if name == "macd" else name
    got = over_blocks(function, bars.tape_lines(spark, str(tmp_path)), rows=300, built=bars.tape_bars)
    want = function(bars.tape(spark, str(tmp_path)))
    assert sorted(got.columns) == sorted(want.columns)
    close_to(got.collect(), want.collect(), [column])


def test_files_are_read_in_shares(spark, tmp_path, monkeypatch):
    """A task reads some rows of a file of many, so that what it holds for a shuffle doesn't grow with the file."""
    monkeypatch.setattr(long_series, "_TASK_ROWS", 100)
    rows = spark.range(0, 20_000, 1, 1).selectExpr("'A' AS symbol", "id AS date", "rand(1) AS close")
    rows.write.option("parquet.block.size", "8192").option("parquet.page.size", "1024").parquet(f"{tmp_path}/rows")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        made = over_blocks(indicators.sma, spark.read.parquet(f"{tmp_path}/rows"), rows=300)
        assert made.count() == 20_000
        read = spark.read.parquet(f"{tmp_path}/rows").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert read < 20_000 / 8
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_are_shuffled_once(spark, tmp_path):
    """Into blocks of few rows a task: bars, windows and exponential means need no other shuffle or pass."""
    lines_of(spark, tmp_path, 2)
    for name in ("long_i01_sma", "long_i05_bollinger", "long_i18_cci", "long_i23_aroon"):
        plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Scan parquet") == 1
    made = over_blocks(indicators.sma, bars.tape_lines(spark, str(tmp_path)), rows=300, built=bars.tape_bars)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("name", ["i02_ema", "i17_keltner", "i22_trix", "i34_elder_ray"])
def test_tasks_of_exponential_means_do_not_grow_with_series(spark, monkeypatch, name):
    """A series four times as long, in long halos, is dealt to more tasks, not to larger ones."""
    monkeypatch.setattr(series, "forgotten", lambda decay: math.ceil(5 / -math.log10(decay)), raising=False)
    monkeypatch.setattr(long_series, "_WARM", 2, raising=False)
    monkeypatch.setattr(long_series, "_TASK_ROWS", 1600, raising=False)

    def largest(n):
        rows = spark.range(n).selectExpr("'A' AS symbol", "id AS date", "100 + id % 7 AS close", "101 + id % 7 AS high", "99 + id % 7 AS low", "1 AS volume")
        made = over_blocks(REGISTRY[name][0], rows, rows=130)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n
        return max(sizes)

    assert largest(8000) < 4000 and largest(32_000) < 4000
