from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from barline.operators import clean, lookup, reconcile, validate
from barline.sources import payloads


def test_cleaning(spark):
    df = spark.createDataFrame([("  aapl  ", "  Apple     Inc.   "), ("x", None), ("y", " a \u001cb\n")], "s string, t string")
    got = df.select(clean.clean_symbol(F.col("s")), clean.clean_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("AAPL", "Apple Inc."), ("X", ""), ("Y", "a b")]


def test_price_validity_and_whole_batches(spark):
    day = datetime.datetime(2024, 1, 1)
    row = lambda s, d=day, o=1.0, h=2.0, l=0.5, c=1.5, v=10: (s, d, o, h, l, c, v)
    rows = [row("A"), row("B"), row("B", h=0.1), row("C", d=None), row("D", c=float("nan")), row("E", v=-1), row("F", o=float("inf"))]
    df = clean.clean_price(spark.createDataFrame(rows, "symbol string, date timestamp, open double, high double, low double, close double, volume long"))
    assert [r[0] for r in df.select(validate.valid_price()).collect()] == [True, True, False, False, False, False, False]
    assert {r["symbol"] for r in validate.reject_invalid_batches(df, "symbol", validate.valid_price()).collect()} == {"A"}


def test_exchanges(spark):
    df = spark.createDataFrame([("NASDAQ",), ("NYSE MKT",), ("OTC",), ("nasdaq",), (None,)], "e string")
    assert [r[0] for r in df.select(validate.is_us_equity(F.col("e"))).collect()] == [True, True, False, True, False]


def test_universe_payload(spark):
    payload = {"fields": ["cik", "name", "ticker", "exchange"], "data": [[320193, "Apple Inc.", " aapl ", "Nasdaq"], [None, "x", "y", "z"], [1, "", "t", "NYSE"], [2, "short"], [3, "N", "n", None]]}
    got = payloads.parse_universe(spark.createDataFrame([(json.dumps(payload),)], "json string")).orderBy("pos").collect()
    assert [(r["cik"], r["symbol"], r["name"], r["exchange"]) for r in got] == [("0000320193", "AAPL", "Apple Inc.", "Nasdaq"), ("0000000003", "N", "N", "")]
    with pytest.raises(Exception, match="unexpected fields"):
        payloads.parse_universe(spark.createDataFrame([('{"fields": ["ticker", "cik"], "data": []}',)], "json string")).collect()


def test_news_payload(spark):
    item = {"content": {"title": "T", "summary": None, "pubDate": 1700000000000, "provider": {"displayName": "P"}, "canonicalUrl": "none"}}
    bad = {"content": {"title": "U", "pubDate": "soon"}}
    got = payloads.parse_news(spark.createDataFrame([("A", json.dumps([item, bad]))], "symbol string, json string")).orderBy("pos").collect()
    assert (got[0]["title"], got[0]["publisher"], got[0]["summary"], got[0]["url"]) == ("T", "P", "", "")
    assert got[0]["published_at"] is not None and got[1]["published_at"] is None


def test_facts_to_statements(spark):
    fact = lambda end, val, form="10-K", filed="2024-11-01": {"end": end, "val": val, "form": form, "fp": "FY", "filed": filed}
    facts = {
        "Revenues": {"units": {"EUR": [fact("2024-09-28", 1.0)], "USD": [fact("2024-09-28", 100.0), fact("2024-09-28", 110.0, "10-K/A", "2025-01-15"), fact("2023-09-30", 90.0), fact("2024-03-01", 5.0, "10-Q")]}},
        "Shares": {"units": {"shares": [fact("2024-09-28", 15408095000.0)]}},
    }
    raw = spark.createDataFrame([("1", json.dumps({"facts": {"us-gaap": facts}}))], "cik string, json string")
    chosen = reconcile.first_available(payloads.parse_facts(raw), {"total_revenue": ["Missing", "Revenues"], "shares_outstanding": ["Shares"]}, {"total_revenue": "USD", "shares_outstanding": "none"})
    got = reconcile.annual_statements(chosen).orderBy("fiscal_date").collect()
    assert [(str(r["fiscal_date"]), r["total_revenue"], r["shares_outstanding"]) for r in got] == [("2023-09-30", 90.0, None), ("2024-09-28", 110.0, 15408095000)]


def test_universe_sync(spark):
    companies = spark.createDataFrame([("1", "Old", "tech")], "cik string, name string, sector string")
    securities = spark.createDataFrame([("A", "1", "NYSE")], "symbol string, cik string, exchange string")
    feed = lambda *rows: spark.createDataFrame(list(rows), "cik string, symbol string, name string, exchange string, pos long")
    new, listed, count = reconcile.sync_universe(companies, securities, feed(("1", "a", "First", "NYSE", 0), ("1", " A", "New", "nasdaq", 1), ("2", "b", "B", "OTC", 2), ("3", "c", "C", "NYSE", 3)))
    assert {(r["cik"], r["name"], r["sector"]) for r in new.collect()} == {("1", "New", "tech"), ("3", "C", "")}
    assert {tuple(r) for r in listed.collect()} == {("A", "1", "NASDAQ"), ("C", "3", "NYSE")} and count == 2
    with pytest.raises(ValueError):
        reconcile.sync_universe(companies, securities, feed(("1", "a", "A", "NYSE", 0), ("2", "a", "A", "NYSE", 1)))
    with pytest.raises(Exception, match="another company"):
        reconcile.sync_universe(companies, securities, feed(("9", "a", "A", "NYSE", 0)))[1].collect()


def test_rows_sync_and_keys(spark):
    old = spark.createDataFrame([("u1", "t")], "url string, title string")
    new = spark.createDataFrame([("u1", "t"), ("u2", "t")], "url string, title string")
    table, staged, count = reconcile.sync_rows(old, new, ["url"], F.lit(True), "title")
    assert count == 1 and table.count() == 2 and staged.first()["url"] == "u2"
    with pytest.raises(ValueError):
        reconcile.sync_rows(old, new.union(new), ["url"], F.lit(True), "title")
    assert reconcile.sync_rows(old, new.union(new), ["url"], F.lit(True), "title", "first")[2] == 1
    with pytest.raises(LookupError):
        lookup.require_known(spark.createDataFrame([("zz",)], "url string"), old, ["url"])


def test_undated_news_come_first(spark):
    securities = spark.createDataFrame([("A", 1)], "symbol string, company_id long")
    day = datetime.datetime(2024, 1, 1)
    news = spark.createDataFrame([(1, "a", day), (1, "b", None), (1, "c", day + datetime.timedelta(1)), (2, "d", None)], "company_id long, url string, published_at timestamp")
    assert [r["url"] for r in lookup.company_news(securities, news, "A").collect()] == ["b", "c", "a"]
    assert lookup.news_at(news, news.where("url = 'b'")).count() == 1


def test_bar_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n")
    got = payloads.read_bars(spark, str(tmp_path / "a.csv")).first()
    assert (got["close"], got["volume"], got["dividends"]) == (1.5, 10, 0.0)
    (tmp_path / "b.csv").write_text("Date,Open\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="Close"):
        payloads.read_bars(spark, str(tmp_path / "b.csv"))


def test_bad_payloads_raise_or_are_null(spark):
    raw = lambda *rows: spark.createDataFrame(list(rows), "symbol string, json string")
    times = ['"NaN"', "1e300", "9e18", '"soon"', "null", "1700000000000"]
    got = payloads.parse_news(raw(("A", "[" + ",".join(f'{{"content": {{"pubDate": {t}}}}}' for t in times) + ', {}]'))).orderBy("pos").collect()
    assert [r["published_at"] is not None for r in got] == [False] * 5 + [True, False] and got[6]["title"] == ""
    for bad in ('{"content": {}}', "[1]", '[{"content": 3}]', "nonsense"):
        with pytest.raises(Exception, match="no list of objects|no object"):
            payloads.parse_news(raw(("A", bad))).collect()
    for bad in ('{"date": "2024-01-01"}', "[[]]", '[{"revenue": 1}]'):
        with pytest.raises(Exception, match="no list of objects|no date"):
            payloads.parse_statements(raw(("A", bad))).collect()
    assert payloads.parse_statements(raw(("A", '[{"date": "2024-01-01", "revenue": 1.5}]'))).first()["total_revenue"] == 1.5
    assert [r["market_cap"] for r in payloads.parse_profiles(raw(("A", '{"marketCap": 1.5e12}'), ("B", "{}"))).collect()] == [1500000000000, None]
    with pytest.raises(Exception, match="whole number"):
        payloads.parse_profiles(raw(("A", '{"marketCap": 1.5}'))).collect()
    tickers = payloads.parse_ticker_map(spark.createDataFrame([('{"x": {"ticker": "a", "cik_str": 1}, "y": {"ticker": "A", "cik_str": 2}, "z": {"ticker": "b", "cik_str": ""}}',)], "json string"))
    assert [tuple(r) for r in tickers.collect()] == [("A", "0000000002")]


def test_strict_lookups(spark):
    securities = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, company_id long")
    companies = spark.createDataFrame([(1, "one")], "id long, name string")
    with pytest.raises(Exception, match="no company 2"):
        lookup.with_company(securities, companies).collect()
    assert lookup.with_company(securities, companies, strict=False).count() == 1
    with pytest.raises(Exception, match="no cik for B"):
        lookup.ciks_of(securities, spark.createDataFrame([("A", "1")], "symbol string, cik string")).collect()
    with pytest.raises(Exception, match="company_id"):
        lookup.rekey(securities.select("symbol"), "symbol", "company_id", securities.where("symbol = 'A'")).collect()


def test_conforming_and_requirements(spark):
    df = spark.createDataFrame([("A", "n", "1"), ("B", None, "1"), ("C", "n", "x")], "symbol string, name string, market_cap string").withColumns({c: F.lit("t") for c in ("sector", "industry", "country", "website")})
    assert [r["conforms"] for r in clean.conform(df, clean.COMPANY, "mark").orderBy("symbol").collect()] == [True, False, False]
    with pytest.raises(Exception, match="conform"):
        clean.conform(df, clean.COMPANY).collect()
    with pytest.raises(ValueError, match="symbol"):
        clean.conform(df.drop("symbol"), clean.COMPANY)
    with pytest.raises(Exception, match="blank"):
        validate.require_symbol(df.withColumn("symbol", F.lit(" "))).collect()
    with pytest.raises(Exception, match="another symbol"):
        validate.require_same_symbol(df.withColumn("requested_symbol", F.lit("A"))).collect()


def test_composed_syncs(spark):
    companies = spark.createDataFrame([(1, "0001", "One", "s", "i", "c", "w", 5), (2, "0002", "Two", "s", "i", "c", "w", 5)], "id long, cik string, name string, sector string, industry string, country string, website string, market_cap long")
    securities = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, company_id long")
    news = lambda *rows: spark.createDataFrame(list(rows), "symbol string, title string, publisher string, summary string, url string, published_at timestamp")
    stored = spark.createDataFrame([(1, "t", "p", "s", "u1", None)], "company_id long, title string, publisher string, summary string, url string, published_at timestamp")
    table, staged, count = reconcile.sync_news(stored, news((" a", "t", "p", "s", "u1", None), ("A", "t", "p", "s", "u2", None), ("A", "t", "p", "s", "u2", None), ("b", "t", "  ", "s", "u3", None)), securities, companies)
    assert count == 1 and [tuple(r)[:2] for r in staged.select("url", "company_id").collect()] == [("u2", 1)] and table.count() == 2
    for bad, error in ((("Z", "t", "p", "s", "u", None), "not found"), (("A", None, "p", "s", "u", None), "conform"), ((" ", "t", "p", "s", "u", None), "blank")):
        with pytest.raises(Exception, match=error):
            reconcile.sync_news(stored, news(bad), securities, companies)[1].collect()
    statements = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 1.0)], "symbol string, fiscal_date date, total_revenue double")
    assert reconcile.sync_statements(spark.createDataFrame([], "company_id long, fiscal_date date"), statements, securities, companies)[2] == 1
    with pytest.raises(ValueError, match="twice"):
        reconcile.sync_statements(spark.createDataFrame([], "company_id long, fiscal_date date"), statements.union(statements), securities, companies)
    profile = lambda requested, symbol, cap=7: spark.createDataFrame([(requested, symbol, "New", "x", "i", "c", "w", cap)], "requested_symbol string, symbol string, name string, sector string, industry string, country string, website string, market_cap long")
    got = {r["id"]: (r["name"], r["market_cap"]) for r in reconcile.sync_profiles(companies, profile(" a", "A "), securities).collect()}
    assert got == {1: ("New", 7), 2: ("Two", 5)}
    for asked, error in ((profile("A", "B"), "another symbol"), (profile("A", "A", -1), "invalid"), (profile("Z", "Z"), "not found")):
        with pytest.raises(Exception, match=error):
            reconcile.sync_profiles(companies, asked, securities).collect()


def test_versions_are_published_whole(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(LookupError):
        (tmp_path / "v0").mkdir()
        reconcile.published(spark, str(tmp_path), "a")
    reconcile.publish_all({"a": df, "b": df}, str(tmp_path))
    reconcile.publish_all({"a": df.union(df), "b": df}, str(tmp_path))
    (tmp_path / "v9-broken" / "a").mkdir(parents=True)
    assert reconcile.published(spark, str(tmp_path), "a").count() == 6
    reconcile.publish(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        reconcile.publish(df, str(tmp_path / "t"))
    reconcile.publish(df, str(tmp_path / "t"), append=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6 and payloads.price_table(spark, str(tmp_path / "t")).count() == 6


def test_stream_of_files(spark, tmp_path):
    from barline.sources.store import append_batch, appended
    from barline.streaming.feeds import sync_stream

    rows = lambda *urls: spark.createDataFrame([(u, "t") for u in urls], "url string, title string")
    append_batch(rows("u1"), str(tmp_path / "table"), -1)
    rows("u1", "u2", "u2").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        feed = spark.readStream.schema("url string, title string").parquet(str(tmp_path / "in"))
        sync_stream(feed, str(tmp_path / "table"), ["url"], F.lit(True), "url", str(tmp_path / "checkpoint"), F.col("title")).awaitTermination()
    assert sorted(r["url"] for r in appended(spark, str(tmp_path / "table")).collect()) == ["u1", "u2"]
