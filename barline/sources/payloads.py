"""Landed payloads as typed tables. Raw tables have a key (symbol or cik) and a column json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import trimmed

BARS = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Dividends": "dividends", "Stock Splits": "stock_splits"}
REQUIRED = ("Open", "High", "Low", "Close", "Volume")


def price_table(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Stored bars, of one symbol or all. The filter reaches the scan."""
    bars = spark.read.parquet(path)
    return bars if symbol is None else bars.where(F.col("symbol") == symbol).orderBy("date")


def read_bars(spark: SparkSession, path: str, kind: str = "csv", **options) -> DataFrame:
    """Daily bars from files with a column Date and the provider's names."""
    raw = spark.read.options(**({"header": True} if kind == "csv" else {}), **options).format(kind).load(path)
    missing = sorted(set(REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kinds = {"date": "timestamp", "volume": "double"}
    shown = [(F.col(f"`{c}`") if c in raw.columns else F.lit(0.0)).cast(kinds.get(n, "double")).alias(n) for c, n in BARS.items()]
    keys = [c for c in raw.columns if c.lower() == "symbol"]
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("dividends", "stock_splits")}
    return raw.select(*keys, *shown).withColumns(zero | {"volume": F.col("volume").cast("long")})


def _checked(c: Column, ok: Column, message: str) -> Column:
    return F.when(ok, c).otherwise(F.raise_error(message))


def _objects(json: Column) -> Column:
    """The items of a JSON list of objects, each as JSON; anything else raises."""
    items = F.from_json(json, "array<string>")
    ok = json.rlike(r"^\s*\[") & items.isNotNull() & ~F.exists(items, lambda x: x.isNull() | ~x.startswith("{"))
    return _checked(items, F.coalesce(ok, F.lit(False)), "a payload is no list of objects")


def parse_profiles(raw: DataFrame) -> DataFrame:
    """Missing texts are empty. A market value that is no whole number raises."""
    j = F.from_json("json", "longName string, sector string, industry string, country string, website string, marketCap double")
    text = lambda c: F.coalesce(F.col(f"j.{c}"), F.lit(""))
    cap = F.col("j.marketCap")
    cap = _checked(cap.cast("long"), F.coalesce(cap == F.floor(cap), F.lit(True)), "a market value is no whole number")
    return raw.select("symbol", j.alias("j")).select("symbol", text("longName").alias("name"), *[text(c).alias(c) for c in ("sector", "industry", "country", "website")], cap.alias("market_cap"))


def parse_news(raw: DataFrame) -> DataFrame:
    """Providers and urls that are missing or no objects are empty; times are milliseconds since 1970, or null where they
    are no numbers or lie outside the years 1 to 9999. Items and contents that are no objects raise."""
    kind = "title string, summary string, pubDate string, provider string, canonicalUrl string"
    rows = raw.select("symbol", F.posexplode(_objects(F.col("json"))))
    content = F.coalesce(F.get_json_object("col", "$.content"), F.lit("{}"))
    content = F.from_json(_checked(content, content.startswith("{"), "a news item's content is no object"), kind)
    rows = rows.select("symbol", "pos", content.alias("c")).select("symbol", "pos", "c.*")
    text = lambda c: F.coalesce(c, F.lit(""))
    millis = F.col("pubDate").try_cast("double")
    at = F.when(millis.between(-62135596800000.0, 253402300799999.0), F.timestamp_millis(millis.try_cast("long")))
    return rows.select(
        "symbol", "pos", text(F.col("title")).alias("title"), text(F.get_json_object("provider", "$.displayName")).alias("publisher"), text(F.col("summary")).alias("summary"),
        text(F.get_json_object("canonicalUrl", "$.url")).alias("url"), at.alias("published_at"),
    )


def parse_statements(raw: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` statements of each list; a payload that is no list of objects, or has no date, raises."""
    if limit <= 0:
        raise ValueError("limit must be greater than zero")
    kind = "date date, revenue double, grossProfit double, operatingIncome double, netIncome double, eps double, weightedAverageShsOut long"
    rows = raw.select("symbol", F.posexplode(_objects(F.col("json")))).where(F.col("pos") < limit)
    rows = rows.select("symbol", F.from_json("col", kind, {"mode": "FAILFAST"}).alias("s"))
    names = {"date": "fiscal_date", "revenue": "total_revenue", "grossProfit": "gross_profit", "operatingIncome": "operating_income", "netIncome": "net_income", "eps": "eps", "weightedAverageShsOut": "shares_outstanding"}
    shown = [F.col(f"s.{c}").alias(n) for c, n in names.items() if c != "date"]
    return rows.select("symbol", _checked(F.col("s.date"), F.col("s.date").isNotNull(), "a statement has no date").alias("fiscal_date"), *shown)


def parse_facts(raw: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Company facts (cik, json) as long rows: cik, tag, unit, unit_pos, pos, end, val, form, fp, filed.

    With ``tags`` a document is parsed once and only those are built: the parser skips all others, which are nearly all
    of a document. Units keep the order of the document.
    """
    fact = "struct<end: string, val: double, form: string, fp: string, filed: string>"
    one = f"struct<units: map<string, array<{fact}>>>"
    if tags is None:
        kind = f"facts struct<`us-gaap`: map<string, {one}>>"
        found = raw.select("cik", F.explode(F.from_json("json", kind)["facts"]["us-gaap"]).alias("tag", "t"))
    else:
        names = sorted(set(tags))
        inner = ", ".join(f"`{t}`: {one}" for t in names)
        facts = F.from_json("json", f"facts struct<`us-gaap`: struct<{inner}>>")["facts"]["us-gaap"]
        held = raw.select("cik", facts.alias("f")).select("cik", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col("f")[t].alias("t")) for t in names])).alias("x"))
        found = held.select("cik", "x.tag", "x.t").where("t is not null")
    units = found.select("cik", "tag", F.posexplode(F.col("t.units")).alias("unit_pos", "unit", "facts"))
    return units.select("cik", "tag", "unit", "unit_pos", F.posexplode_outer("facts").alias("pos", "f")).select("cik", "tag", "unit", "unit_pos", "pos", "f.*")


def _padded(c: Column) -> Column:
    return F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c)


def parse_universe(raw: DataFrame, place: str | None = None) -> DataFrame:
    """{fields, data} payloads as (cik, symbol, name, exchange, pos). Another header raises; broken rows are left out.

    ``pos`` is the place in a payload or, where the column ``place`` numbers the payloads, that of all of them in turn.
    """
    j = F.from_json("json", "fields array<string>, data array<string>")
    header = F.array(*map(F.lit, ("cik", "name", "ticker", "exchange")))
    number = F.lit(0) if place is None else F.col(place)
    ok = raw.select(j.alias("j"), number.cast("long").alias("number")).where(F.when(F.col("j.fields") == header, True).otherwise(F.raise_error("unexpected fields").cast("boolean")))
    at = (F.col("number") * (1 << 31) + F.col("pos")).alias("pos") if place else F.col("pos")
    rows = ok.select("number", F.posexplode("j.data")).select(at, F.from_json("col", "array<string>").alias("a")).where(F.size("a") == 4)
    made = rows.select(_padded(F.col("a")[0]).alias("cik"), F.upper(trimmed(F.col("a")[2])).alias("symbol"), trimmed(F.col("a")[1]).alias("name"), F.coalesce(F.col("a")[3], F.lit("")).alias("exchange"), "pos")
    return made.where("cik is not null and symbol != '' and name != ''")


def parse_ticker_map(raw: DataFrame) -> DataFrame:
    """(symbol, cik) of a map of objects, whatever its keys; of a symbol's entries the last counts."""
    rows = raw.select(F.posexplode(F.from_json("json", "map<string, struct<ticker: string, cik_str: string>>")).alias("pos", "k", "v")).select("v.*", "pos")
    rows = rows.where("ticker != '' and cik_str != ''").withColumn("symbol", F.upper("ticker"))
    return rows.groupBy("symbol").agg(F.max_by(_padded(F.col("cik_str")), "pos").alias("cik"))
