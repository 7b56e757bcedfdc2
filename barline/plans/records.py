"""Queries of records, payloads, lookups and syncs over the given tables, and their SQL.

Customers are companies with one listing each, events are news, orders are statements and facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, indicators, lookup, projections, reconcile, validate
from ..sources import payloads
from . import bars

_BARS = "WITH " + bars.SQL
_read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(c: str):
    return F.lpad(F.col(c).cast("string"), 10, "0")


def _raw_companies(spark, sf_dir):
    """Staged company records: spaces, small letters, blank segments, market values as texts."""
    c = _read(spark, sf_dir, "customer")
    country = F.when(F.col("c_nationkey") == 3, " \t").otherwise(F.concat(F.lit(" land  "), F.col("c_nationkey").cast("string")))
    return c.select(
        F.col("c_custkey").alias("id"), _padded("c_custkey").alias("cik"), F.concat(F.lit("  c"), F.col("c_custkey").cast("string"), F.lit("\n")).alias("symbol"), F.concat(F.lit(" "), F.col("c_name"), F.lit("   Inc. ")).alias("name"),
        F.lower("c_mktsegment").alias("sector"), F.col("c_mktsegment").alias("industry"), country.alias("country"), F.concat(F.lit("www."), F.col("c_name")).alias("website"), F.floor("c_acctbal").cast("string").alias("market_cap"),
    )


def _companies(spark, sf_dir):
    c = clean.clean_company(_raw_companies(spark, sf_dir))
    return c.withColumn("market_cap", F.col("market_cap").cast("long"))


def _securities(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select((F.col("c_custkey") + 100000).alias("id"), F.col("c_custkey").alias("company_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), F.when(F.col("c_mktsegment") == "BUILDING", "OTC").otherwise("NYSE").alias("exchange"))


_COMPANIES = """companies AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'C' || c_custkey AS symbol, c_name || ' Inc.' AS name, lower(c_mktsegment) AS sector,
  c_mktsegment AS industry, CASE WHEN c_nationkey = 3 THEN '' ELSE 'land ' || c_nationkey END AS country, 'www.' || c_name AS website, CAST(floor(c_acctbal) AS BIGINT) AS market_cap FROM customer)"""
_SECURITIES = "securities AS (SELECT c_custkey + 100000 AS id, c_custkey AS company_id, 'C' || c_custkey AS symbol, CASE WHEN c_mktsegment = 'BUILDING' THEN 'OTC' ELSE 'NYSE' END AS exchange FROM customer)"


def _news(spark, sf_dir):
    """Events as news: errors have no date, every twelfth url comes twice, some publishers are blank."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"), F.col("user_id").alias("company_id"), F.concat(F.lit("  "), F.col("event_type"), F.lit("\n "), F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("value") < 1, "  ").otherwise(F.concat(F.lit("p "), F.col("event_type"))).alias("publisher"), F.col("props").alias("summary"),
        F.concat(F.lit("http://e/"), F.when(F.col("event_id") % 12 == 1, F.col("event_id") - 1).otherwise(F.col("event_id")).cast("string")).alias("url"), F.when(F.col("event_type") != "error", F.date_trunc("second", "ts")).alias("published_at"),
    )


_NEWS = r"""news AS (SELECT event_id, user_id AS company_id, event_type || ' ' || event_id AS title, CASE WHEN value < 1 THEN '' ELSE 'p ' || event_type END AS publisher, props AS summary,
  'http://e/' || CASE WHEN event_id % 12 = 1 THEN event_id - 1 ELSE event_id END AS url, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS published_at FROM events)"""


def _statements(spark, sf_dir):
    """Orders as statements of customers, one a day."""
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("fiscal_date")).agg(F.max("o_totalprice").alias("total_revenue"), F.max("o_orderkey").alias("k"))
    kept = F.when(F.col("k") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("total_revenue") / 2)
    return o.select("company_id", "fiscal_date", "total_revenue", kept.alias("gross_profit"), F.lit(None).cast("double").alias("operating_income"), (F.col("total_revenue") / 4).alias("net_income"), F.lit(1.5).alias("eps"), F.when(F.col("k") % 37 == 0, F.lit(-1)).otherwise(F.col("k")).cast("long").alias("shares_outstanding"))


_STATEMENTS = """statements AS (SELECT *, total_revenue / 2 AS half, total_revenue / 4 AS net_income, k % 31 <> 0 AND NOT (k % 37 = 0) AS ok FROM
  (SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS fiscal_date, max(o_totalprice) AS total_revenue, max(o_orderkey) AS k FROM orders GROUP BY 1, 2))"""


def src3_profiles(spark, sf_dir):
    c = _companies(spark, sf_dir)
    json = F.to_json(F.struct(F.col("name").alias("longName"), F.when(F.col("country") != "", F.col("country")).alias("country"), "sector", (F.col("market_cap") * 1.0).alias("marketCap")))
    return payloads.parse_profiles(c.select("symbol", json.alias("json"))).drop("industry", "website")


def src4_news(spark, sf_dir):
    """One payload for each company: a third of the dates are no numbers, out of range, or missing."""
    n = _news(spark, sf_dir)
    at = F.when(F.col("published_at").isNull(), "1e300").when(F.col("event_id") % 9 == 0, "soon").otherwise((F.unix_timestamp("published_at") * 1000).cast("string"))
    item = F.struct(F.struct(F.col("title"), F.col("summary"), at.alias("pubDate"), F.struct(F.col("publisher").alias("displayName")).alias("provider"), F.when(F.col("event_id") % 5 > 0, F.struct("url")).alias("canonicalUrl")).alias("content"))
    raw = n.groupBy(F.concat(F.lit("C"), F.col("company_id").cast("string")).alias("symbol")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))), lambda x: x["item"])).alias("json"))
    return clean.clean_news(payloads.parse_news(raw))


def src5_statements(spark, sf_dir):
    s = _statements(spark, sf_dir)
    item = F.struct(F.col("fiscal_date").alias("date"), F.col("total_revenue").alias("revenue"), F.col("net_income").alias("netIncome"), F.col("shares_outstanding").alias("weightedAverageShsOut"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("fiscal_date", item.alias("item"))), asc=False), lambda x: x["item"])
    raw = s.groupBy(F.col("company_id").cast("string").alias("symbol")).agg(F.to_json(listed).alias("json"))
    return payloads.parse_statements(raw, 5).select("symbol", "fiscal_date", "total_revenue", "gross_profit", "net_income", "shares_outstanding")


_TAGS = ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "GrossProfit", "OperatingIncomeLoss", "ProfitLoss", "EarningsPerShareBasic", "WeightedAverageNumberOfDilutedSharesOutstanding")


_WANTED = [t for tags in reconcile.FACT_TAGS.values() for t in tags]


def _fact_payloads(spark, sf_dir):
    """Orders as company facts: customers of nation 7 have no contract revenue, those of nation 5 report it in EUR only."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    k, nation = F.col("o_orderkey"), F.col("c_nationkey")
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.pmod(k, F.lit(7)) + 1).cast("int"))
    tag = F.when((nation == 7) & (k % 7 == 0), "SalesRevenueNet").otherwise(tag)
    unit = F.when(k % 7 == 6, "shares").when(k % 7 == 5, "USD-per-shares").when((nation == 5) & (k % 7 == 0), "EUR").otherwise("USD")
    fact = F.struct(
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31")).alias("end"), F.floor("o_totalprice").cast("double").alias("val"), F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q").alias("form"),
        F.when(k % 11 == 0, "Q3").otherwise("FY").alias("fp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"),
    )
    units = o.groupBy(_padded("o_custkey").alias("cik"), tag.alias("tag"), unit.alias("unit")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    tags = units.groupBy("cik", "tag").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "facts"))).alias("units")).alias("t"))
    whole = tags.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", "t"))).alias("us-gaap"))
    return whole.select("cik", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("json"))


def src6_company_facts(spark, sf_dir):
    """Annual statements of company facts, all six concepts by the preferred tags and units."""
    return reconcile.statements_of_facts(payloads.parse_facts(_fact_payloads(spark, sf_dir), _WANTED))


def agg5_first_available(spark, sf_dir):
    chosen = reconcile.first_available(payloads.parse_facts(_fact_payloads(spark, sf_dir), _WANTED), reconcile.FACT_TAGS, reconcile.FACT_UNITS)
    return chosen.groupBy("cik", "concept", "tag", "unit").agg(F.count("*").alias("facts"))


_FACTS = f"""raw AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderkey AS pos, c_nationkey AS nation, o_orderkey % 7 AS k, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS fiscal_date, floor(o_totalprice) AS val,
    o_orderstatus IN ('F', 'O') AND o_orderkey % 11 <> 0 AS annual, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders JOIN customer ON c_custkey = o_custkey),
  tagged AS (SELECT *, CASE WHEN nation = 7 AND k = 0 THEN 'SalesRevenueNet' ELSE [{", ".join(f"'{t}'" for t in _TAGS)}][CAST(k + 1 AS INT)] END AS tag,
    CASE WHEN k = 6 THEN 'shares' WHEN k = 5 THEN 'USD-per-shares' WHEN nation = 5 AND k = 0 THEN 'EUR' ELSE 'USD' END AS unit FROM raw),
  ranked AS (SELECT *, CASE WHEN tag LIKE '%evenue%' THEN 'total_revenue' WHEN tag = 'GrossProfit' THEN 'gross_profit' WHEN tag = 'OperatingIncomeLoss' THEN 'operating_income' WHEN tag = 'ProfitLoss' THEN 'net_income'
      WHEN tag LIKE 'Earn%' THEN 'eps' ELSE 'shares_outstanding' END AS concept, CASE tag WHEN 'Revenues' THEN 1 WHEN 'SalesRevenueNet' THEN 2 ELSE 0 END AS rank FROM tagged),
  chosen AS (SELECT * FROM ranked QUALIFY rank = min(rank) OVER (PARTITION BY cik, concept))"""
_VALUE = "arg_max(val, row(filed, -pos)) FILTER (concept = '{0}')"


def src7_universe(spark, sf_dir):
    """Customers as one {fields, data} payload for each nation; broken rows are left out."""
    c = _read(spark, sf_dir, "customer")
    listed = F.concat(F.lit(',"c'), F.col("c_custkey").cast("string"), F.lit(' ","Nyse"'))
    row = F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit('," '), F.col("c_name"), F.lit('"'), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(listed), F.lit("]"))
    rows = c.select("c_nationkey", row.alias("row"))
    raw = rows.groupBy("c_nationkey").agg(F.concat(F.lit('{"fields":["cik","name","ticker","exchange"],"data":['), F.array_join(F.collect_list("row"), ","), F.lit("]}")).alias("json"))
    return payloads.parse_universe(raw.select("json")).drop("pos")


def src8_ticker_map(spark, sf_dir):
    """Customers as one map for each nation, under keys that are no numbers."""
    c = _read(spark, sf_dir, "customer")
    entry = F.struct(F.concat(F.lit("k"), F.col("c_custkey").cast("string")), F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_custkey").cast("string")).alias("cik_str")))
    return payloads.parse_ticker_map(c.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json")))


def p3_clean_company(spark, sf_dir):
    return clean.clean_company(_raw_companies(spark, sf_dir)).drop("market_cap")


def p4_clean_news(spark, sf_dir):
    return clean.clean_news(_news(spark, sf_dir))


def p6_clean_income_statement(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    texts = {c: F.col("o_totalprice").cast("string") for c in clean.NUMBERS}
    return clean.clean_income_statement(o.withColumns(texts | {"shares_outstanding": F.col("o_custkey").cast("string")})).select("o_orderkey", *clean.NUMBERS, "shares_outstanding")


def p7_conform(spark, sf_dir):
    raw = _raw_companies(spark, sf_dir).withColumns({"sector": F.when(F.col("sector") != "furniture", F.col("sector")), "market_cap": F.when(F.col("id") % 5 == 0, "much").otherwise(F.col("market_cap"))})
    return clean.conform(raw, clean.COMPANY, "mark", keys=("id",)).select("id", "market_cap", "conforms")


def p8_valid_company(spark, sf_dir):
    return _companies(spark, sf_dir).select("id", validate.valid_company().alias("valid"), F.array_join(validate.company_faults(), ",").alias("faults"))


def p10_valid_news(spark, sf_dir):
    return clean.clean_news(_news(spark, sf_dir)).select("event_id", validate.valid_news().alias("valid"))


def p11_valid_income_statement(spark, sf_dir):
    return _statements(spark, sf_dir).select("company_id", "fiscal_date", validate.valid_income_statement().alias("valid"))


def p16_blank_symbols(spark, sf_dir):
    return _raw_companies(spark, sf_dir).select("id", F.col("country").alias("symbol")).select("id", validate.filled("symbol").alias("has_symbol"))


def p17_symbol_mismatch(spark, sf_dir):
    c = _companies(spark, sf_dir).withColumn("requested_symbol", F.when(F.col("industry") == "BUILDING", F.concat("symbol", F.lit("X"))).otherwise(F.col("symbol")))
    return c.select("id", validate.same_symbol().alias("same_symbol"))


def p18_price_rows(spark, sf_dir):
    return projections.price_rows(clean.clean_price(bars.daily_bars(spark, sf_dir))).select("symbol", "date", "volume", "dividends", "stock_splits", (F.floor(F.col("close") * 10000 + 0.5) / 10000.0).alias("close"))


def p19_news_rows(spark, sf_dir):
    return projections.news_rows(clean.clean_news(_news(spark, sf_dir)))


def p20_company_rows(spark, sf_dir):
    return projections.company_rows(_securities(spark, sf_dir), _companies(spark, sf_dir).drop("symbol", "cik"))


def p21_indicator_rows(spark, sf_dir):
    function, columns = indicators.REGISTRY["i12_obv"]
    shown = projections.indicator_rows(function(bars.daily_bars(spark, sf_dir)), list(columns), volume=True)
    return shown.withColumn("close", F.floor(F.col("close") * 10000 + 0.5) / 10000.0)


def j1_securities_of_symbols(spark, sf_dir):
    wanted = _read(spark, sf_dir, "events").select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("symbol"))
    s = _securities(spark, sf_dir)
    return lookup.securities_of(lookup.among(wanted, s, ["symbol"]), s)


def j3_prices_of_symbols(spark, sf_dir):
    b = bars.daily_bars(spark, sf_dir).withColumnRenamed("symbol", "security_id")
    listed = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("symbol")).distinct()
    return lookup.prices(listed, b).select("symbol", "date", "volume")


def j4_company_news(spark, sf_dir):
    return lookup.company_news(_securities(spark, sf_dir), _news(spark, sf_dir), "C8").select("event_id", "company_id", "url")


def j5_company_by_cik(spark, sf_dir):
    return lookup.among(_companies(spark, sf_dir), _read(spark, sf_dir, "supplier").select(_padded("s_suppkey").alias("cik")), ["cik"]).select("id", "cik", "name")


def j8_new_statements(spark, sf_dir):
    s = _statements(spark, sf_dir)
    stored = _read(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.to_date(F.date_sub(F.to_date("ts"), 8766)).alias("fiscal_date")).distinct()
    return lookup.new_rows(s, stored, ["company_id", "fiscal_date"]).select("company_id", "fiscal_date", "total_revenue")


def j9_companies_in_ciks(spark, sf_dir):
    return lookup.among(_companies(spark, sf_dir), _read(spark, sf_dir, "orders").select(_padded("o_custkey").alias("cik")), ["cik"]).select("id", "cik")


def j10_securities_in_symbols(spark, sf_dir):
    return lookup.among(_securities(spark, sf_dir), _read(spark, sf_dir, "events").select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("symbol")), ["symbol"])


def j12_security_of_company(spark, sf_dir):
    wanted = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("C"), (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("string")).alias("symbol"))
    return lookup.security_of(_securities(spark, sf_dir), wanted)


def j13_news_at(spark, sf_dir):
    n = _news(spark, sf_dir)
    return lookup.news_at(n, n.where("title LIKE '%view%' OR title LIKE '%error%'")).select("event_id", "url")


def j14_ciks_of_tickers(spark, sf_dir):
    known = _companies(spark, sf_dir).select("symbol", "cik")
    return lookup.ciks_of(_securities(spark, sf_dir), known)


def j15_rekeyed(spark, sf_dir):
    by_symbol = _statements(spark, sf_dir).select(F.concat(F.lit("C"), F.col("company_id").cast("string")).alias("symbol"), "fiscal_date")
    return lookup.rekey(by_symbol, "symbol", "company_id", _securities(spark, sf_dir)).select("company_id", "fiscal_date")


def agg4_sync_counts(spark, sf_dir):
    """Rows that each kind of sync would insert."""
    n, s = clean.clean_news(_news(spark, sf_dir)), _statements(spark, sf_dir)
    news = reconcile.sync_rows(n.where("false"), n, ["url"], validate.valid_news(), "event_id", "first")[2]
    rows = reconcile.sync_rows(s.where("false"), s, ["company_id", "fiscal_date"], validate.valid_income_statement(), "fiscal_date")[2]
    return spark.createDataFrame([("news", news), ("statements", rows)], "kind string, inserted long")


def mrg3_universe_sync(spark, sf_dir):
    """Orders as a feed of listings of companies, over all suppliers as stored companies."""
    old = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cik"), F.col("s_name").alias("name"), F.lit("tools").alias("sector"))
    o = _read(spark, sf_dir, "orders")
    exchange = F.element_at(F.array(*map(F.lit, ("nasdaq", "NYSE ", "OTC", "NYSE ARCA"))), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    feed = o.select(F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit(" l"), F.col("o_custkey").cast("string"), F.lit("y"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("symbol"), F.concat(F.lit("company "), F.col("o_orderpriority")).alias("name"), exchange.alias("exchange"), F.col("o_orderkey").alias("pos"))
    listed = spark.createDataFrame([], "symbol string, cik string, exchange string")
    return reconcile.sync_universe(old, listed, feed)[0]


def mrg3_universe_securities(spark, sf_dir):
    """The other two results of the universe sync: securities after it, over one stored listing of each customer, and the
    number of listings that it took."""
    companies = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cik"), F.col("s_name").alias("name"), F.lit("tools").alias("sector"))
    feed = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit(" l"), F.col("o_custkey").cast("string"), F.lit("y"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("symbol"),
        F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 4 == 2, "OTC").otherwise(" nyse").alias("exchange"), F.col("o_orderkey").alias("pos"),
    )
    listed = _read(spark, sf_dir, "customer").select(F.concat(F.lit("L"), F.col("c_custkey").cast("string"), F.lit("Y1")).alias("symbol"), F.col("c_custkey").cast("string").alias("cik"), F.lit("OLD").alias("exchange"))
    _, securities, taken = reconcile.sync_universe(companies, listed, feed)
    return securities.withColumn("taken", F.lit(taken).cast("long"))


def mrg5_news_sync(spark, sf_dir):
    """Events as news of symbols; a company with a blank publisher is left out whole; web pages are the stored news."""
    n = _news(spark, sf_dir).withColumn("url", F.concat(F.lit("http://e/"), F.col("event_id").cast("string")))
    incoming = n.select(F.concat(F.lit(" c"), F.col("company_id").cast("string")).alias("symbol"), "title", "publisher", "summary", "url", "published_at")
    stored = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("company_id"), F.lit("t").alias("title"), F.lit("p").alias("publisher"), F.lit("s").alias("summary"), F.concat(F.lit("http://e/"), F.col("page_id").cast("string")).alias("url"), F.lit(None).cast("timestamp").alias("published_at"))
    users = _read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    listed = users.select(F.col("id").alias("company_id"), F.concat(F.lit("C"), F.col("id").cast("string")).alias("symbol"))
    return reconcile.sync_news(stored, incoming, listed, users)[1]


def mrg6_statement_sync(spark, sf_dir):
    """Statements of symbols; a company with a bad one is left out whole; the ship dates of its lines are stored."""
    s = _statements(spark, sf_dir)
    incoming = s.select(F.concat(F.lit("c"), F.col("company_id").cast("string")).alias("symbol"), *[c for c in s.columns if c != "company_id"])
    shipped = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    stored = shipped.select(F.col("o_custkey").alias("company_id"), F.to_date("l_shipdate").alias("fiscal_date")).distinct()
    return reconcile.sync_statements(stored, incoming, _securities(spark, sf_dir), _companies(spark, sf_dir).select("id"))[1]


def mrg7_profile_sync(spark, sf_dir):
    """Every customer with events asks for its profile; the others keep theirs."""
    c = _companies(spark, sf_dir)
    asked = lookup.among(c, _read(spark, sf_dir, "events").select(F.col("user_id").alias("id")), ["id"])
    incoming = asked.select(F.concat(F.lit(" "), F.lower("symbol")).alias("requested_symbol"), "symbol", F.concat("name", F.lit("  new ")).alias("name"), F.concat(F.lit("s "), F.col("sector")).alias("sector"), "industry", F.lit("land").alias("country"), "website", F.abs("market_cap").alias("market_cap"))
    return reconcile.sync_profiles(c, incoming, _securities(spark, sf_dir)).select("id", "cik", "name", "sector", "country", "market_cap")


def snk4_update_profiles(spark, sf_dir):
    new = _read(spark, sf_dir, "supplier").select(_padded("s_suppkey").alias("cik"), F.col("s_name").alias("name"), F.floor("s_acctbal").cast("long").alias("market_cap"), F.when(F.col("s_nationkey") > 10, F.concat(F.lit("N"), F.col("s_suppkey").cast("string"))).alias("new_cik"))
    return reconcile.update_profiles(_companies(spark, sf_dir), new).select("id", "cik", "name", "sector", "market_cap")


def ic1_null_keys(spark, sf_dir):
    return reconcile.null_keys(_news(spark, sf_dir).select("event_id", "url", "published_at"), ["url", "published_at"])


def ic3_unique_keys(spark, sf_dir):
    return reconcile.duplicates(_news(spark, sf_dir), ["url"])


def bf1_derived_securities(spark, sf_dir):
    return reconcile.derive_securities(_companies(spark, sf_dir).withColumn("exchange", F.upper("sector")))


def so2_newest_first(spark, sf_dir):
    n = _news(spark, sf_dir).withColumns({"published_at": F.col("published_at").cast("date"), "url": F.concat("url", F.lit("/"), F.col("event_id").cast("string"))})
    return lookup.newest_first(n).select("company_id", "url", "place")


def so3_universe_by_symbol(spark, sf_dir):
    return projections.universe_by_symbol(_securities(spark, sf_dir)).select("symbol", "exchange")


def so4_fiscal_dates(spark, sf_dir):
    return projections.fiscal_dates_ascending(_statements(spark, sf_dir).select(F.col("company_id").alias("cik"), "fiscal_date"))


def so9_first_articles(spark, sf_dir):
    n = clean.clean_news(_news(spark, sf_dir))
    return reconcile.first_of_each(n, "company_id", F.struct("event_id"), 3).select("company_id", "event_id", "title")


_NEWS_COLUMNS = "event_id, company_id, title, publisher, summary, url, published_at"
ORACLE: dict[str, str] = {
    "src3_profiles": f"WITH {_COMPANIES} SELECT symbol, name, sector, country, market_cap FROM companies",
    "src4_news": f"""WITH {_NEWS} SELECT 'C' || company_id AS symbol, CAST(row_number() OVER (PARTITION BY company_id ORDER BY event_id) - 1 AS INT) AS pos, title, publisher, summary, CASE WHEN event_id % 5 > 0 THEN url ELSE '' END AS url,
      CASE WHEN event_id % 9 > 0 THEN published_at END AS published_at FROM news""",
    "src5_statements": f"""WITH {_STATEMENTS} SELECT CAST(company_id AS VARCHAR) AS symbol, fiscal_date, total_revenue, CAST(NULL AS DOUBLE) AS gross_profit, net_income, CASE WHEN k % 37 = 0 THEN -1 ELSE k END AS shares_outstanding
      FROM statements QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY fiscal_date DESC) <= 5""",
    "src6_company_facts": f"""WITH {_FACTS} SELECT cik, fiscal_date, {", ".join(_VALUE.format(c) + f" AS {c}" for c in reconcile.CONCEPTS[:-1])}, CAST({_VALUE.format("shares_outstanding")} AS BIGINT) AS shares_outstanding
      FROM chosen WHERE annual GROUP BY cik, fiscal_date HAVING bool_or(concept = 'total_revenue')""",
    "agg5_first_available": f"WITH {_FACTS} SELECT cik, concept, tag, unit, count(*) AS facts FROM chosen GROUP BY ALL",
    "src7_universe": "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'C' || c_custkey AS symbol, c_name AS name, 'Nyse' AS exchange FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "src8_ticker_map": "SELECT 'C' || c_custkey AS symbol, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "p3_clean_company": f"WITH {_COMPANIES} SELECT * EXCLUDE (market_cap) FROM companies",
    "p4_clean_news": f"WITH {_NEWS} SELECT {_NEWS_COLUMNS} FROM news",
    "p6_clean_income_statement": "SELECT o_orderkey, o_totalprice AS total_revenue, o_totalprice AS gross_profit, o_totalprice AS operating_income, o_totalprice AS net_income, o_totalprice AS eps, o_custkey AS shares_outstanding FROM orders",
    "p7_conform": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS market_cap, c_custkey % 5 > 0 AND c_mktsegment <> 'FURNITURE' AS conforms FROM customer",
    "p8_valid_company": f"WITH {_COMPANIES} SELECT id, country <> '' AND market_cap >= 0 AS valid, concat_ws(',', CASE WHEN country = '' THEN 'country' END, CASE WHEN market_cap < 0 THEN 'market_cap' END) AS faults FROM companies",
    "p10_valid_news": f"WITH {_NEWS} SELECT event_id, publisher <> '' AS valid FROM news",
    "p11_valid_income_statement": f"WITH {_STATEMENTS} SELECT company_id, fiscal_date, ok AS valid FROM statements",
    "p16_blank_symbols": f"WITH {_COMPANIES} SELECT id, country <> '' AS has_symbol FROM companies",
    "p17_symbol_mismatch": f"WITH {_COMPANIES} SELECT id, industry <> 'BUILDING' AS same_symbol FROM companies",
    "p18_price_rows": f"{_BARS} SELECT symbol, date, volume, 0.0::DOUBLE AS dividends, 0.0::DOUBLE AS stock_splits, floor(close * 10000 + 0.5) / 10000.0 AS close FROM bars",
    "p19_news_rows": f"WITH {_NEWS} SELECT company_id, title, publisher, summary, url, published_at FROM news",
    "p20_company_rows": f"WITH {_COMPANIES} SELECT * EXCLUDE (cik) FROM companies",
    "p21_indicator_rows": f"""{_BARS}, signed AS (SELECT *, CASE WHEN close > lag(close) OVER w THEN volume WHEN close < lag(close) OVER w THEN -volume ELSE 0 END AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
      SELECT symbol, date, floor(close * 10000 + 0.5) / 10000.0 AS close, volume, CAST(sum(v) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM signed""",
    "j1_securities_of_symbols": f"WITH {_SECURITIES} SELECT * FROM securities WHERE company_id IN (SELECT user_id FROM events)",
    "j3_prices_of_symbols": f"{_BARS} SELECT lower(symbol) AS symbol, date, volume FROM bars",
    "j4_company_news": f"WITH {_NEWS} SELECT event_id, company_id, url FROM news WHERE company_id = 8 AND 8 IN (SELECT c_custkey FROM customer)",
    "j5_company_by_cik": f"WITH {_COMPANIES} SELECT id, cik, name FROM companies WHERE id IN (SELECT s_suppkey FROM supplier)",
    "j8_new_statements": f"WITH {_STATEMENTS} SELECT company_id, fiscal_date, total_revenue FROM statements WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = company_id AND CAST(ts AS DATE) - 8766 = fiscal_date)",
    "j9_companies_in_ciks": f"WITH {_COMPANIES} SELECT id, cik FROM companies WHERE id IN (SELECT o_custkey FROM orders)",
    "j10_securities_in_symbols": f"WITH {_SECURITIES} SELECT * FROM securities WHERE company_id IN (SELECT user_id FROM events)",
    "j12_security_of_company": f"WITH {_SECURITIES} SELECT * FROM securities WHERE company_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')",
    "j13_news_at": f"WITH {_NEWS} SELECT event_id, url FROM news n WHERE EXISTS (SELECT 1 FROM news m WHERE m.company_id = n.company_id AND m.published_at IS NOT DISTINCT FROM n.published_at AND (m.title LIKE '%view%' OR m.title LIKE '%error%'))",
    "j14_ciks_of_tickers": f"WITH {_COMPANIES} SELECT symbol, cik FROM companies",
    "j15_rekeyed": f"WITH {_STATEMENTS} SELECT company_id, fiscal_date FROM statements",
    "agg4_sync_counts": f"""WITH {_NEWS}, {_STATEMENTS} SELECT 'news' AS kind, count(DISTINCT url) AS inserted FROM news WHERE publisher <> ''
      UNION ALL SELECT 'statements', count(*) FROM (SELECT * FROM statements QUALIFY bool_and(ok) OVER (PARTITION BY fiscal_date))""",
    "mrg3_universe_sync": """WITH feed AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, 'L' || o_custkey || 'Y' || (o_orderkey % 3) AS symbol, 'company ' || o_orderpriority AS name, o_orderkey % 4 AS e, o_orderkey AS pos FROM orders),
      listed AS (SELECT cik, symbol, arg_max(name, pos) AS name, arg_max(e, pos) AS e FROM feed GROUP BY cik, symbol HAVING arg_max(e, pos) <> 2), r AS (SELECT cik, arg_min(name, symbol) AS name FROM listed GROUP BY cik)
      SELECT coalesce(a.cik, r.cik) AS cik, coalesce(r.name, a.name) AS name, CASE WHEN a.cik IS NULL THEN '' ELSE 'tools' END AS sector FROM (SELECT CAST(s_suppkey AS VARCHAR) AS cik, s_name AS name FROM supplier) a FULL JOIN r ON a.cik = r.cik""",
    "mrg3_universe_securities": """WITH feed AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, 'L' || o_custkey || 'Y' || (o_orderkey % 3) AS symbol, o_orderkey % 4 AS e, o_orderkey AS pos FROM orders),
      fed AS (SELECT cik, symbol FROM feed GROUP BY cik, symbol HAVING arg_max(e, pos) <> 2), stored AS (SELECT 'L' || c_custkey || 'Y1' AS symbol, CAST(c_custkey AS VARCHAR) AS cik FROM customer)
      SELECT coalesce(s.symbol, f.symbol) AS symbol, coalesce(s.cik, f.cik) AS cik, CASE WHEN f.symbol IS NULL THEN 'OLD' ELSE 'NYSE' END AS exchange, (SELECT count(*) FROM fed) AS taken FROM stored s FULL JOIN fed f ON s.symbol = f.symbol""",
    "mrg5_news_sync": f"""WITH {_NEWS}, fed AS (SELECT * REPLACE ('http://e/' || event_id AS url) FROM news) SELECT title, publisher, summary, url, published_at, company_id FROM (SELECT * FROM fed QUALIFY bool_and(publisher <> '') OVER (PARTITION BY company_id))
      WHERE url NOT IN (SELECT 'http://e/' || page_id FROM pages)""",
    "mrg6_statement_sync": f"""WITH {_STATEMENTS} SELECT company_id, fiscal_date, total_revenue, half AS gross_profit, CAST(NULL AS DOUBLE) AS operating_income, net_income, 1.5::DOUBLE AS eps, k AS shares_outstanding
      FROM (SELECT * FROM statements QUALIFY bool_and(ok) OVER (PARTITION BY company_id)) s WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = s.company_id AND CAST(l_shipdate AS DATE) = s.fiscal_date)""",
    "mrg7_profile_sync": f"""WITH {_COMPANIES}, asked AS (SELECT DISTINCT user_id FROM events) SELECT id, cik, CASE WHEN user_id IS NULL THEN name ELSE name || ' new' END AS name, CASE WHEN user_id IS NULL THEN sector ELSE 's ' || sector END AS sector,
      CASE WHEN user_id IS NULL THEN country ELSE 'land' END AS country, CASE WHEN user_id IS NULL THEN market_cap ELSE abs(market_cap) END AS market_cap FROM companies LEFT JOIN asked ON user_id = id""",
    "snk4_update_profiles": f"""WITH {_COMPANIES} SELECT id, CASE WHEN s_nationkey > 10 THEN 'N' || s_suppkey ELSE cik END AS cik, coalesce(s_name, name) AS name, sector, CASE WHEN s_suppkey IS NULL THEN market_cap ELSE CAST(floor(s_acctbal) AS BIGINT) END AS market_cap
      FROM companies LEFT JOIN supplier ON s_suppkey = id""",
    "ic1_null_keys": f"WITH {_NEWS} SELECT event_id, url, published_at FROM news WHERE published_at IS NULL",
    "ic3_unique_keys": f"WITH {_NEWS} SELECT url, count(*) AS n FROM news GROUP BY url HAVING count(*) > 1",
    "bf1_derived_securities": f"WITH {_COMPANIES} SELECT id AS company_id, symbol, upper(sector) AS exchange FROM companies",
    "so2_newest_first": f"""WITH {_NEWS} SELECT company_id, url, CAST(row_number() OVER (PARTITION BY company_id ORDER BY CAST(published_at AS DATE) DESC NULLS FIRST, url) AS INT) AS place FROM (SELECT company_id, published_at, url || '/' || event_id AS url FROM news)""",
    "so3_universe_by_symbol": f"WITH {_SECURITIES} SELECT symbol, exchange FROM securities",
    "so4_fiscal_dates": f"WITH {_STATEMENTS} SELECT company_id AS cik, fiscal_date FROM statements",
    "so9_first_articles": f"WITH {_NEWS} SELECT company_id, event_id, title FROM news QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY event_id) <= 3",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
