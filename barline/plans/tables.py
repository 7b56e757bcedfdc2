"""Queries of the table jobs over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, lookup, reconcile, validate
from . import bars

_BARS = "WITH " + bars.SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _companies(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


def _universe(spark, sf_dir):
    """Orders as listings of their customers: repeated and in need of cleaning."""
    o = _read(spark, sf_dir, "orders")
    exchange = F.element_at(F.array(*map(F.lit, ("nasdaq", "NYSE ", "OTC", "NYSE ARCA"))), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    return o.select(F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit(" s"), F.col("o_custkey").cast("string"), F.lit("x"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("symbol"), F.concat(F.lit("company "), F.col("o_orderstatus")).alias("name"), exchange.alias("exchange"), F.col("o_orderkey").alias("pos"))


_UNIVERSE = """SELECT CAST(o_custkey AS VARCHAR) AS cik, upper('s' || o_custkey || 'x' || (o_orderkey % 3)) AS symbol, 'company ' || o_orderstatus AS name,
  upper(trim(['nasdaq', 'NYSE ', 'OTC', 'NYSE ARCA'][CAST(o_custkey % 4 + 1 AS INT)])) AS exchange, o_orderkey AS pos FROM orders"""
_LISTED = f"SELECT cik, symbol, arg_max(name, pos) AS name, arg_max(exchange, pos) AS exchange FROM ({_UNIVERSE}) GROUP BY cik, symbol"
_US = "exchange IN ('NASDAQ', 'NYSE', 'NYSE MKT', 'NYSE AMERICAN', 'NYSE ARCA')"


def p2_clean_text(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(clean.clean_text(F.col("text"))).alias("clean_md5"))


def p9_valid_price(spark, sf_dir):
    """Bars with a high under the low, a close that is no number, no date, a negative volume, an infinite open."""
    v = F.col("volume")
    wrong = {"high": (97, F.col("low") - 1), "close": (89, F.lit(float("nan"))), "open": (73, F.lit(float("inf")))}
    b = clean.clean_price(bars.daily_bars(spark, sf_dir)).withColumns({"key": F.col("date"), "seen": v})
    broken = b.withColumns({c: F.when(v % n == 0, x).otherwise(F.col(c)) for c, (n, x) in wrong.items()} | {"date": F.when(v % 83 > 0, F.col("date")), "volume": F.when(v % 79 == 0, F.lit(-1)).otherwise(v)})
    return broken.select("symbol", "key", validate.valid_price().alias("valid"))


def p12_batch_validation(spark, sf_dir):
    b = clean.clean_price(bars.daily_bars(spark, sf_dir)).withColumn("year", F.concat_ws("-", "symbol", F.year("date")))
    broken = b.withColumn("low", F.when(F.col("volume") % 97 == 0, F.lit(-1.0)).otherwise(F.col("low")))
    return validate.reject_invalid_batches(broken, "year", validate.valid_price()).groupBy("year").agg(F.count("*").alias("bars"))


def p13_us_equities(spark, sf_dir):
    u = reconcile.dedupe_universe(reconcile.normalise_universe(_universe(spark, sf_dir)))
    return u.where(validate.is_us_equity(F.col("exchange"))).select("cik", "symbol", "name", "exchange")


def j2_security_company(spark, sf_dir):
    listed = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), (F.col("c_custkey") % 50).alias("company_id"))
    return lookup.with_company(listed.drop("id"), _companies(spark, sf_dir)).select("symbol", "company_id", "name")


def _stored_days(spark, sf_dir):
    """Brands and days of orders of their parts, as bars that are stored already."""
    items = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(F.col("p_brand").alias("symbol"), F.col("o_orderdate").alias("date")).distinct()


_STORED = "stored AS (SELECT DISTINCT p_brand AS symbol, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def j6_new_prices(spark, sf_dir):
    return lookup.new_rows(bars.daily_bars(spark, sf_dir), _stored_days(spark, sf_dir), ["symbol", "date"]).select("symbol", "date", "volume")


def j7_new_news(spark, sf_dir):
    """Turns of conversations as news, labels as stored ones."""
    url = lambda c: F.concat(F.lit("http://c/"), F.col(c).cast("string")).alias("url")
    n = _read(spark, sf_dir, "conversations").select("conv_id", "turn", url("conv_id"))
    return lookup.new_rows(n, _read(spark, sf_dir, "labels").select(url("doc_id")), ["url"])


def j11_listings_of_companies(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return lookup.among(c, _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), ["n_nationkey"])


def j16_without_children(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return lookup.without(c, _read(spark, sf_dir, "events").select(F.col("user_id").alias("k")), ["k"])


def agg1_dedupe_universe(spark, sf_dir):
    return reconcile.dedupe_universe(reconcile.normalise_universe(_universe(spark, sf_dir))).select("cik", "symbol", "name", "exchange")


def agg2_symbol_conflicts(spark, sf_dir):
    u = _universe(spark, sf_dir).withColumn("symbol", F.concat(F.lit("S"), (F.col("pos") % 900).cast("string")))
    return reconcile.symbol_conflicts(u)


def agg3_representatives(spark, sf_dir):
    return reconcile.representatives(agg1_dedupe_universe(spark, sf_dir))


def _facts(spark, sf_dir):
    """Orders as annual facts of customers: status is the form's kind, each year end a fiscal date."""
    o = _read(spark, sf_dir, "orders")
    concept = F.element_at(F.array(*map(F.lit, ("total_revenue", "net_income", "eps"))), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("cik"), concept.alias("concept"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31")).alias("end"), F.col("o_totalprice").alias("val"),
        F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("10-Q").alias("form"), F.lit("FY").alias("fp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.col("o_orderkey").alias("pos"),
    )


def agg8_annual_statements(spark, sf_dir):
    return reconcile.annual_statements(_facts(spark, sf_dir)).select("cik", "fiscal_date", "total_revenue", "net_income", "eps")


def mrg1_companies(spark, sf_dir):
    old = _companies(spark, sf_dir).select("cik", "name", F.lit("tools").alias("sector"))
    feed = _read(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("name"))
    return reconcile.merge_companies(old, feed)


def mrg2_securities(spark, sf_dir):
    """One listing of every customer is stored; the feed has up to three."""
    c = _read(spark, sf_dir, "customer")
    old = c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string"), F.lit("X0")).alias("symbol"), F.col("c_custkey").cast("string").alias("cik"), F.lit("OLD").alias("exchange"), (F.col("c_custkey") + 1).alias("id"))
    return reconcile.merge_securities(old, agg1_dedupe_universe(spark, sf_dir))


def mrg4_price_sync(spark, sf_dir):
    """Bars of whole years that hold no broken one, on days that are not stored."""
    b = clean.clean_price(bars.daily_bars(spark, sf_dir)).withColumn("year", F.concat_ws("-", "symbol", F.year("date")))
    broken = b.withColumn("low", F.when(F.col("volume") % 101 == 0, F.lit(-1.0)).otherwise(F.col("low")))
    _, staged, _ = reconcile.sync_rows(_stored_days(spark, sf_dir), broken, ["symbol", "date"], validate.valid_price(), "year")
    return staged.select("symbol", "date", "volume")


def ic2_duplicates(spark, sf_dir):
    return reconcile.duplicates(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def ic4_orphans(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return reconcile.orphans(o, _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])


def bf2_representative_listing(spark, sf_dir):
    s = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("company_id"), F.col("c_name").alias("symbol"), F.lit("NYSE").alias("exchange"))
    return reconcile.representative_listings(s)


def so7_first_statements(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reconcile.first_of_each(o, "o_custkey", F.struct(F.col("o_totalprice"), F.col("o_orderkey")).desc(), 3)


def so8_latest_bar(spark, sf_dir):
    return lookup.latest(bars.daily_bars(spark, sf_dir)).select("symbol", "date", "volume")


_FACTS = """SELECT o_custkey AS cik, ['total_revenue', 'net_income', 'eps'][CAST(o_orderkey % 3 + 1 AS INT)] AS concept, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS fiscal_date,
  o_totalprice AS val, strftime(o_orderdate, '%Y-%m-%d') AS filed, o_orderkey AS pos FROM orders WHERE o_orderstatus IN ('F', 'O')"""
_VALUE = "arg_max(val, row(filed, -pos)) FILTER (concept = '{0}') AS {0}"

ORACLE: dict[str, str] = {
    "p2_clean_text": r"SELECT doc_id, md5(coalesce(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g')), '')) AS clean_md5 FROM documents",
    "p9_valid_price": f"{_BARS} SELECT symbol, date AS key, volume % 97 <> 0 AND volume % 89 <> 0 AND volume % 73 <> 0 AND volume % 83 <> 0 AND volume % 79 <> 0 AS valid FROM bars",
    "p12_batch_validation": f"{_BARS} SELECT symbol || '-' || year(date) AS year, count(*) AS bars FROM bars GROUP BY 1 HAVING bool_and(volume % 97 <> 0)",
    "p13_us_equities": f"SELECT * FROM ({_LISTED}) WHERE {_US}",
    "j2_security_company": "SELECT 'C' || c_custkey AS symbol, c_custkey % 50 AS company_id, s_name AS name FROM customer JOIN supplier ON s_suppkey = c_custkey % 50",
    "j6_new_prices": f"{_BARS}, {_STORED} SELECT symbol, date, volume FROM bars ANTI JOIN stored USING (symbol, date)",
    "j7_new_news": "SELECT conv_id, turn, 'http://c/' || conv_id AS url FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
    "j11_listings_of_companies": "SELECT c_custkey, c_nationkey AS n_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)",
    "j16_without_children": "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
    "agg1_dedupe_universe": _LISTED,
    "agg2_symbol_conflicts": "SELECT 'S' || (o_orderkey % 900) AS symbol, count(DISTINCT o_custkey) AS n_ciks FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1",
    "agg3_representatives": f"SELECT cik, arg_min(name, symbol) AS name, count(*) AS listings FROM ({_LISTED}) GROUP BY cik",
    "agg8_annual_statements": f"SELECT cik, fiscal_date, {', '.join(_VALUE.format(c) for c in ('total_revenue', 'net_income', 'eps'))} FROM ({_FACTS}) GROUP BY cik, fiscal_date HAVING bool_or(concept = 'total_revenue')",
    "mrg1_companies": "SELECT coalesce(a.cik, b.cik) AS cik, coalesce(b.name, a.name) AS name, CASE WHEN a.cik IS NULL THEN '' ELSE 'tools' END AS sector FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS name FROM supplier) a FULL JOIN (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name FROM customer) b ON a.cik = b.cik",
    "mrg2_securities": f"SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.cik, b.cik) AS cik, coalesce(b.exchange, 'OLD') AS exchange, a.id FROM (SELECT 'S' || c_custkey || 'X0' AS symbol, CAST(c_custkey AS VARCHAR) AS cik, c_custkey + 1 AS id FROM customer) a FULL JOIN ({_LISTED}) b ON a.symbol = b.symbol",
    "mrg4_price_sync": f"{_BARS}, {_STORED} SELECT symbol, date, volume FROM (SELECT * FROM bars QUALIFY bool_and(volume % 101 <> 0) OVER (PARTITION BY symbol, year(date))) ANTI JOIN stored USING (symbol, date)",
    "ic2_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "ic4_orphans": "SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "bf2_representative_listing": "SELECT c_nationkey AS company_id, arg_min(c_name, c_custkey) AS symbol, 'NYSE' AS exchange FROM customer GROUP BY 1",
    "so7_first_statements": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) <= 3",
    "so8_latest_bar": f"{_BARS} SELECT symbol, date, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
