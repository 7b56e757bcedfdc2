"""Queries over stored tables that are written from the given ones, and their SQL."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators, reconcile
from ..sources import payloads, store
from . import bars, indicator_sql
from .tables import _companies, _read, _stored_days

_BARS = "WITH " + bars.SQL


def _table(spark: SparkSession, sf_dir: str) -> str:
    """Daily bars as a table in buckets, dropped when the program ends."""
    name = f"barline_{uuid.uuid4().hex}"
    store.store_bars(bars.daily_bars(spark, sf_dir), name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    atexit.register(_drop, spark, name)
    return name


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def src1_bucketed_panel(spark, sf_dir):
    """Three indicators over stored bars, without a shuffle."""
    panel = indicators.rsi(indicators.ema(indicators.sma(store.stored_bars(spark, _table(spark, sf_dir)))))
    shown = [(F.floor(F.col(c) * 10000 + 0.5) / 10000.0).alias(c) for c in ("sma", "ema", "rsi")]
    return panel.select("symbol", "date", *shown)


def src1_symbol_prices(spark, sf_dir):
    """The stored bars of one symbol in the order of dates: one symbol is the feature."""
    return store.stored_bars(spark, _table(spark, sf_dir), "Brand#11").select("place", "date", "close", "volume")


def src2_bar_files(spark, sf_dir):
    """Bars by way of files with the provider's column names."""
    folder = store.work_folder(spark)
    days = bars.daily_bars(spark, sf_dir)
    named = days.select("symbol", *[F.col(n).alias(c) for c, n in payloads.BARS.items() if n in days.columns])
    named.write.option("header", True).csv(folder)
    return payloads.read_bars(spark, folder).select("symbol", "date", "open", "high", "low", "close", "volume", "dividends")


def snk1_repeated_batches(spark, sf_dir):
    """Bars in three batches; the second one is tried twice."""
    folder = store.work_folder(spark)
    days = bars.daily_bars(spark, sf_dir).withColumn("number", F.year("date") % 3)
    for number in (0, 1, 1, 2):
        store.append_batch(days.where(F.col("number") == number).drop("number"), folder, number)
    return store.appended(spark, folder).select("symbol", "date", "close", "volume")


def snk5_merged_buckets(spark, sf_dir):
    """Suppliers as stored companies, customers as a feed that is merged into the buckets it touches."""
    folder = store.work_folder(spark)
    store.store_keyed(_companies(spark, sf_dir).select("cik", "name", F.lit("tools").alias("sector")), folder, "cik", 32)
    feed = _read(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("name"))
    store.merge_stored(spark, folder, "cik", 32, feed, reconcile.merge_companies)
    return store.keyed(spark, folder)


def _priced(spark, sf_dir):
    """Bars as incoming prices of symbols in small letters; a low of some brands is broken."""
    days = bars.daily_bars(spark, sf_dir)
    low = F.when(F.col("volume") % 1013 == 0, F.lit(-1.0)).otherwise(F.col("low"))
    return days.select(F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), F.col("date").cast("timestamp").alias("date"), "open", "high", low.alias("low"), "close", "volume")


def mrg4_sync_prices(spark, sf_dir):
    """The whole price sync and its new table: securities are brands, stored prices the days of orders of their parts."""
    brands = _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("id"))
    securities = brands.select(F.upper("p_brand").alias("symbol"), "id")
    known = _stored_days(spark, sf_dir).join(brands, F.col("symbol") == F.col("p_brand"))
    known = known.select(F.col("id").alias("security_id"), F.col("date").cast("timestamp").alias("date"), F.lit(0.0).alias("close"))
    table, _, _ = reconcile.sync_prices(known, _priced(spark, sf_dir), securities)
    return table.select("security_id", F.to_date("date").alias("date"), "close")


def j6_filtered_prices(spark, sf_dir):
    """New bars against stored days in partitions by year, with a filter of the stored keys."""
    folder = store.work_folder(spark)
    days = _stored_days(spark, sf_dir).withColumn("year", F.year("date"))
    days.write.partitionBy("year").parquet(f"{folder}/days")
    stored = spark.read.parquet(f"{folder}/days")
    bits = max(1 << 15, 10 * stored.count())
    store.key_filter(stored, ["symbol", "date"], bits).write.parquet(f"{folder}/filter")
    incoming = bars.daily_bars(spark, sf_dir).withColumn("year", F.year("date"))
    found = store.new_rows_of(incoming, stored, ["symbol", "date"], "year", spark.read.parquet(f"{folder}/filter"), bits)
    return found.select("symbol", "date", "volume")


def bf2_written_listings(spark, sf_dir):
    """Nations as companies, with the listing of their first customer written back."""
    listed = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("company_id"), F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("exchange"))
    held = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).alias("id"), F.col("n_name").alias("symbol"), F.lit("").alias("exchange"))
    return reconcile.write_representatives(held, listed)


def so4_ordered_dates(spark, sf_dir):
    """Fiscal dates of companies in ascending order, numbered."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("fiscal_date")).distinct()
    return o.withColumn("place", F.expr("row_number() OVER (PARTITION BY company_id ORDER BY fiscal_date)"))


_STORED = "stored AS (SELECT DISTINCT p_brand AS symbol, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def oracle_sql() -> dict[str, str]:
    whole = indicator_sql.oracle_sql()
    merged = "SELECT coalesce(a.cik, b.cik) AS cik, coalesce(b.name, a.name) AS name, CASE WHEN a.cik IS NULL THEN '' ELSE 'tools' END AS sector FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS name FROM supplier) a FULL JOIN (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name FROM customer) b ON a.cik = b.cik"
    return {
        "src1_bucketed_panel": f"SELECT symbol, date, sma, ema, rsi FROM ({whole['i01_sma']}) JOIN ({whole['i02_ema']}) USING (symbol, date) JOIN ({whole['i04_rsi']}) USING (symbol, date)",
        "src1_symbol_prices": f"{_BARS} SELECT rn + 1 AS place, date, close, volume FROM bars WHERE symbol = 'Brand#11'",
        "src2_bar_files": f"{_BARS} SELECT symbol, CAST(date AS TIMESTAMP) AS date, open, high, low, close, volume, CAST(0 AS DOUBLE) AS dividends FROM bars",
        "snk1_repeated_batches": f"{_BARS} SELECT symbol, date, close, volume FROM bars",
        "snk5_merged_buckets": merged,
        "mrg4_sync_prices": f"""{_BARS}, {_STORED}, brands AS (SELECT p_brand AS symbol, min(p_partkey) AS id FROM part GROUP BY 1),
  fine AS (SELECT * FROM bars QUALIFY bool_and(volume % 1013 <> 0) OVER (PARTITION BY symbol))
SELECT id AS security_id, CAST(date AS DATE) AS date, CAST(0 AS DOUBLE) AS close FROM stored JOIN brands USING (symbol)
UNION ALL SELECT id, CAST(date AS DATE), close FROM fine JOIN brands USING (symbol) ANTI JOIN stored USING (symbol, date)""",
        "j6_filtered_prices": f"{_BARS}, {_STORED} SELECT symbol, date, volume FROM bars ANTI JOIN stored USING (symbol, date)",
        "bf2_written_listings": """SELECT n_nationkey + 3 AS id, coalesce(symbol, n_name) AS symbol, coalesce(exchange, '') AS exchange FROM nation
LEFT JOIN (SELECT c_nationkey, arg_min(c_name, c_custkey) AS symbol, arg_min(c_mktsegment, c_custkey) AS exchange FROM customer GROUP BY 1) ON c_nationkey = n_nationkey + 3""",
        "so4_ordered_dates": """SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_date) AS place
FROM (SELECT DISTINCT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS fiscal_date FROM orders)""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in oracle_sql()}
