"""Daily bars from the given tables: symbols are brands, days are ship dates, prices are prices of one unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rows.groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").cast("long").alias("volume"),
    )


#: The same bars in SQL, with rn, the row's place in its series from 0.
SQL = """bars AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn FROM (
    SELECT p_brand AS symbol, l_shipdate AS date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, ord) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM (SELECT *, l_extendedprice / l_quantity AS price,
            row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord
          FROM lineitem JOIN part ON l_partkey = p_partkey)
    GROUP BY ALL))"""


def tape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders with the symbol and the date of their bar in the tape."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = (1000 + F.col("l_extendedprice") / 1000).alias("price")
    return items.select(F.col("l_returnflag").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("date"), price, "l_tax", "l_discount", "l_quantity")


def tape_bars(lines: DataFrame, *keys: str) -> DataFrame:
    """Bars of the tape, grouped by more keys as well."""
    price = F.col("price")
    rows = lines.groupBy("symbol", "date", *keys).agg(
        F.min(price).alias("open"), F.max(price * (1 + F.col("l_tax"))).alias("high"), F.min(price * (1 - F.col("l_discount"))).alias("low"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )
    return rows.withColumn("close", (F.col("high") + 3 * F.col("low")) / 4)


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three long series: the lines of orders as bars of their return flag, in the order of orders and line numbers."""
    return tape_bars(tape_lines(spark, sf_dir))


TAPE_SQL = """bars AS MATERIALIZED (
  SELECT *, (high + 3 * low) / 4 AS close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn FROM (
    SELECT l_returnflag AS symbol, l_orderkey * 10 + l_linenumber AS date, min(price) AS open,
      max(price * (1 + l_tax)) AS high, min(price * (1 - l_discount)) AS low, CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM (SELECT *, 1000 + l_extendedprice / 1000 AS price FROM lineitem) GROUP BY ALL))"""
