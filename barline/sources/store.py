"""Stored tables: bars in buckets, appends that can be repeated, merges that rewrite only what a feed touches, and
filters of stored keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``. Only on a local master that names none
    it is a temporary folder of this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        named = tempfile.mkdtemp(prefix="barline-")
    return f"{named}/barline-{uuid.uuid4().hex}"


# Bars in buckets


def store_bars(bars: DataFrame, table: str, buckets: int) -> None:
    """Saves bars as a table in buckets of symbols, each one file that is sorted by symbol and date.

    Windows by symbol over it need no shuffle, and the bars of one symbol are read from one bucket.
    """
    dealt = bars.repartition(buckets, "symbol").sortWithinPartitions("symbol", "date")
    dealt.write.bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(table)


def stored_bars(spark: SparkSession, table: str, symbol: str | None = None) -> DataFrame:
    """Stored bars of all symbols, or of one in the order of dates with their ``place`` from 1."""
    bars = spark.table(table)
    if symbol is None:
        return bars
    one = bars.where(F.col("symbol") == symbol)
    return one.withColumn("place", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY date)")).orderBy("date")


# Appends that can be repeated


def append_batch(rows: DataFrame, path: str, batch: int, *measures: Column) -> dict[str, int]:
    """Writes ``rows`` as batch number ``batch`` of the table at ``path``, in place of what an earlier try left of it.

    The batch is one partition that is overwritten by itself: other batches stay, and a batch that is tried again after
    a failure at any point is there once. Returns the number of rows and other observed ``measures``, all from the job
    that writes.
    """
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *measures)
    out = rows.withColumn("batch", F.lit(batch).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    if not seen.get["rows"]:  # a write without rows overwrites no partition
        left = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}")
        left.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(left, True)
    return seen.get


def appended(spark: SparkSession, path: str, without: int | None = None) -> DataFrame:
    """The rows of all batches at ``path``, or of all but one."""
    rows = spark.read.option("basePath", path).parquet(path)
    return (rows if without is None else rows.where(F.col("batch") != without)).drop("batch")


# Merges into stored tables


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store_keyed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Saves a table in partitions by a hash of its key, for ``merge_stored``."""
    made = rows.withColumn("bucket", _bucket(key, buckets)).repartition(buckets, "bucket")
    made.write.partitionBy("bucket").parquet(path)


def keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge_stored(spark: SparkSession, path: str, key: str, buckets: int, feed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Merges a feed into a table of ``store_keyed`` and returns the buckets that it rewrote.

    Only buckets that hold a key of the feed are read, given to ``merge(stored, feed)`` and rewritten; the files of the
    others stay as they are. ``merge`` decides by key, so that a merge that broke off can be run again.
    """
    touched = sorted(r[0] for r in feed.select(_bucket(key, buckets)).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    made = merge(stored, feed).withColumn("bucket", _bucket(key, buckets)).repartition(len(touched), "bucket")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


# Filters of stored keys

#: Bits of one stretch of a filter, as Spark's bitmap functions cut them.
_STRETCH = 32_768


def _marks(keys: list[str], bits: int, hashes: int) -> Column:
    """The places of a row's key in a filter of ``bits`` bits."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(bits)) for k in range(hashes)])


def key_filter(stored: DataFrame, keys: list[str], bits: int, hashes: int = 4) -> DataFrame:
    """A Bloom filter of the keys of a stored table as rows (stretch, bitmap), to be kept beside it. Ten bits a key let
    about 1 in 80 unknown keys through."""
    marks = stored.select(F.explode(_marks(keys, bits, hashes)).alias("mark"))
    placed = marks.select(F.bitmap_bucket_number("mark").alias("stretch"), F.bitmap_bit_position("mark").alias("bit"))
    return placed.groupBy("stretch").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, (bit % 8).cast("int")) == 1


def surely_new(incoming: DataFrame, keys: list[str], known: DataFrame, bits: int, hashes: int = 4) -> DataFrame:
    """``incoming`` with ``surely_new``: true where the filter ``known`` shows that no stored row has the key."""
    asked = incoming.select(*keys).distinct()
    marks = asked.select(*keys, F.explode(_marks(keys, bits, hashes)).alias("mark"))
    placed = marks.select(*keys, F.bitmap_bucket_number("mark").alias("stretch"), F.bitmap_bit_position("mark").alias("bit"))
    met = placed.join(known, "stretch", "left").select(*keys, F.coalesce(_set(F.col("bitmap"), F.col("bit")), F.lit(False)).alias("met"))
    judged = met.groupBy(*keys).agg((~F.bool_and("met")).alias("surely_new")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return incoming.join(judged, same).drop(*[f"__{k}" for k in keys])


def new_rows_of(incoming: DataFrame, stored: DataFrame, keys: list[str], part: str, known: DataFrame, bits: int) -> DataFrame:
    """The rows of ``incoming`` whose key is not stored, as the anti join gives them.

    Rows that the filter shows to be new skip the join. For the others only those partitions of ``stored`` (by the column
    ``part``, which ``incoming`` has as well and the key determines) are read that can hold them.
    """
    judged = surely_new(incoming, keys, known, bits)
    others = judged.where("not surely_new")
    parts = [r[0] for r in others.select(part).distinct().collect()]  # no more than there are partitions
    kept = others.join(stored.where(F.col(part).isin(parts)).select(*keys), keys, "left_anti")
    return judged.where("surely_new").unionByName(kept).drop("surely_new")
