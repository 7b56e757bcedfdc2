"""Session helpers of the llm operators: the shared folder, saved intermediate tables, shuffle width."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where that is unset on a local master (tests, a laptop) a temporary folder is made and set; on a cluster it
    raises, since executors would not see each other's files.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; nothing can be removed through it any more
        return


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lost executors repeat nothing above it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a saved table, and lets Spark remove the shuffle files of frames that nothing refers to any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, path)
    gc.collect()
    df.sparkSession._jvm.java.lang.System.gc()


#: Bytes and rows of an Arrow batch on its way to Python: rows are whole texts, so rows alone bound nothing.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; smaller bounds that it has already stay."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).lower().rstrip("b")
        value = int(re.sub(r"\D", "", now) or 0) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
        if value <= 0 or value > most:
            spark.conf.set(key, str(most))


def width(spark: SparkSession) -> int:
    """The number of partitions that a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
