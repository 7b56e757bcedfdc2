"""Insert-only syncs of feeds that arrive as files: each micro-batch is one sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.reconcile import staged_rows
from ..sources.store import append_batch, appended


def sync_stream(incoming: DataFrame, table: str, keys: list[str], valid: Column, batch: str, checkpoint: str, first_by: Column | None = None) -> StreamingQuery:
    """Appends the new valid rows of each micro-batch to the table at ``table``, begun by ``append_batch`` (as batch -1).

    A micro-batch is a batch of the table. One that is tried again, wherever it broke off, replaces what it left. Rows of
    one ``batch`` are judged together within a micro-batch only. Duplicates raise without ``first_by``.
    """

    def run(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        known = appended(spark, table, without=number)
        append_batch(staged_rows(known, rows, keys, valid, batch, first_by), table, number)

    return incoming.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
