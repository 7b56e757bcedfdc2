"""Hierarchical best-fit packing of token sequences (operator 8).

Each partition packs its own pieces best-fit decreasing. Bins that are nearly full are emitted. Of the rest a
partition passes up the bins that are at most half full (best fit leaves one of these at most, since two would
share a bin) and the emptiest few others as hosts for them. A tree of merges then packs what neighbours passed up, bins
as items, until one node is left. A node passes on a constant number of bins, so that the root is as small
over 100 TB as over 1 GB; nothing is lost, since a bin that is not passed up is emitted as it is.

Null texts are empty texts and hold the end id only. Texts of any length are cut into pieces. Special tokens of the
vocabulary that stand in a text count as such, as the library has it. Repeated rows are packed once each. An empty
table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bounded_batches, saved
from ._words import released, slices, strings
from .byte_bpe import codec, default_paths

#: Bins with at most this share of room left are emitted at once.
NEARLY_FULL = 0.01
#: Bins over half full that a node passes up as hosts, and how many nodes one merge joins.
HOSTS, FAN_IN = 16, 8


def cut_pieces(docs: DataFrame, size: int = 1024, end: int = 2, path: str | None = None) -> DataFrame:
    """The ids of each document and the end id, in pieces of at most ``size`` ids.

    Returns doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit). Only documents
    longer than ``size`` are cut; all their pieces are full but the first, which has what is left over.
    """
    bounded_batches(docs.sparkSession)
    path = path or default_paths()[0]
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids", T.BinaryType())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, special=True)
        for whole in batches:
            for batch in slices(whole):
                found, places = use.encode(batch.column(1))
                rows = np.arange(batch.num_rows)
                total = np.diff(places) + 1
                ids = np.full(len(found) + len(rows), end, "<u4")
                ids[np.arange(len(found)) + np.repeat(rows, total - 1)] = found
                pieces = -(-total // size)
                row = np.repeat(rows, pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = total - (pieces - 1) * size
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                length = np.where(piece == 0, first[row], size)
                parts = strings(ids.view(np.uint8), 4 * np.concatenate([[0], np.cumsum(length)])).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), parts], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit f: there is a bin with f free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if fits := some >> s:
            free = s + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
            bins[b].append(i)
        else:
            free, b = room, len(bins)
            bins.append([i])
        if free > s:
            by_free[free - s].append(b)
            some |= 1 << (free - s)
    return bins


def _pack_node(room: int, last: bool):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if table is None or table.num_rows == 0:
            return
        sizes = table["fill"].to_numpy()
        members = table["members"].combine_chunks() if table["members"].num_chunks != 1 else table["members"].chunk(0)
        flat, places = members.flatten(), members.offsets.to_numpy() - members.offsets[0].as_py()
        bins = best_fit(sizes, room)
        fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        done = fill >= room * (1 - NEARLY_FULL)
        if last:
            done[:] = True
        else:
            hosts = np.flatnonzero(~done & (2 * fill > room))
            done[hosts[np.argsort(fill[hosts], kind="stable")][HOSTS:]] = True
        order = np.array([i for b in bins for i in b], np.int64)
        begins = np.cumsum(sizes[order]) - sizes[order] - np.repeat(np.cumsum(fill) - fill, [len(b) for b in bins])  # of each item in its bin
        counts = np.diff(places)[order]
        rows = np.arange(counts.sum()) + np.repeat(places[:-1][order] - (np.cumsum(counts) - counts), counts)
        taken = flat.take(pa.array(rows))
        offset = taken.field("offset").to_numpy() + np.repeat(begins, counts)
        fields = [f.name for f in taken.type]
        values = pa.StructArray.from_arrays([pa.array(offset, pa.int64()) if f == "offset" else taken.field(f) for f in fields], fields)
        held = np.cumsum([0, *np.add.reduceat(counts, np.cumsum([0, *map(len, bins)])[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(fill), pa.array(done), pa.ListArray.from_arrays(pa.array(held, pa.int32()), values)], ["fill", "done", "members"])

    return run


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (any columns, with a long ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``.

    Sequences have at most ``size`` ids and no gaps. Pieces of full length are sequences of their own.
    """
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*carried)
    full = pieces.where(F.col("length") == size).select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    item = F.struct(*carried, F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < size).select(F.col("length").alias("fill"), F.array(item).alias("members"))
    schema = T.StructType([items.schema["fill"], T.StructField("done", T.BooleanType()), items.schema["members"]])
    nodes, finished = items.rdd.getNumPartitions(), []
    while True:
        level = saved(items.mapInArrow(_pack_node(size, nodes == 1), schema))
        finished.append(level.where("done").select("members"))
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
        items = level.where("not done").select("fill", "members").coalesce(nodes)
    bins = finished[0]
    for more in finished[1:]:
        bins = bins.unionByName(more)
    bins = bins.select("members", (F.monotonically_increasing_id() * 2).alias("sequence_id"))
    bins = bins.select("sequence_id", F.explode("members").alias("m"))
    return bins.select(*[F.col(f"m.{c}").alias(c) for c in carried], "sequence_id", "m.offset").unionByName(full)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` packed into sequences of at most 1024 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents with a checksum of their ids, packed."""
    pieces = cut_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(saved(pieces))
