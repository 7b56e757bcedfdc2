"""Document fingerprints by SimHash, and the search within a Hamming radius (operator 12).

The terms of a text are its distinct words and its distinct shingles of five words (a shorter text is one
shingle). A word weighs 1, and 1 more for each doubling of its count up to 4; a shingle weighs 1. Every term has a
hash of 128 bits and votes with its weight for or against each bit; the fingerprint is the sign of the votes, as
32 hex digits. Votes are whole numbers, so that equal texts have equal fingerprints wherever they are counted.

The search cuts fingerprints into blocks. Two that differ in at most ``radius`` bits agree in at least
``spare + 1`` of ``radius + 1 + spare`` blocks, so that a table for every choice of so many blocks, sorted by
those blocks, finds all of them; each pair is counted in the first table where it meets. Keys that hold many
fingerprints are salted.

Texts that are null or have no word have the fingerprint of zeros. Extra columns stay, but for those that are
named as new ones.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bounded_batches, saved, width
from ._words import mix, released, sequence_hashes, slices, words

BITS, SHINGLE, MOST_WEIGHT = 128, 5, 4
_U = np.uint64
#: The bits of every byte value, as +1 and -1, the highest first.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def _terms(h: np.ndarray, row: np.ndarray, weigh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, hash) of terms that are ordered by row, and their weights."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    weight = np.minimum(np.frexp(count.astype(np.float64))[1], MOST_WEIGHT) if weigh else np.ones(len(at), np.int64)
    return h[at], row[at], weight


def simhash(column: pa.Array, most: int = 1 << 16) -> np.ndarray:
    """Fingerprints of texts as rows of 16 bytes."""
    rows = len(column)
    w = words(column)
    h = w.hashes()
    n = np.diff(w.first)
    parts = [_terms(h, w.row, True)]
    if len(h) >= SHINGLE:
        s = sequence_hashes(h, SHINGLE)
        inside = w.row[: len(s)] == w.row[SHINGLE - 1 :]
        parts.append(_terms(s[inside] ^ _U(SHINGLE), w.row[: len(s)][inside], False))
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        whole = [sequence_hashes(h[w.first[k] : w.first[k + 1]], int(n[k]))[0] ^ _U(SHINGLE) for k in few.tolist()]
        parts.append(_terms(np.array(whole, np.uint64), few, False))
    votes = np.zeros((rows, BITS))
    for h, row, weight in parts:
        for first in range(0, len(h), most):
            at = slice(first, first + most)
            low, high = int(row[at][0]), int(row[at][-1]) + 1
            lanes = np.stack([mix(h[at] + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(1, BITS // 64 + 1)], 1)
            byte = lanes.astype("<u8").view(np.uint8).reshape(len(lanes), BITS // 8)
            # weights of each byte value at each place of each row, then the votes that the value casts
            place = (row[at] - low)[:, None] * (BITS // 8) + np.arange(BITS // 8)
            sums = np.bincount((place * 256 + byte).ravel(), np.repeat(weight[at], BITS // 8), (high - low) * BITS // 8 * 256)
            votes[low:high] += (sums.reshape(-1, 256) @ _SIGNS).reshape(high - low, BITS)
    return np.packbits(votes > 0, axis=1)


def _hexed(prints: np.ndarray) -> pa.Array:
    text = prints.tobytes().hex()
    return pa.array([text[k : k + BITS // 4] for k in range(0, len(text), BITS // 4)], pa.string())


def _simhashes(column: pa.Array) -> np.ndarray:
    """As ``simhash``, about half a megabyte of text at a time."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    return np.concatenate([simhash(part.column(0)) for part in slices(batch)] or [np.zeros((0, BITS // 8), np.uint8)])


def _likeness(a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pa.array(1 - np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / BITS, pa.float64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``, 32 hex digits, of every whole text."""
    bounded_batches(docs.sparkSession)
    base = docs.drop("fingerprint")
    at = base.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _hexed(_simhashes(batch.column(at)))], names)

    schema = T.StructType([*base.schema.fields, T.StructField("fingerprint", T.StringType())])
    names = schema.names
    return base.mapInArrow(run, schema)


def blocks(classes: int, radius: int, per_key: int = 256) -> list[tuple[int, ...]]:
    """The choices of blocks that are a table's key, each with the borders of all blocks in front.

    Without spare blocks there are ``radius + 1`` tables; spare ones are added until a key of evenly spread
    fingerprints holds ``per_key`` of them or fewer.
    """
    if not 0 <= radius < BITS // 4:
        raise ValueError(f"the radius must be from 0 to {BITS // 4 - 1}")
    spare = 0
    while spare < 3 and classes / 2 ** (BITS * (spare + 1) // (radius + 1 + spare)) > per_key:
        spare += 1
    return list(itertools.combinations(range(radius + 1 + spare), spare + 1))


def _keys(tables: list[tuple[int, ...]]):
    """(high, low, n) as one row for each table: table, the chosen blocks as one hash, and the row itself."""
    n_blocks = max(max(t) for t in tables) + 1
    edges = [BITS * k // n_blocks for k in range(n_blocks + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                lanes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype(">i8")
                bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.uint64)
                values = []
                for a, b in itertools.pairwise(edges):
                    value = np.zeros(len(bits), np.uint64)
                    for k in range(a, b):
                        value = value * _U(2) + bits[:, k]
                    values.append(value)
                for k, chosen in enumerate(tables):
                    key = np.zeros(len(bits), np.uint64)
                    for c in chosen:
                        key = mix(key + values[c] + _U(1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), k, np.int32)), pa.array(key.view(np.int64)), *batch.columns], ["table", "key", *whole.schema.names])

    return run


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = 6, hot: int = 2000) -> DataFrame:
    """For each distinct ``fingerprint`` of ``queries`` the rows of ``prints`` whose own is at most ``radius`` bits away.

    Returns (fingerprint, n_equal, n_near, nearest): rows with the same fingerprint, rows with another one within
    the radius, and the least distance to those, null without any. Every such row is counted, whatever its key
    holds. Null fingerprints are near none. Keys of over ``hot`` fingerprints are dealt to several tasks by salt.
    """
    spark = prints.sparkSession
    lane = lambda k: F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("long")
    made = [lane(0).alias("high"), lane(1).alias("low")]
    classes = saved(prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")).select(*made, "n"))
    asked = saved(queries.where("fingerprint is not null").select("fingerprint", *made).distinct())
    tables = blocks(classes.count(), radius)
    kind = "table int, key long, high long, low long, n long"
    stored = classes.mapInArrow(_keys(tables), kind)
    wanted = asked.select("high", "low", F.lit(0).cast("long").alias("n")).mapInArrow(_keys(tables), kind).drop("n")
    wanted = wanted.withColumnsRenamed({"high": "q_high", "low": "q_low"})
    large = saved(stored.groupBy("table", "key").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    stored = stored.join(large, ["table", "key"], "left").withColumn("part", F.pmod(F.xxhash64("high", "low"), parts).cast("int")).drop("parts")
    wanted = wanted.join(large, ["table", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    differ = F.bit_count(F.col("high").bitwiseXOR(F.col("q_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("q_low")))
    pairs = wanted.join(stored, (differ <= radius) & (differ > 0) & (wanted["table"] == stored["table"]) & (wanted["key"] == stored["key"]) & (wanted["part"] == stored["part"]))
    first = F.min(wanted["table"]).alias("table")  # a pair that meets in several tables is one
    once = pairs.groupBy("q_high", "q_low", "high", "low").agg(first, F.first("n").alias("n"), F.first(differ).alias("distance"))
    near = once.groupBy("q_high", "q_low").agg(F.sum("n").alias("n_near"), F.min("distance").cast("int").alias("nearest"))
    same = classes.withColumnsRenamed({"high": "q_high", "low": "q_low", "n": "n_equal"})
    out = asked.withColumnsRenamed({"high": "q_high", "low": "q_low"}).join(same, ["q_high", "q_low"], "left").join(near, ["q_high", "q_low"], "left")
    return out.select("fingerprint", F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "nearest")


def _edited(texts: list[str], following: list[str]) -> list[str]:
    return [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, kind string, text string"


@released
def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order in; the rows that have a next one in their partition, and the first and the last text of it.

    The text that waits for its next one is all that is kept from batch to batch.
    """
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _EDITED.split(", ")]
    waiting: pa.RecordBatch | None = None
    for whole in batches:
        for batch in slices(whole):
            if not batch.num_rows:
                continue
            if waiting is None:
                yield _edge(batch.slice(0, 1), part, "first", names)
            else:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows > 1:
                yield pa.RecordBatch.from_arrays([*_judged(batch), *_empty(batch.num_rows - 1)], names)
            waiting = pa.RecordBatch.from_pylist(batch.slice(batch.num_rows - 1).to_pylist(), batch.schema)
    if waiting is not None:
        yield _edge(waiting, part, "last", names)


def _judged(batch: pa.RecordBatch) -> list[pa.Array]:
    """Of (doc_id, text) in order the results of all rows but the last."""
    texts = batch.column(1).fill_null("").to_pylist()
    edited = pa.array(_edited(texts[:-1], texts[1:]), pa.large_string())
    own, changed = _simhashes(pa.array(texts, pa.large_string())), _simhashes(edited)
    return [batch.column(0).slice(0, len(edited)), pa.array([len(t) for t in texts[:-1]], pa.int64()), _sha256(edited), _hexed(own[:-1]), _hexed(changed), _likeness(own[:-1], changed), _likeness(own[:-1], own[1:])]


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def _empty(rows: int) -> list[pa.Array]:
    return [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.string())]


def _edge(row: pa.RecordBatch, part: int, kind: str, names: list[str]) -> pa.RecordBatch:
    blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([row.column(0), *blank, pa.array([part], pa.int32()), pa.array([kind]), row.column(1).fill_null("").cast(pa.string())], names)


def _pairs_of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, following) with their results."""
    names = [c.split()[0] for c in _EDITED.split(", ")][:7]
    for batch in batches:
        for k in range(batch.num_rows):
            both = pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * 2, pa.int64()), pa.array([batch.column(c)[k].as_py() for c in (1, 2)], pa.large_string())], ["doc_id", "text"])
            yield pa.RecordBatch.from_arrays(_judged(both), names)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they are, for each row of ``docs`` (doc_id, text).

    Rows are in the order of doc_id (those without come first), of hash and text among equal ones; the next of the
    last is the first. The edited text ends with the beginning of the next one, as long as half of the text. Texts
    are moved once, by ranges of that order; a partition's last text meets the first one of the next partition.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order: list[Column | str] = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(width(spark), *order).sortWithinPartitions(*order, "text")
    made = saved(ranged.select("doc_id", "text").mapInArrow(_with_next, _EDITED))
    result = [c.split()[0] for c in _EDITED.split(", ")][:7]
    # which partitions have rows is a few bytes each; their texts stay with the executors
    parts = sorted(r[0] for r in made.where("kind = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    heads = made.where("kind = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    edges = made.where("kind = 'last'").select("doc_id", "text", "part").join(after, "part").join(heads, "after")
    edges = edges.select("doc_id", "text", "following").mapInArrow(_pairs_of_edges, ", ".join(_EDITED.split(", ")[:7]))
    return made.where("kind is null").select(*result).union(edges)


def op12_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their edited texts; for each doc_id that 100 divides also how many other
    documents have its fingerprint (n_equal) or one within 6 of 128 bits (n_near). For the others these are null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = saved(edited_fingerprints(docs))
    near = near_fingerprints(made.select("fingerprint"), made.where("doc_id % 100 = 0").select("fingerprint"))
    near = near.select("fingerprint", (F.col("n_equal") - 1).alias("n_equal"), "n_near", "nearest")
    asked = made.where("doc_id % 100 = 0").join(near, "fingerprint", "left")
    others = made.where("doc_id % 100 != 0 or doc_id is null").select("*", F.lit(None).cast("long").alias("n_equal"), F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("int").alias("nearest"))
    return others.unionByName(asked.select(*others.columns))
