"""Embedding near-duplicates by random-hyperplane sign hashing (operator 7).

Equal vectors are one class with a count. Each class gets one bit for the side of each of many random planes;
``bits`` of them are a bucket number, in several tables. Both follow from the number of classes and the
threshold: buckets keep about ``per_bucket`` rows, and there are as many tables as a pair at the threshold needs
to meet in one of them with the chance ``recall``. Pairs that meet are verified by their exact cosine in double
precision, and counted in the first table they meet in. Buckets with over ``block`` rows are cut into blocks, and
pairs of blocks are tasks of their own, so that no task holds a whole large bucket.

A class travels once a table with its vector, as 32-bit floats where these hold it exactly, and without its other
bucket numbers: the task that finds a link computes those of its two ends again. Planes and vectors are rounded to
integers whose projections are exact sums, so that every task finds the same side of a plane.

A task returns the numbers of links and a spanning forest of them, not the pairs. Components come from the forests.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. So do rows without
vec_id; they have no component and are kept. Vectors of different lengths don't link. Rows that share a vec_id
count as one vector. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import saved, width
from ._words import released
from .components import connected_components, forest

SEED = 20


def plan(classes: int, threshold: float, recall: float = 0.995, per_bucket: int = 64) -> tuple[int, int]:
    """Bits of a bucket number and the number of tables."""
    bits = min(31, max(4, math.ceil(math.log2(max(classes, 1) / per_bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _doubles(raw: list[bytes], size: int) -> np.ndarray:
    """Vectors of ``size`` components, stored as 32-bit or 64-bit floats, as rows of doubles."""
    x = np.empty((len(raw), size))
    for k, v in enumerate(raw):
        x[k] = np.frombuffer(v, np.float32 if len(v) == 4 * size else np.float64)
    return x


def _planes(longest: int, number: int) -> np.ndarray:
    return np.rint(np.random.default_rng(SEED).standard_normal((longest, number)) * 1024)


def _codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """A bucket number a table, for each row. The sums are of integers below 2**53, hence the same in any order."""
    whole = np.rint(x / np.abs(x).max(1, keepdims=True) * (1 << 20))
    side = whole @ planes[: x.shape[1]] > 0
    return (side.reshape(len(x), -1, bits) * (1 << np.arange(bits))).sum(2).astype(np.int32)


@released
def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, the number of components and the vector in the shortest floats that hold it, of vectors that can link."""
    for batch in batches:
        lists = batch.column(1)
        ids, rows, raw = batch.column(0), [], []
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        ends = np.cumsum(size)
        finite = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        for k, (a, b) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
            if b == a or finite[a] != finite[b] or not (v := values[a:b] + 0.0).any():
                continue
            with np.errstate(over="ignore"):
                if not 1e-200 < v @ v < 1e200:  # a power of two changes no cosine, and squares stay in range
                    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0
            with np.errstate(over="ignore", under="ignore"):
                short = v.astype(np.float32)
            rows.append(k)
            raw.append((short if (short == v).all() else v).tobytes())
        size = pa.array(size[rows].astype(np.int32))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), size, pa.array(raw, pa.binary())], ["vec_id", "size", "vector"])


def _signs(bits: int, tables: int, longest: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(longest, bits * tables)
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                size, raw = batch.column(2).to_numpy(), batch.column(3).to_pylist()
                codes = np.zeros((len(raw), tables), np.int32)
                for n in np.unique(size):
                    at = np.flatnonzero(size == n)
                    codes[at] = _codes(_doubles([raw[i] for i in at], n), planes, bits)
                take = pa.array(np.repeat(np.arange(len(raw)), tables))
                table = np.tile(np.arange(tables, dtype=np.int32), len(raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table), pa.array(codes.ravel()), *[batch.column(k).take(take) for k in (2, 0, 1, 3)]],
                    ["table", "code", "size", "id", "n", "vector"],
                )

    return run


def _pairs(threshold: float, bits: int, tables: int, longest: int):
    """Rows sorted by bucket and pair of blocks in; (a, b, null) for a forest of the links, (a, null, links) out."""

    def first_met(a: np.ndarray, b: np.ndarray, x: np.ndarray, table: int, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (a, b) of rows of ``x`` that meet in no table before this one."""
        if not table or not len(a):
            return a, b
        ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = _codes(x[ends], planes[:, : bits * table], bits)
        left, right = at[: len(a)], at[len(a) :]
        for k in range(table):
            apart = codes[left, k] != codes[right, k]
            left, right = left[apart], right[apart]
        return ends[left], ends[right]

    def links(parts: list[pa.RecordBatch], planes: np.ndarray) -> pa.RecordBatch | None:
        group = pa.Table.from_batches(parts)
        if group.num_rows < 2:
            return None
        ids, n = group["id"].to_numpy(), group["n"].to_numpy()
        block, one, other = (group[c].to_numpy() for c in ("block", "one", "other"))
        x = _doubles(group["vector"].to_pylist(), group["size"][0].as_py())
        norm = np.sqrt((x * x).sum(1))
        left = np.arange(len(ids)) if one[0] == other[0] else np.flatnonzero(block == one[0])
        right = np.arange(len(ids)) if one[0] == other[0] else np.flatnonzero(block == other[0])
        a, b = np.nonzero(x[left] @ x[right].T / (norm[left][:, None] * norm[right]) >= threshold)
        a, b = left[a], right[b]
        if one[0] == other[0]:
            a, b = a[a < b], b[a < b]
        a, b = first_met(a, b, x, group["table"][0].as_py(), planes)
        if not len(a):
            return None
        count = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
        at = np.flatnonzero(count)
        nodes, roots = forest(ids[a], ids[b])
        far = nodes != roots
        first = np.concatenate([nodes[far], ids[at]])
        root = pa.array([*roots[far].tolist(), *[None] * len(at)], pa.int64())
        number = pa.array([*[None] * int(far.sum()), *count[at].astype(np.int64).tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(first), root, number], ["a", "b", "links"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(longest, bits * tables)
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("table", "code", "size", "one", "other")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if first == end:
                    continue
                if held and tuple(key[:, first]) != last:
                    if (found := links(held, planes)) is not None:
                        yield found
                    held = []
                held.append(batch.slice(first, end - first))
                last = tuple(key[:, first])
        if held and (found := links(held, planes)) is not None:
            yield found

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = 1024, recall: float = 0.995) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.where("vec_id is not null").mapInArrow(_valid, "vec_id long, size int, vector binary")
    named = F.concat(F.encode(F.concat(F.col("size").cast("string"), F.lit(":")), "UTF-8"), "vector")
    valid = valid.withColumn("print", F.sha2(named, 256))
    one = [F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n"), F.first("size").alias("size"), F.first("vector").alias("vector")]
    classes = saved(valid.groupBy("print").agg(*one))
    found = classes.agg(F.count("*"), F.max("size")).first()
    cut = (*plan(found[0], threshold, recall), found[1] or 0)
    signed = classes.select("id", "n", "size", "vector").mapInArrow(_signs(*cut), "table int, code int, size int, id long, n long, vector binary")
    bucket = ["table", "code", "size"]
    large = signed.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    placed = signed.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*bucket, "one", "other"]
    placed = placed.select("*", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other")).drop("blocks", "with")
    pairs = saved(placed.repartition(width(spark), *key).sortWithinPartitions(*key).mapInArrow(_pairs(threshold, *cut), "a long, b long, links long"))
    linked = pairs.where("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    components = connected_components(pairs.where("b is not null")).withColumnRenamed("node", "id")
    known = classes.drop("size", "vector").join(linked, "id", "left").join(components, "id", "left")
    known = known.select("print", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.least("component", "id").alias("component_id"))
    named = valid.select("vec_id", "print").distinct().join(known, "print").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(named, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings`` at a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
