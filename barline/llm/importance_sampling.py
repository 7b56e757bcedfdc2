"""Quality classification by importance resampling (operator 9).

Two generative models over hashed unigrams and bigrams, one of target texts and one of all texts, give each
document a log importance weight: the sum over its n-grams of log(target / raw). After Xie et al. (2023) the
documents with the largest log weight plus Gumbel noise are a sample without replacement by weight.

Noise is a hash of doc_id: the same rows give the same sample. The k-th largest value is found by counting values in
ever narrower ranges, not by sorting all rows.

Tokens are runs of letters and digits, or of other visible characters, lower-cased (ASCII). Texts of any length are
read whole. Null and empty texts have no n-grams, weight 0, and are judged like all others. Rows without doc_id share
one noise value; so do rows that share a doc_id. Rows with equal values at the cut are all kept. Nulls in ``labels``
count as not good. Without target rows all weights are 0; without labels nothing is kept; an empty table gives no rows.
Extra columns stay; columns named n_grams, log_weight, sampling_key or kept are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bounded_batches, saved
from ._words import LOWER, SPACE, mix, released, slices, spans, utf8

#: Hashed n-grams of a model.
SIZE = 1 << 18
_KIND = np.ones(256, np.uint8)  # 0 space, 1 mark, 2 letter or digit
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and the row of each."""
    data, places = utf8(column)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = np.flatnonzero(change | edge[:-1])
    end = np.append(begin[1:], len(data))
    visible = kind[begin] > 0
    begin, end = begin[visible], end[visible]
    row = np.searchsorted(places, begin, "right") - 1
    h = spans(LOWER[data], begin, end)
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    inside = row[:-1] == row[1:]
    return (np.concatenate([h, two[inside]]) % np.uint64(SIZE)).astype(np.int64), np.concatenate([row, row[:-1][inside]])


@released
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, target) in; counts of each n-gram over all rows and over target rows, once a partition."""
    raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for whole in batches:
        for batch in slices(whole):
            gram, row = _grams(batch.column(0))
            raw += np.bincount(gram, minlength=SIZE)
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            target += np.bincount(gram[chosen[row]], minlength=SIZE)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["gram", "raw", "target"])


def fit(docs: DataFrame) -> np.ndarray:
    """log(target / raw) of each hashed n-gram, from all rows of ``docs`` (text, target boolean)."""
    bounded_batches(docs.sparkSession)
    found = docs.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_count, "gram int, raw long, target long")
    found = found.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # SIZE rows
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    raw[found["gram"]], target[found["gram"]] = found["raw"], found["target"]
    if not target.any():
        return np.zeros(SIZE)
    return np.log((target + 1) / (target.sum() + SIZE)) - np.log((raw + 1) / (raw.sum() + SIZE))


def _weigh(ratio: np.ndarray, text_at: int, names: list[str]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                gram, row = _grams(batch.column(text_at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.bincount(row, minlength=batch.num_rows)), pa.array(np.bincount(row, ratio[gram], batch.num_rows).astype(np.float64))], names)

    return run


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with n_grams and log_weight."""
    bounded_batches(docs.sparkSession)
    base = docs.drop("n_grams", "log_weight")
    schema = T.StructType([*base.schema.fields, T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    return base.mapInArrow(_weigh(ratio, base.columns.index("text"), schema.names), schema)


def kth_largest(values: DataFrame, column: str, k: int, few: int = 1000) -> float | None:
    """The k-th largest value of a column, by counting rows in 1024 ranges of the range that holds it."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k <= 0:
        return None
    if k >= n:
        return low
    rest, inside = k, n
    if low == high:
        return low
    while inside > few and high > low:
        step = (high - low) / 1024
        if low + step == low:
            break
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(1023))
        counts = dict(values.where(F.col(column).between(low, high)).groupBy(at.alias("at")).count().collect())
        for b in sorted(counts, reverse=True):
            if rest <= counts[b]:
                break
            rest -= counts[b]
        found = values.where(F.col(column).between(low, high) & (at == b)).agg(F.min(column), F.max(column)).first()
        inside, (low, high) = counts[b], found
    if low == high:
        return low
    top = values.where(F.col(column).between(low, high)).select(column).orderBy(F.desc(column)).limit(rest)
    return top.agg(F.min(column)).first()[0]


def resample(docs: DataFrame, ratio: np.ndarray, share: float, seed: int = 9) -> DataFrame:
    """``docs`` with log_weight, sampling_key and kept: ``share`` of the rows, sampled by weight."""
    base = docs.drop("sampling_key", "kept")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = saved(weights(base, ratio).withColumn("sampling_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("text"))
    cut = kth_largest(keyed, "sampling_key", round(share * keyed.count()))
    return keyed.withColumn("kept", F.col("sampling_key") >= F.lit(cut).cast("double") if cut is not None else F.lit(False))


def mark_targets(docs: DataFrame, targets: DataFrame, n_targets: int, most: int = 1 << 16) -> DataFrame:
    """``docs`` with ``target``: whether ``targets`` (distinct doc_id, ``n_targets`` rows) has the row's doc_id.

    Of more than ``most`` targets about ``most`` are taken, those with the smallest hashes of doc_id. So the side
    that is broadcast is bounded, and no text is shuffled to meet its label.
    """
    if n_targets > most:
        targets = targets.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) < int(most / n_targets * (1 << 52)))
    chosen = targets.select("doc_id", F.lit(True).alias("target"))
    return docs.drop("target").join(F.broadcast(chosen), "doc_id", "left")


def op9_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A sample of ``documents`` like the labelled good ones (quality 1, not toxic), as large as their share of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("target"))
    n_labelled, n_good = labelled.agg(F.count("*"), F.count_if("target")).first()
    marked = mark_targets(docs, labelled.where("target").select("doc_id"), n_good)
    return resample(docs, fit(marked), n_good / n_labelled if n_labelled else 0.0)
