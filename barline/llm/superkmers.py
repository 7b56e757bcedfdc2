"""Substring dedup by super-k-mers (operator 2).

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash of the word pairs in
it. Consecutive windows that share a minimiser are a super-k-mer: their words travel once, as one packed
string, to the bucket of the minimiser. All windows with the same words have the same minimiser, so a bucket
sees every copy of its windows; it sorts them and finds those that start in more than one document.

Hot passages: of equal super-k-mers in one chunk of texts (``CHUNK`` bytes) only those of the smallest doc_id are
sent; the others are known to be repeats of it and are marked at once. So a passage that every document holds reaches
its bucket once a chunk, not once a document. Many buckets share a task, and a task holds one bucket at a time.

Hot minimisers: windows are counted first, by slots of minimisers (a fixed number of them). There are as many buckets
as keep each to about ``most`` windows, and at least ``BUCKETS`` for each partition. The windows of a slot with more
than ``most`` windows, and more than a bucket has on average, travel singly, to buckets by a hash of all their words.
So a word pair that stands in very many contexts fills no bucket.

Equal windows are found by 64-bit hashes of their words and compared byte by byte before they count.

Null texts have no words. A row without doc_id has no smaller or larger neighbours: it keeps its words and takes
none from others. Rows that share a doc_id never count as each other's copies, whatever their texts; repeated
rows get the same result each. Extra columns stay; columns named n_words, n_removed or kept_text are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import Words, chunks, gather, released, sequence_hashes, slices, spans, strings, words
from ._session import bounded_batches, width

#: Words of a minimiser; buckets for each partition of the shuffle.
MINIMISER, BUCKETS = 2, 16
#: Slots of minimisers for each partition; windows of a slot that are never too many for one bucket.
SLOTS, MOST = 256, 1 << 18
#: Bytes of text that are looked at together before the shuffle.
CHUNK = 1 << 23
_ZSTD = pa.Codec("zstd", compression_level=3)


def _frozen(*parts) -> bytes:
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _thawed(blob: bytes):
    return pickle.loads(_ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


def _window_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbouring values, by doubling."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == n else np.minimum(x[: len(x) - (n - span)], x[n - span :])


def _minimisers(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the minimiser of each window, and which windows lie in one document."""
    h = w.hashes()
    low = _window_minimum(sequence_hashes(h, MINIMISER), k - MINIMISER + 1)
    return h, low, np.flatnonzero(w.row[: len(low)] == w.row[k - 1 :])


def _compact(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    slot, n = (np.concatenate(c) for c in zip(*held, strict=True))
    slot, which = np.unique(slot, return_inverse=True)
    return slot, np.bincount(which, n).astype(np.int64)


def _count_slots(k: int, slots: int, parts: int):
    """(text) in; windows of each slot of minimisers that stands in the texts, packed for the part of the slot."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            slot, n = _compact(held)
            held.clear()
            part = slot % parts
            order = np.argsort(part, kind="stable")
            cuts = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
            return pa.RecordBatch.from_arrays([pa.array([int(part[c[0]]) for c in cuts], pa.int32()), pa.array([_frozen(slot[c], n[c]) for c in cuts], pa.binary())], ["bucket", "packed"])

        for whole in batches:
            for batch in slices(whole):
                w = words(batch.column(0))
                if len(w.begin) >= k:
                    _, low, at = _minimisers(w, k)
                    if len(at):
                        held.append(_compact([((low[at] % np.uint64(slots)).astype(np.int64), np.ones(len(at)))]))
                if sum(len(h[0]) for h in held) > 1 << 20:
                    held = [_compact(held)]
                    if len(held[0][0]) > 1 << 19:
                        yield flush()
        if held:
            yield flush()

    return run


def _sum_slots(most: int):
    """Packed counts of slots in; slots with more than ``most`` windows, and the sum of all under slot -1, out."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += [_thawed(x) for x in batch.column(1).to_pylist()]
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [_compact(held)]
        if held:
            slot, n = _compact(held)
            at = np.flatnonzero(n > most)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *slot[at].tolist()], pa.int64()), pa.array([int(n.sum()), *n[at].tolist()], pa.int64())], ["slot", "n"])

    return run


def _super_kmers(batch: pa.RecordBatch, k: int, hot: np.ndarray):
    """Of a batch with text: row, first word, windows, what names the bucket, begin and end of each super-k-mer in the
    packed words, which come last.

    ``hot`` says of each slot of minimisers whether its windows stand alone, named by all their words.
    """
    w = words(batch.column(1))
    if len(w.begin) < k:
        return None
    h, low, at = _minimisers(w, k)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]]) | (w.row[at[1:]] != w.row[at[:-1]])
    alone = hot[(low[at] % np.uint64(len(hot))).astype(np.int64)]
    if alone.any():
        new |= alone
        low[at[alone]] = sequence_hashes(h, k)[at[alone]]
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    # words with one space after each, so that any run of words is one slice
    size = w.end - w.begin
    places = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=places[1:])
    packed = np.full(places[-1], 32, np.uint8)
    packed[np.arange(size.sum()) + np.repeat(places[:-1] - (np.cumsum(size) - size), size)] = gather(w.data, w.begin, w.end)[0]
    last = first + count + k - 2
    return w.row[first], (first - w.first[w.row[first]]).astype(np.int32), count.astype(np.int32), low[first], places[first], places[last + 1] - 1, packed


def _send(k: int, buckets: int, hot: np.ndarray):
    """(doc_id, text, key) in; packed super-k-mers for their buckets and marks of known repeats out."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK):
            found = [(part, made) for part in slices(batch) if (made := _super_kmers(part, k, hot)) is not None]
            if not found:
                continue
            doc, key = (np.concatenate([part.column(c).to_numpy()[made[0]] for part, made in found]) for c in (0, 2))
            start, count, low, begin, end = (np.concatenate([made[c] for _, made in found]) for c in (1, 2, 3, 4, 5))
            # begin and end are places in the packed words of each part; here they become places in all of them
            sizes = [len(made[6]) for _, made in found]
            shift = np.repeat(np.cumsum(sizes) - sizes, [len(made[1]) for _, made in found])
            data = np.concatenate([made[6] for _, made in found])
            begin, end = begin + shift, end + shift
            del found
            h = spans(data, begin, end)
            order = np.lexsort((doc, h))
            near = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
            near = near[_equal(data, begin, end, order[near], order[near - 1])]
            first = np.ones(len(order), bool)  # of equal super-k-mers; those that follow have the same or a larger doc_id
            first[near] = False
            least = np.empty(len(order), np.int64)
            least[order] = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            mine = least == doc
            rows, keys = [], []
            if not mine.all():
                rows.append(_frozen(doc[~mine], key[~mine].astype(np.int64), start[~mine], count[~mine]))
                keys.append(-1)
            use = np.flatnonzero(mine)
            bucket = (low[use] % np.uint64(buckets)).astype(np.int32)
            use = use[np.argsort(bucket, kind="stable")]
            bucket.sort()
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            raw = memoryview(data)
            for number, part in zip(bucket[edges].tolist(), np.split(use, edges[1:]), strict=True):
                keys.append(number)
                texts = b"\n".join([raw[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)])
                rows.append(_frozen(np.diff(doc[part], prepend=0), key[part], start[part], count[part], texts))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"])

    return run


def _equal(data: np.ndarray, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans a[i] and b[i] hold the same bytes, for pairs of spans."""
    same = (end[a] - begin[a]) == (end[b] - begin[b])
    for first in range(0, len(a), 1 << 13):
        at = slice(first, first + (1 << 13))
        ok = np.flatnonzero(same[at]) + first
        x, places = gather(data, begin[a[ok]], end[a[ok]])
        y, _ = gather(data, begin[b[ok]], end[b[ok]])
        if len(ok):
            same[ok] = np.add.reduceat((x != y).astype(np.int32), places[:-1]) == 0
    return same


def _count(blobs: list[bytes], k: int):
    """The windows of one bucket that also start in a document with a smaller doc_id: doc, key, start, windows."""
    parts = [_thawed(b) for b in blobs]
    doc = np.concatenate([np.cumsum(p[0]) for p in parts])
    key, start, count = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (1, 2, 3))
    w = words(pa.array([b"\n".join(p[4] for p in parts)], pa.binary()).cast(pa.string()))
    n_words = count + k - 1
    first = np.cumsum(n_words) - n_words
    windows = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))  # first words
    kmer = np.repeat(np.arange(len(count)), count)
    h = sequence_hashes(w.hashes(), k)[windows]
    begin, end = w.begin[windows], w.end[windows + k - 1]
    docs = doc[kmer]
    order = np.lexsort((docs, h))
    same = np.zeros(len(order), bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    near = np.flatnonzero(same)
    true = _equal(w.data, begin, end, order[near], order[near - 1])
    if true.all():
        group = np.cumsum(~same) - 1
    else:  # two different windows share a hash: number them by their bytes
        raw = w.data.tobytes()
        odd = np.isin(h, h[order[near[~true]]])
        names: dict[bytes, int] = {}
        group = np.cumsum(~same) - 1 + len(order)
        at = np.flatnonzero(odd[order])
        group[at] = [names.setdefault(raw[begin[i] : end[i]], len(names)) for i in order[at].tolist()]
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[order])
    repeat = np.zeros(len(order), bool)
    repeat[order] = docs[order] > least[group]
    # runs of repeats in one super-k-mer
    edge = repeat & ~np.concatenate([[False], repeat[:-1] & (kmer[1:] == kmer[:-1])])
    at = np.flatnonzero(edge)
    if not len(at):
        return None
    run = np.cumsum(edge)[repeat] - 1
    inside = windows[at] - first[kmer[at]]
    return docs[at], key[kmer[at]], start[kmer[at]] + inside, np.bincount(run)


def _receive(k: int):
    """Packed super-k-mers sorted by bucket in; one row for each run of repeated windows out."""

    def rows(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), pa.int64()) for c in found], ["doc_id", "key", "start", "windows"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = -1, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b < 0:
                    yield rows(_thawed(blob))
                    continue
                if b != bucket and blobs:
                    if (found := _count(blobs, k)) is not None:
                        yield rows(found)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs and (found := _count(blobs, k)) is not None:
            yield rows(found)

    return run


def repeated_windows(docs: DataFrame, k: int = 13, most: int = MOST) -> DataFrame:
    """Runs of windows of ``docs`` (doc_id, text) that also start in a document with a smaller doc_id.

    Returns doc_id, key (a hash of the text, which tells apart rows that share a doc_id), start (word) and
    windows (how many follow one another).
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = width(spark)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("key"))
    slots = parts * SLOTS
    counted = rows.select("text").mapInArrow(_count_slots(k, slots, parts), "bucket int, packed binary")
    counts = counted.repartition(parts, "bucket").mapInArrow(_sum_slots(most), "slot long, n long").toPandas()
    total = int(counts["n"][counts["slot"] < 0].sum())
    buckets = max(parts * BUCKETS, total // MOST)
    hot = np.zeros(slots, bool)
    hot[counts["slot"][(counts["slot"] >= 0) & (counts["n"] > total / buckets)]] = True
    sent = rows.mapInArrow(_send(k, buckets, hot), "bucket int, packed binary")
    # marks (bucket -1) stay spread over all tasks
    dealt = sent.repartition(parts, F.when(F.col("bucket") < 0, F.xxhash64("packed")).otherwise(F.col("bucket")))
    return dealt.sortWithinPartitions("bucket").mapInArrow(_receive(k), "doc_id long, key long, start long, windows long")


def _remove(k: int, text_at: int, names: list[str]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                w = words(batch.column(text_at))
                n = np.diff(w.first)
                cut = np.zeros(len(w.begin) + 1, np.int64)
                starts, runs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
                row = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(starts), 0).to_numpy())
                begin = w.first[row] + starts.flatten().to_numpy()
                np.add.at(cut, begin, 1)
                np.add.at(cut, begin + runs.flatten().to_numpy() + k - 1, -1)
                keep = np.cumsum(cut[:-1]) == 0
                kept = np.zeros(len(keep) + 1, np.int64)
                np.cumsum(keep, out=kept[1:])
                left = np.diff(kept[w.first])
                # kept words with one space between the words of a row
                size = np.where(keep, w.end - w.begin, 0)[keep]
                last = np.zeros(len(size), bool)
                last[(np.cumsum(left) - 1)[left > 0]] = True
                places = np.zeros(len(size) + 1, np.int64)
                np.cumsum(size + ~last, out=places[1:])
                out = np.full(places[-1], 32, np.uint8)
                out[np.arange(size.sum()) + np.repeat(places[:-1] - (np.cumsum(size) - size), size)] = gather(w.data, w.begin[keep], w.end[keep])[0]
                texts = strings(out, places[np.concatenate([[0], np.cumsum(left)])], text=True).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n), pa.array(n - left), texts], names)

    return run


def dedup_substrings(docs: DataFrame, k: int = 13, most: int = MOST) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the words left when repeated windows are taken out.

    Words are removed if a window over them also starts in a document with a smaller doc_id, judged on the
    input. Kept words are joined by one space.
    """
    base = docs.drop("n_words", "n_removed", "kept_text")
    runs = repeated_windows(base, k, most).groupBy("doc_id", "key").agg(F.collect_list("start").alias("__starts"), F.collect_list("windows").alias("__runs"))
    runs = runs.select(F.col("doc_id").alias("__doc"), F.col("key").cast("int").alias("__key"), "__starts", "__runs")
    joined = base.join(runs, (base["doc_id"].cast("long") == F.col("__doc")) & (F.hash(base["text"]) == F.col("__key")), "left").drop("__doc", "__key")
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_remove(k, base.columns.index("text"), schema.names), schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that repeat across ``documents``, removed from all but the first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
