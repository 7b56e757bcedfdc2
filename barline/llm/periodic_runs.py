"""Periodic runs in texts: stretches of words that repeat with a period, as far as they go (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``times * q``
words, and ``least`` in all, that no neighbouring word extends. Periods are searched by octave, P <= q < 2 P. Boundaries
stand every 2 P words, and each has a tile, from 2 P words before it to 4 P words after it. A run of three periods or
more has a boundary with a whole period on its two sides; there the Z-function of the words after the boundary and
that of the words before it, backwards, give how far the period goes within the tile. Fragments with a smaller period
inside are left to that period. Fragments of a run share over one period of words and two runs of one period share less, so
that fragments of a document and period are stitched into whole runs by one pass in their order.

A word inside a run comes again within its period. So a boundary gets a tile only where it touches (times - 1) * P
neighbouring words that come again within 2 P words each; texts that repeat nothing send no tile. Tiles are rows of
their own and dealt over all tasks, so that the tiles of one long text are solved by many.

Words are told apart by 64-bit hashes. Texts that are null, empty or short have no runs. Rows with one doc_id, or
without, are each judged by themselves. Extra columns stay, but for those that are named as new ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bounded_batches, saved, width
from ._words import Words, gather, mix, released, slices, strings, words

_U = np.uint64
_FAR = np.int64(1) << 62
#: Bytes of tiles in one Arrow batch (one tile at least).
TILE_BYTES = 1 << 21
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _repeats(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word a number that equal words of its text share, and how far off the next such word is."""
    key = mix(w.hashes() + mix(w.row.astype(np.uint64) + _U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    code = np.empty(len(key), np.int32)
    code[order] = np.concatenate([[0], np.cumsum(~same)])[: len(key)]
    ahead = np.full(len(key), _FAR)
    ahead[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return code, ahead


def boundaries(w: Words, ahead: np.ndarray, octave: int, times: int) -> np.ndarray:
    """Words, multiples of 2 P in their texts, that touch enough words that come again within 2 P."""
    p = 1 << octave
    edge = np.diff(np.concatenate([[0], (ahead < 2 * p).view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    long = end - begin >= (times - 1) * p
    begin, end = begin[long], end[long]
    base = w.first[w.row[begin]] if len(begin) else begin
    low, high = -(-(begin - base) // (2 * p)), (end - base) // (2 * p)
    n = np.maximum(high - low + 1, 0)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(base, n) + (np.repeat(low, n) + step) * 2 * p


def _tiles(text_at: int, row_at: int, times: int, names: list[str]):
    """Rows with their words counted, and the tiles of their octaves as rows of their own."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kept = [k for k in range(whole.num_columns) if k != row_at]
            for batch in slices(whole, whole.schema.names[text_at]):
                w = words(batch.column(text_at))
                n = np.diff(w.first)
                tiled = np.zeros(batch.num_rows, bool)
                if len(w.begin):
                    code, ahead = _repeats(w)
                    for octave in range(max(int(n.max()) // times, 0).bit_length()):
                        at = boundaries(w, ahead, octave, times)
                        row = w.row[np.minimum(at, len(w.row) - 1)] if len(at) else at
                        fits = n[row] >= times << octave if len(at) else np.zeros(0, bool)
                        at, row = at[fits], row[fits]
                        tiled[row] = True
                        for part in _rows_of_tiles(w, code, at, row, octave, batch.column(row_at)):
                            size = len(part[0])
                            blank = [*(pa.nulls(size, batch.column(k).type) for k in kept), pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_())]
                            yield pa.RecordBatch.from_arrays([*blank, *part], names)
                made = [pa.array(n.astype(np.int64)), pa.array(tiled), batch.column(row_at)]
                blank = [pa.nulls(batch.num_rows, k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made, *blank], names)

    return run


def _rows_of_tiles(w: Words, code: np.ndarray, at: np.ndarray, row: np.ndarray, octave: int, ids: pa.Array) -> Iterator[list[pa.Array]]:
    p = 1 << octave
    each = max(1, TILE_BYTES // (24 * p))
    for first in range(0, len(at), each):
        b, r = at[first : first + each], row[first : first + each]
        begin, end = np.maximum(b - 2 * p, w.first[r]), np.minimum(b + 4 * p, w.first[r + 1])
        values, places = gather(code, begin, end)
        yield [ids.take(pa.array(r)), pa.array(np.full(len(b), octave, np.int32)), pa.array(b - w.first[r]), pa.array(b - begin), strings(values.view(np.uint8), places * 4).cast(pa.binary())]


def z_function(s: list[int]) -> list[int]:
    """For each place how many words from there on are those of the beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments(tile: list[int], left: int, p: int) -> list[tuple[int, int, int]]:
    """(words before the boundary, words after it, period) of what has a period P <= q < 2 P across the boundary."""
    after = tile[left:]
    most = min(2 * p - 1, len(after))
    ahead = [*z_function(after), 0]
    before = tile[:left][::-1]
    back = z_function([*before, -1, *tile[: left + most][::-1]])
    found: list[tuple[int, int, int]] = []
    for q in range(1, most + 1):
        r, l = ahead[q], back[len(before) + 1 + most - q]  # noqa: E741
        # a smaller period that reaches as far is one of this stretch as well
        if r + l >= q and not any(x >= l and y >= q + r for x, y, _ in found):
            found.append((l, q + r, q))
    return [f for f in found if f[2] >= p]


@released
def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (row, octave, place, left, codes) in, fragments (row, period, start, end) out."""
    for batch in batches:
        row, octave, place, left = (batch.column(k).to_numpy() for k in range(4))
        out: list[tuple[int, int, int, int]] = []
        for k, codes in enumerate(batch.column(4)):
            tile = np.frombuffer(codes.as_buffer(), np.int32).tolist()
            for before, after, q in fragments(tile, int(left[k]), 1 << int(octave[k])):
                out.append((int(row[k]), q, int(place[k]) - before, int(place[k]) + after))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "period", "start", "end"])


def stitched(found: DataFrame, least: int, times: int) -> DataFrame:
    """(row, start, length, period) of whole runs from fragments (row, period, start, end)."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True)).cast("int")
    marked = found.withColumn("apart", apart)
    marked = marked.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.select("row", "start", (F.col("end") - F.col("start")).alias("length"), "period")
    return whole.where((F.col("length") >= least) & (F.col("length") >= times * F.col("period")))


def _collapse(text_at: int, runs_at: int, names: list[str]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                w = words(batch.column(text_at))
                runs = batch.column(runs_at)
                row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(runs), 0).to_numpy())
                start, length, period = (runs.flatten().field(k).to_numpy() for k in range(3))
                edge = np.zeros(len(w.begin) + 1, np.int64)
                np.add.at(edge, w.first[row] + start + period, 1)
                np.add.at(edge, w.first[row] + start + length, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, _joined(w, kept, batch.num_rows)], names)

    return run


def _joined(w: Words, kept: np.ndarray, rows: int) -> pa.Array:
    """These words of each row with one space between them."""
    row = w.row[kept]
    first = np.ones(len(kept), bool)
    first[1:] = row[1:] != row[:-1]
    size = w.end[kept] - w.begin[kept] + ~first
    places = np.concatenate([[0], np.cumsum(size)])
    # every word with the byte before it, then that byte as a space; a row's first word comes without
    at = np.arange(places[-1]) + np.repeat(w.begin[kept] - ~first - places[:-1], size)
    data = w.data[at]
    data[places[:-1][~first]] = 32
    ends = places[np.searchsorted(row, np.arange(rows + 1))]
    return strings(data, ends, text=True).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (an array of start, length and period by start, then period) and collapsed_text.

    In collapsed_text every run is cut to its first period, and words have one space between them.
    """
    if times < 3 or least < 1:
        raise ValueError("a run takes three periods or more, and one word or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop("n_words", "runs", "collapsed_text", "__row")
    rows = base.withColumn("__row", F.monotonically_increasing_id())
    made = "n_words long, __tiled boolean, __row long, __octave int, __place long, __left long, __words binary"
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in base.schema.fields), *T.StructType.fromDDL(made).fields])
    at = base.columns.index("text"), len(base.columns)
    # numbers of rows are settled by this table; tiles and rows of a task are written together
    cut = saved(rows.mapInArrow(_tiles(*at, times, schema.names), schema))
    tiles = cut.where("__octave is not null").select("__row", "__octave", "__place", "__left", "__words")
    dealt = tiles.repartition(width(spark), "__row", "__octave", "__place")
    found = dealt.mapInArrow(_solve, "row long, period long, start long, end long")
    by_row = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    runs = F.transform(by_row, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    known = stitched(found, least, times).groupBy(F.col("row").alias("__row")).agg(runs.alias("runs"))
    wanted = [*base.columns, "n_words", "runs"]
    plain = cut.where("__octave is null and not __tiled").withColumn("runs", F.array().cast(RUNS))
    tiled = cut.where("__octave is null and __tiled").join(known, "__row", "left")
    tiled = tiled.withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    out = plain.select(*wanted).union(tiled.select(*wanted))
    final = T.StructType([*out.schema.fields, T.StructField("collapsed_text", T.StringType())])
    return out.mapInArrow(_collapse(wanted.index("text"), wanted.index("runs"), final.names), final)


@released
def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text; a tenth of the documents, by the checksum of doc_id, with a tail that repeats itself."""
    for batch in batches:
        texts: list[str | None] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
            if h % 10 or not (w := (text.as_py() or "").encode().split()):
                texts.append(text.as_py())
                continue
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            root = w[a : a + p]
            texts.append(b" ".join([*w[:a], *(root * ((n - a) // p + 1))[: n - a]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods or more in all ``documents``, a tenth of them with a periodic tail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bounded_batches(spark)
    found = periodic_runs(docs.mapInArrow(_planted, "doc_id long, text string"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    shown = found.withColumn("best", best)
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
        "n_words",
    )
