"""Quality rules from suffix arrays (operator 3).

The words of a batch of documents get ranks that hold their row, so that one suffix array serves the whole
batch and no common prefix crosses a document. Prefix doubling sorts it: the rank after r rounds orders the
suffixes by their first 2**r words. The ranks of all rounds give the longest common prefix of neighbours by
binary descent, and from these the LCP intervals: at each place the longest substring that is repeated
elsewhere in its document. The union of the maximal repeated substrings is the share of the text that repeats.

Words are compared by 64-bit hashes. Null and empty texts have no words and fail the base rules. Texts of any length
are read whole. Rows without doc_id and repeated rows are judged each by itself; an empty table gives no rows. Extra
columns stay; columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._session import bounded_batches
from ._words import Words, released, slices, spans, utf8, words

#: Symbols that the base counts.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Words of the windows that the base counts.
WINDOW = 8




def suffix_ranks(w: Words, rows: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ within their documents.

    A suffix shorter than that is padded with an end that is unlike anything else in its row; rows never share
    a rank.
    """
    n = len(w.begin)
    h = w.hashes()
    order = np.lexsort((h, w.row))
    new = np.ones(n, bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (w.row[order[1:]] != w.row[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    levels, span = [rank], 1
    left = w.first[1:][w.row] - np.arange(n)  # words to the end of the document
    count = int(new.sum())
    while count < n:
        # only suffixes that share a rank can still be told apart
        size = np.bincount(rank, minlength=count)
        open_ = np.flatnonzero(size[rank] > 1)
        follow = np.full(len(open_), -1, np.int64)
        on = left[open_] > span
        follow[on] = rank[open_[on] + span]
        a, b = rank[open_], follow
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        # new ranks keep the order of the old ones: old rank first, then the place within it
        within = np.zeros(len(order), np.int64)
        start = np.ones(len(order), bool)
        start[1:] = a[order[1:]] != a[order[:-1]]
        steps = np.cumsum(new) - 1
        within[order] = steps - np.repeat(steps[start], np.diff(np.append(np.flatnonzero(start), len(order))))
        extra = np.zeros(count, np.int64)  # ranks that each old rank adds
        ends = np.append(np.flatnonzero(start)[1:], len(order)) - 1
        extra[a[order[start]]] = steps[ends] - steps[start]
        shift = np.cumsum(extra) - extra
        fresh = rank + shift[rank]
        fresh[open_] += within
        total = count + int(extra.sum())
        rank, span = fresh, 2 * span
        levels.append(rank)
        if total == count and not on.any():
            break
        count = total
    return levels


def longest_repeats(w: Words, levels: list[np.ndarray]) -> np.ndarray:
    """For each word the length in words of the longest repeated substring that begins there."""
    n = len(w.begin)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    end = w.first[1:][w.row]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[order[:-1]]) & (b < end[order[1:]])
        same = np.zeros(len(a), bool)
        at = np.flatnonzero(inside)
        # the first 2**k words agree, and both suffixes have so many
        same[at] = (levels[k][a[at]] == levels[k][b[at]]) & (np.minimum(end[order[:-1]][at] - a[at], end[order[1:]][at] - b[at]) >= 1 << k)
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, order[:-1], common)
    np.maximum.at(longest, order[1:], common)
    return longest


def _covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def _duplicate_lines(data: np.ndarray, places: np.ndarray, w: Words) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line of the row."""
    rows = len(places) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([places[:-1], breaks + 1]), kind="stable")
    row = np.searchsorted(places[1:], begin, "right")
    # a break that ends a row opens an empty line there; those and the lines of empty rows hold no word
    begin, row = begin[row < rows], row[row < rows]
    end = np.append(begin[1:], len(data))
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, places[row + 1], end - 1)
    end = np.maximum(end, begin)
    full = np.flatnonzero(last & (end > begin))
    end[full] -= data[end[full] - 1] == 10  # a break that ends the row
    filled = np.searchsorted(w.begin, end) > np.searchsorted(w.begin, begin)
    begin, end, row = begin[filled], end[filled], row[filled]
    h = spans(data, begin, end)
    order = np.lexsort((h, row))
    again = np.zeros(len(order), bool)
    again[1:] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return np.bincount(row[order[again]], minlength=rows)


def _judge(text_at: int, min_repeat: int, max_share: float, max_repeat: int, names: list[str]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, places = utf8(batch.column(text_at))
                w = words(batch.column(text_at))
                rows, n = batch.num_rows, len(w.begin)
                n_words = np.diff(w.first)
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                word_chars = _per_row(chars[w.end] - chars[w.begin], w.first)
                n_symbols = _per_row(_SYMBOL[data], places)
                lines = _duplicate_lines(data, places, w)
                if n:
                    levels = suffix_ranks(w, rows)
                    longest = longest_repeats(w, levels)
                    windows = np.flatnonzero(longest >= WINDOW)
                    repeat_words = _per_row(_covered(windows, np.full(len(windows), WINDOW), n), w.first)
                    maximal = np.flatnonzero(longest >= min_repeat)
                    covered = _per_row(_covered(maximal, longest[maximal], n), w.first)
                    most = np.zeros(rows, np.int64)
                    np.maximum.at(most, w.row, longest)
                else:
                    repeat_words = covered = most = np.zeros(rows, np.int64)
                share = covered / np.maximum(n_words, 1)
                failed = (n_words < 20) | (100 * repeat_words > 30 * n_words)
                kept = ~failed & (share <= max_share) & (most <= max_repeat)
                made = [pa.array(np.asarray(c, np.int64)) for c in (n_words, word_chars, n_symbols, lines, repeat_words)]
                made += [pa.array(share), pa.array(most), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return run


def repetition_rules(docs: DataFrame, min_repeat: int = 4, max_share: float = 0.25, max_repeat: int = 150) -> DataFrame:
    """``docs`` with the base counts, the repeated share, the longest repeat, base_failed and kept.

    A text is kept if the base rules pass, at most ``max_share`` of its words lie in maximal repeated
    substrings of ``min_repeat`` words or more, and no substring of over ``max_repeat`` words is repeated.
    """
    bounded_batches(docs.sparkSession)
    made = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("repeat_share", T.DoubleType()), ("longest_repeat", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    base = docs.drop(*[name for name, _ in made])
    schema = T.StructType([*base.schema.fields, *[T.StructField(name, kind) for name, kind in made]])
    return base.mapInArrow(_judge(base.columns.index("text"), min_repeat, max_share, max_repeat, schema.names), schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, repetition and verdict for every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_rules(docs).drop("text")
