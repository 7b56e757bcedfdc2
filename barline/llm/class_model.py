"""Language-model scores from a Brown class-based bigram model (operator 6).

Every word has a class. The log probability of a text is the sum over its tokens of log P(class | class before)
and log P(word | class). Classes come from exchange clustering: each word moves to the class that gains most
likelihood, as in Brown et al. (1992), run in the distributed form of Uszkoreit and Brants (2008).

1. Where words start: units are the ``frequent`` most frequent words and, for all others, ``groups`` groups by the
   last three bytes of a word. Spark counts pairs of units, and the driver exchanges units.
2. Then every word of the training texts moves by itself. Its counts beside each class are gathered in the bucket
   of the word, and its class is chosen there; only the table of class by class is broadcast. The classes of all
   words are a saved table. Words that move at once spoil each other's counts, so that a pass moves one of
   ``turns`` parts of them, by hash. Of ``word_passes`` passes the one with the largest likelihood is taken, from
   where all words have had their turn.

Texts meet the classes and counts of their words in this way: a chunk of texts is kept as numbers of its distinct
words, these ask the buckets of words, and the answers go back to the chunk. A word asks once a chunk, however
often it stands there. What is gathered grows with the words of the corpus; the driver holds only units and classes.

Words are told apart by 64-bit hashes; of words with the same count those with the smaller hash are units first. Words
that no training text has take the class of their group and count as one word of it. Texts of any length are read whole.
Null texts are empty and hold the end token only. Rows without doc_id are scored and learned from. Repeated rows are
each scored and each counted in training. An empty table gives no rows. Extra columns stay; columns named n_tokens,
n_known, train_tokens, base_score or score are replaced.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import bounded_batches, dropped, saved, width
from ._words import chunks, mix, released, slices, spans, words

#: The hash that stands for the end token.
END = np.uint64(0x5BD1E9955BD1E995)
_TAIL = 3
#: Words of a bucket, about, where there are more than a bucket for each partition takes.
BUCKET = 1 << 15


def _frozen(*parts: np.ndarray) -> bytes:
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _thawed(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def _tokens(column: pa.Array, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows one after another, ends included: hash, group, row; and where each row begins."""
    w = words(column, lower=True)
    rows = len(w.first) - 1
    total = len(w.begin) + rows
    at = np.arange(len(w.begin)) + w.row  # places of the words; each row before adds one end
    ends = w.first[1:] + np.arange(rows)
    h = np.empty(total, np.uint64)
    h[at], h[ends] = w.hashes(), END
    group = np.full(total, groups, np.int64)
    group[at] = (spans(w.data, np.maximum(w.begin, w.end - _TAIL), w.end) % np.uint64(groups)).astype(np.int64)
    row = np.empty(total, np.int64)
    row[at], row[ends] = w.row, np.arange(rows)
    return h, group, row, np.concatenate([[0], ends + 1])


def _count_words(groups: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in chunks(batches, 1 << 24):
            found = []
            for batch in slices(whole):
                h, group, _, _ = _tokens(batch.column(0), groups)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                found.append((u, group[at], n))
            h, group, n = (np.concatenate(c) for c in zip(*found, strict=True))
            u, at, which = np.unique(h, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(group[at], pa.int32()), pa.array(np.bincount(which, n).astype(np.int64))], ["word", "grp", "n"])

    return run


@dataclass
class Units:
    """Frequent words (sorted hashes and their counts), then groups, then the end."""

    hashes: np.ndarray
    counts: np.ndarray
    groups: int

    @property
    def end(self) -> int:
        return len(self.hashes) + self.groups

    def of(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        found = len(self.hashes) + group  # the end's group number is ``groups``
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == h, at, found)
        return found


#: Pairs that wait to be counted, about: a count of all cells at once costs as much as so many pairs.
_WAITING = 1 << 22


def _count_pairs(units: Units):
    size = units.end + 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        held: list[np.ndarray] = []
        waiting = 0

        def counted() -> np.ndarray:
            counts = np.bincount(np.concatenate(held), minlength=size * size).astype(np.int32)
            return counts if total is None else np.add(total, counts, out=total)

        for whole in batches:
            for batch in slices(whole):
                h, group, row, first = _tokens(batch.column(0), units.groups)
                u = units.of(h, group)
                before = np.empty_like(u)
                before[1:] = u[:-1]
                before[first[:-1]] = units.end
                held.append((before * size + u).astype(np.int32 if size * size < 1 << 31 else np.int64))
                waiting += len(u)
                if waiting >= _WAITING:
                    total = counted()
                    held, waiting = [], 0
        if held:
            total = counted()
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array(total[at].astype(np.int64))], ["a", "b", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, own: np.ndarray, of: np.ndarray, order: np.ndarray, classes: int) -> np.ndarray:
    """One pass: each unit, frequent ones first, goes to the class that gains most likelihood.

    ``left[u, c]`` and ``right[u, c]`` count class c before and after u, ``own[u]`` counts u after itself. The
    counts between classes follow every move; those of the other units wait for the next pass.
    """
    of = of.copy()
    pairs = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(pairs, of, right)
    for u in order:
        a, own_u = of[u], own[u]
        r, l = right[u].copy(), left[u].copy()  # noqa: E741
        if r.sum() + l.sum() == 0:
            continue
        r[a] = max(r[a] - own_u, 0)
        l[a] = max(l[a] - own_u, 0)
        pairs[a, :] -= r
        pairs[:, a] -= l
        pairs[a, a] -= own_u
        np.maximum(pairs, 0, out=pairs)
        rows, columns = pairs.sum(1), pairs.sum(0)
        k = np.arange(classes)
        gain = (_xlogx(pairs[:classes] + r) - _xlogx(pairs[:classes])).sum(1) + (_xlogx(pairs[:, :classes] + l[:, None]) - _xlogx(pairs[:, :classes])).sum(0)
        corner = pairs[k, k]
        gain += _xlogx(corner + r[:classes] + l[:classes] + own_u) - _xlogx(corner + r[:classes]) - _xlogx(corner + l[:classes]) + _xlogx(corner)
        out, in_ = r.sum() + own_u, l.sum() + own_u
        gain -= _xlogx(rows[:classes] + out) - _xlogx(rows[:classes]) + _xlogx(columns[:classes] + in_) - _xlogx(columns[:classes])
        best = int(gain.argmax())
        if gain[best] <= gain[a] + 1e-9:
            best = a
        of[u] = best
        pairs[best, :] += r
        pairs[:, best] += l
        pairs[best, best] += own_u
    return of


@dataclass
class Model:
    groups: int
    default: np.ndarray  # class of each group, for words that training has not met; the end's is the last
    transition: np.ndarray  # log10 P(class | class before)
    below: np.ndarray  # log10 of the denominator of P(word | class)
    tokens: int
    types: int
    words: DataFrame  # all words in packed buckets: hashes, counts, classes
    buckets: int


def fit(texts: DataFrame, frequent: int = 2048, groups: int = 512, classes: int = 48, passes: int = 5, word_passes: int = 4, turns: int = 2) -> Model:
    """The model of a table with the column text, one row a document."""
    bounded_batches(texts.sparkSession)
    texts = texts.select("text")
    counts = saved(texts.mapInArrow(_count_words(groups), "word long, grp int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("grp").alias("grp")))
    tokens, types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    common = counts.where(F.col("grp") < groups).orderBy(F.desc("n"), "word").limit(frequent).toPandas()
    hashes = common["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    units = Units(hashes[order], common["n"].to_numpy(np.int64)[order], groups)
    size = units.end + 1
    pairs = saved(texts.mapInArrow(_count_pairs(units), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))

    def met(of: np.ndarray):
        """How often each unit meets each class on either side, and itself: tables of fixed size."""
        table = F.lit(of.tolist()).cast("array<int>")
        sides = []
        for one, other in (("b", "a"), ("a", "b")):
            found = pairs.groupBy(F.col(one).alias("u"), F.get(table, F.col(other)).alias("c")).agg(F.sum("n").alias("n")).toPandas()
            side = np.zeros((size, classes + 1))
            side[found["u"], found["c"]] = found["n"]
            sides.append(side)
        return sides

    own = np.zeros(size)
    same = pairs.where("a = b").toPandas()
    own[same["a"]] = same["n"]
    of = np.arange(size) % classes
    of[units.end] = classes
    left, right = met(of)
    best, best_of, best_right = -np.inf, of, right
    for _ in range(passes + 1):
        between = np.zeros((classes + 1, classes + 1))
        np.add.at(between, of, right)
        likelihood = _xlogx(between).sum() - _xlogx(between.sum(1)).sum() - _xlogx(between.sum(0)).sum()
        if likelihood <= best:
            break
        best, best_of, best_right = likelihood, of, right
        heavy = np.argsort(-(left.sum(1) + right.sum(1)), kind="stable")
        of = exchange(left, right, own, of, heavy[heavy != units.end], classes)
        left, right = met(of)
    of = best_of
    # from here on every word for itself
    spark = texts.sparkSession
    parts = width(spark)
    buckets = max(parts, types // BUCKET)
    named = spark.createDataFrame([(int(h), k) for k, h in enumerate(units.hashes.view(np.int64))], "word long, unit int")
    unit = F.coalesce("unit", F.col("grp") + len(units.hashes))
    placed = counts.join(F.broadcast(named), "word", "left").select("word", "n", F.get(F.lit(of.tolist()).cast("array<int>"), unit).alias("class"))
    default = of[len(units.hashes) :].astype(np.uint8)
    held = saved(placed.mapInArrow(_send_words(buckets), _PACKED))
    sent = saved(texts.select(F.lit(0).cast("long").alias("key"), "text").mapInArrow(_encode(groups, default, buckets), _PACKED))
    del placed
    dropped(pairs)
    best, kept, between = -np.inf, held, np.zeros((classes + 1, classes + 1))
    for step in range(word_passes + 1):
        turn = step % turns if step < word_passes else None
        beside = saved(_answered(sent, held, parts, _beside(classes, buckets, turn, turns), _PACKED, counts=False))
        found = beside.where("bucket < 0").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        now = np.zeros((classes + 1) ** 2)
        now[found["cell"]] = found["n"]
        now = now.reshape(classes + 1, classes + 1)
        likelihood = _xlogx(now).sum() - _xlogx(now.sum(1)).sum() - _xlogx(now.sum(0)).sum()
        # it may fall at first, when many words move at once; a state counts once each word has had its turn
        if likelihood > best and step >= min(turns, word_passes):
            best, kept, between = likelihood, held, now
        if step < word_passes:
            met = beside.where("bucket >= 0").union(held).repartition(parts, "bucket").sortWithinPartitions("bucket", "at")
            last, held = held, saved(met.mapInArrow(_move(now, classes, turn, turns), _PACKED))
            del met
            if last is not kept:
                dropped(last)
        dropped(beside)
    if held is not kept:
        dropped(held)
    dropped(sent)
    transition = np.log10((between + 0.5) / (between.sum(1, keepdims=True) + 0.5 * (classes + 1)))
    sizes = kept.mapInArrow(_sizes, "class int, n long, types long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toPandas()
    below = np.ones(classes + 1)
    below[sizes["class"]] += sizes["n"] + sizes["types"]
    return Model(groups, default, transition, np.log10(below), tokens, types, kept, buckets)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


#: Of a chunk of texts (bucket -1), or of words in a bucket: ``at`` is the number of the first of them in the chunk,
#: or -1 for the table of words.
_PACKED = "chunk long, bucket int, at int, packed binary"
_UNKNOWN = 255


def _rows(chunk: list[int], bucket: list[int], at: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bucket", "at", "packed"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)


def _send_words(buckets: int):
    """(word, n, class) in."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, class_ = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint8)
            bucket = _buckets(h, buckets)
            parts = _parts(bucket)
            yield _rows([0] * len(parts), [int(bucket[p[0]]) for p in parts], [-1] * len(parts), [_frozen(h[p], n[p], class_[p]) for p in parts])

    return run


def _encode(groups: int, default: np.ndarray, buckets: int):
    """(key, text) in. Out: each chunk as numbers of its words, in the order of their buckets, and its words by bucket."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in chunks(batches, 1 << 24):
            keys, sizes, hashes, kinds, numbers, met = [], [], [], [], [], 0
            for batch in slices(whole):
                h, group, _, first = _tokens(batch.column(1), groups)
                u, at, which = np.unique(h, return_index=True, return_inverse=True)
                keys.append(batch.column(0).to_numpy())
                sizes.append(np.diff(first))
                hashes.append(u)
                kinds.append(group[at])
                numbers.append((which + met).astype(np.int32))
                met += len(u)
            names, at, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            bucket = _buckets(names, buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            names, bucket, class_ = names[order], bucket[order], default[np.concatenate(kinds)[at[order]]]
            tokens = place[which][np.concatenate(numbers)]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            chunk = uuid.uuid4().int >> 65
            packed = [_frozen(np.concatenate(keys), np.concatenate(sizes), names, class_, tokens)]
            packed += [_frozen(part) for part in np.split(names, first[1:])]
            yield _rows([chunk] * len(packed), [-1, *bucket[first].tolist()], [-1, *first.tolist()], packed)

    return run


def _table(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one bucket: sorted hashes, counts, classes."""
    h, n, class_ = (np.concatenate(x) for x in zip(*map(_thawed, blobs), strict=True)) if blobs else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    order = np.argsort(h)
    return h[order], n[order], class_[order]


def _answer(counts: bool):
    """Buckets in, their table of words first; classes and, if asked for, counts of the words of each chunk out."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, table, held = -1, [], None, []
        for chunk, b, at, packed in _read(batches):
            if b != bucket:
                bucket, blobs, table = b, [], None
            if at < 0:
                blobs.append(packed)
                continue
            h, n, class_ = table = table or _table(blobs)
            (asked,) = _thawed(packed)
            if len(h):
                place = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                known = h[place] == asked
                reply = np.where(known, class_[place], _UNKNOWN).astype(np.uint8), np.where(known, n[place], 0)
            else:
                reply = np.full(len(asked), _UNKNOWN, np.uint8), np.zeros(len(asked), np.int64)
            held.append((chunk, b, at, _frozen(*reply[: 1 + counts])))
            if len(held) == 1000:
                yield _rows(*map(list, zip(*held, strict=True)))
                held = []
        if held:
            yield _rows(*map(list, zip(*held, strict=True)))

    return run


def _answered(sent: DataFrame, held: DataFrame, parts: int, of_chunk: Callable, schema: str, counts: bool = True) -> DataFrame:
    """What ``of_chunk`` makes of each encoded chunk once the table of words has answered it."""
    asked = sent.where("bucket >= 0").union(held).repartition(parts, "bucket").sortWithinPartitions("bucket", "at")
    met = asked.mapInArrow(_answer(counts), _PACKED).union(sent.where("bucket < 0")).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, n, class_ = None, None, None
        for chunk, bucket, at, packed in _read(batches):
            if bucket < 0:
                if body is not None:
                    yield of_chunk(*body, n, class_)
                *body, tokens = _thawed(packed)
                body.append(tokens)
                n, class_ = np.zeros(len(body[2]), np.int64), body[3].copy()
                continue
            found, *count = _thawed(packed)
            if count:
                n[at : at + len(found)] = count[0]
            class_[at : at + len(found)] = np.where(found == _UNKNOWN, class_[at : at + len(found)], found)
        if body is not None:
            yield of_chunk(*body, n, class_)

    return met.mapInArrow(run, schema)


def _before(values: np.ndarray, sizes: np.ndarray, end) -> np.ndarray:
    """The value before each token; before the first of a text stands the end."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[(np.cumsum(sizes) - sizes)] = end
    return before


def _moving(h: np.ndarray, of: np.ndarray, classes: int, turn: int, turns: int) -> np.ndarray:
    """Which words move in a pass. The end stays in its class."""
    return (of < classes) & (mix(h + np.uint64(1)) % np.uint64(turns) == turn)


def _beside(classes: int, buckets: int, turn: int | None, turns: int):
    """Of a chunk: pairs of classes (bucket -1), and for each bucket how often its words that move in this turn stand
    beside each class."""

    def of_chunk(keys, sizes, names, default, tokens, n, class_) -> pa.RecordBatch:
        own = class_[tokens].astype(np.int64)
        before = _before(own, sizes, classes)
        pairs = np.bincount(before * (classes + 1) + own, minlength=(classes + 1) ** 2)
        cell = np.flatnonzero(pairs)
        packed = [_frozen(cell.astype(np.int32), pairs[cell])]
        if turn is None:
            return _rows([0], [-1], [-1], packed)
        moving = _moving(names, class_, classes, turn, turns)
        place = np.cumsum(moving) - 1
        names = names[moving]
        inner = np.flatnonzero(moving[tokens])  # no ends among them: something comes after each
        word = place[tokens[inner]] * (classes + 1)
        sides = [np.unique(word + other, return_counts=True) for other in (before[inner], own[np.minimum(inner + 1, len(own) - 1)])]
        same = np.flatnonzero(tokens[np.maximum(inner - 1, 0)] == tokens[inner])
        same = same[inner[same] > 0]
        sides.append(np.unique(word[same], return_counts=True))
        bucket = _buckets(names, buckets)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(first[1:], len(names))[: len(first)]
        cuts = [(np.searchsorted(k, first * (classes + 1)), np.searchsorted(k, ends * (classes + 1))) for k, _ in sides]
        for i, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
            packed.append(_frozen(names[a:b], *(x for (k, c), (low, high) in zip(sides, cuts, strict=True) for x in ((k[low[i] : high[i]] - a * (classes + 1)).astype(np.int32), c[low[i] : high[i]].astype(np.int32)))))
        return _rows([0] * len(packed), [-1, *bucket[first].tolist()], [-1, *[0] * len(first)], packed)

    return of_chunk


@released
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for *_, packed in _read(batches):
        cell, n = _thawed(packed)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])


@released
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for *_, packed in _read(batches):
        _, n, class_ = _thawed(packed)
        found, which = np.unique(class_, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.bincount(which, n).astype(np.int64)), pa.array(np.bincount(which))], ["class", "n", "types"])


def best_classes(between: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The class of each word that gains most likelihood, all others as in ``between``.

    ``left[w, c]`` and ``right[w, c]`` count class c before and after w, ``own[w]`` counts w after itself. Of classes
    that gain the same, as empty ones do, ``draw[w]`` names one, so that words which move at once don't stay together.
    """
    classes = between.shape[0] - 1
    i = np.arange(len(of))
    left, right = left.copy(), right.copy()
    for side in (left, right):
        side[i, of] = np.maximum(side[i, of] - own, 0)
    gain = np.zeros((len(of), classes))
    # counts of class pairs without the word: a pair with its own class has lost it
    for one, other, table in ((right, left, between), (left, right, between.T)):
        w, c = np.nonzero(one)
        if not len(w):
            continue
        n = one[w, c]
        base = table[:classes, c].T.copy()
        base[np.arange(len(w)), of[w]] -= n
        same = np.flatnonzero(c == of[w])
        base[same] -= other[w[same], :classes]
        base[same, of[w[same]]] -= own[w[same]]
        np.maximum(base, 0, out=base)
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(_xlogx(base + n[:, None]) - _xlogx(base), first)
    l, r, o = left[:, :classes], right[:, :classes], own[:, None]  # noqa: E741
    corner = np.tile(between.diagonal()[:classes], (len(of), 1))
    corner[i, of] -= l[i, of] + r[i, of] + own
    np.maximum(corner, 0, out=corner)
    gain += _xlogx(corner + l + r + o) - _xlogx(corner + r) - _xlogx(corner + l) + _xlogx(corner)
    for side, total in ((right, between.sum(1)), (left, between.sum(0))):
        met = side.sum(1) + own
        base = np.tile(total[:classes], (len(of), 1))
        base[i, of] = np.maximum(base[i, of] - met, 0)
        gain -= _xlogx(base + met[:, None]) - _xlogx(base)
    most = gain.max(1)
    level = gain >= (most - 1e-9)[:, None]
    best = (np.cumsum(level, 1) > (draw.astype(np.uint64) % level.sum(1).astype(np.uint64))[:, None]).argmax(1)
    return np.where(most > gain[i, of] + 1e-9, best, of)


class _Sum:
    """Counts by key, added up while they come: what waits is never much more than the keys that there are."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.bound = 0, 1 << 20

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.waiting.append((key, count))
        self.size += len(key)
        if self.size > self.bound:
            key, _ = self.total()
            self.bound = max(1 << 20, 2 * len(key))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.waiting) > 1:
            key, count = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            key, which = np.unique(key, return_inverse=True)
            self.waiting = [(key, np.bincount(which, count, len(key)))]
            self.size = len(key)
        return self.waiting[0] if self.waiting else (np.zeros(0, np.int64), np.zeros(0))


def _move(between: np.ndarray, classes: int, turn: int, turns: int):
    """Buckets in, their tables of words first, then how often these stand beside each class. The tables with new
    classes out. Counts of all chunks are summed while they are read."""

    def moved(bucket: int, words: tuple, sums: list[_Sum]) -> pa.RecordBatch:
        h, n, of = words
        sides = [side.total() for side in sums]
        new = of.copy()
        for first in range(0, len(h), 1024):
            last = min(first + 1024, len(h))
            dense = []
            for key, count in sides:
                low, high = np.searchsorted(key, [first * (classes + 1), last * (classes + 1)])
                part = np.zeros((last - first) * (classes + 1))
                part[key[low:high] - first * (classes + 1)] = count[low:high]
                dense.append(part.reshape(-1, classes + 1))
            at = np.flatnonzero(_moving(h[first:last], of[first:last], classes, turn, turns))
            new[first + at] = best_classes(between, of[first:last][at].astype(np.int64), dense[0][at], dense[1][at], dense[2][at, 0], h[first:last][at] >> np.uint64(32))
        return _rows([0], [bucket], [-1], [_frozen(h, n, new)])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tables, words, sums = -1, [], None, []
        for _, b, at, packed in _read(batches):
            if b != bucket:
                if tables:
                    yield moved(bucket, words or _table(tables), sums)
                bucket, tables, words, sums = b, [], None, [_Sum() for _ in range(3)]
            if at < 0:
                tables.append(packed)
                continue
            words = words or _table(tables)
            names, *found = _thawed(packed)
            place = np.searchsorted(words[0], names)
            for side, key, count in zip(sums, found[::2], found[1::2], strict=True):
                side.add(place[key // (classes + 1)] * (classes + 1) + key % (classes + 1), count)
        if tables:
            yield moved(bucket, words or _table(tables), sums)

    return run


def _scores(transition: np.ndarray, below: np.ndarray):
    """Of a chunk: key, n_tokens, n_known, sum of log10(count + 1) and score of each text, equal ones once."""

    def of_chunk(keys, sizes, names, default, tokens, n, class_) -> pa.RecordBatch:
        c = class_[tokens]
        log = np.log10(n + 1.0)[tokens]
        first = np.cumsum(sizes) - sizes
        step = transition[_before(c, sizes, len(below) - 1), c] - below[c] + log
        known, logs, score = (np.add.reduceat(x, first) for x in ((n > 0)[tokens].astype(np.int64), log, step))
        _, at = np.unique(keys, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (keys, sizes, known, logs, score)], ["key", "n_tokens", "n_known", "log", "score"])

    return of_chunk


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` other than text, with n_tokens, n_known, train_tokens, base_score and score."""
    bounded_batches(docs.sparkSession)
    base = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    spark = docs.sparkSession
    parts = width(spark)
    # the name of a row: equal texts of many documents are many keys, so that no key is hot
    key = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    sent = saved(base.select(key.alias("key"), "text").mapInArrow(_encode(model.groups, model.default, model.buckets), _PACKED))
    found = _answered(sent, model.words, parts, _scores(model.transition, model.below), "key long, n_tokens long, n_known long, log double, score double")
    # rows with the same text and doc_id share a key, and have the same values
    sums = found.groupBy("key").agg(*(F.max(c).alias(c) for c in ("n_tokens", "n_known", "log", "score")))
    rest = float(np.log10(model.tokens + model.types + 1))
    joined = base.withColumn("__key", key).drop("text").join(sums.withColumnsRenamed({"key": "__key", "log": "__log"}), "__key")
    return joined.withColumns({"train_tokens": F.lit(model.tokens).cast("long"), "base_score": F.col("__log") - F.col("n_tokens") * F.lit(rest)}).drop("__key", "__log")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op6_class_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of ``documents``, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
