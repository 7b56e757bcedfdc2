"""N-gram Jaccard join by vertical partitioning (operator 4).

A document's set holds the 64-bit hashes of its distinct 5-word shingles. The order of all shingles is cut into
fragments, and each fragment is worked on by itself: what it finds about a document, or about a pair, is a part,
and the parts are summed.

1. Equal sets are one class, named by its smallest doc_id.
2. Each fragment counts, for each class, the shingles that some other class has too; the parts go to the bucket of
   the class, packed, and are summed there. A class whose sum is under the threshold's share of its size links with
   nothing. Most documents end here. Shingles are 32 bits of their hash within their fragment, which only counts too
   many as shared, never too few. What classes of one chunk of texts share is counted in the chunk, and its fragment
   gets one entry without names: a shingle of all documents is one entry a chunk, not one a document. There are as
   many fragments as keep a bounded number of shingles each.
3. For the others, fragments count in how many classes a shingle lies. A class's prefix, its rarest shingles,
   is as long as the threshold demands: classes that link share a shingle of both prefixes (prefix filter).
4. The classes with a prefix shingle are a list. Each member is compared with the list's pivot, the member whose
   shingles are most common: the fragments of both sets meet, each gives a partial overlap, and the sum is exact.
   Those that link with the pivot are one component, so a group of near copies costs one comparison a member.
5. The members that are left over in a list, with a component other than the pivot's, are compared with all members
   of the pivot's lists, in blocks: a task holds a bounded block of sets, and the left-over ones pass by. Overlaps
   of a block are products of 0/1 matrices over the shingles that both sides have, a fragment of them at a time,
   summed. A task returns a spanning forest of the links it finds, not pairs.

So every two classes that link end up in one component: they share a list, and there they are linked by its pivot or
compared with each other. Links inside a component are not all listed.

Two hashes of different shingles agree with a chance of 2**-64. Null and empty texts have an empty set and link
with nothing. Texts of any length are read whole. Rows without doc_id link with nothing and have no component. Rows
that share a doc_id count as one document: if one of them links, both are in its component. Repeated rows get the same
result each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded_batches, saved, width
from ._words import chunks, mix, released, sequence_hashes, slices, words
from .class_model import _frozen, _parts, _thawed
from .components import connected_components, forest

#: Fragments of a pair of sets, and shingles of a fragment when blocks of sets are compared.
FRAGMENTS, FRAGMENT = 4, 2048
#: Sets and shingles of a block, about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: Ids that are broadcast at most (8 bytes each).
BROADCAST = 1 << 20
#: Shingles of a fragment, about, where a fragment for each partition would hold more.
FRAGMENT_SHINGLES = 1 << 22
#: Pairs of a pivot that meet one copy of its set.
STAR = 4096


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted by row and value, and where each row begins."""
    w = words(column, lower=True)
    h = w.hashes()
    rows = len(w.first) - 1
    size = np.diff(w.first)
    shingles = sequence_hashes(h, n)
    at = np.flatnonzero(w.row[: len(shingles)] == w.row[n - 1 :]) if len(shingles) else np.zeros(0, np.int64)
    value, row = [shingles[at]], [w.row[at]]
    for k in range(1, n):  # texts with fewer words are one shingle
        short = np.flatnonzero(size == k)
        total = np.zeros(len(short), np.uint64)
        for i in range(k):
            total = mix(total + h[w.first[short] + i])
        value.append(total + np.uint64(k))
        row.append(short)
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _per_set(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[places[1:]] - total[places[:-1]]


def _prints(value: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    return _per_set(mix(value), places), _per_set(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), places)


def _describe(n: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                value, places = _sets(batch.column(1), n)
                one, two = _prints(value, places)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(places)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "size", "one", "two"])

    return run


def _send_shingles(n: int, buckets: int):
    """Shingles to their fragments, 32 bits each (enough for a filter): the class of those that one class of a chunk has,
    and those that several have without names. How many shingles each class shares within the chunk is one more row, in
    a bucket below zero."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in chunks(batches, 3 << 21):
            held, seen = [], np.zeros(0, np.uint64)
            for batch in slices(whole):
                value, places = _sets(batch.column(0), n)
                print_ = _prints(value, places)[0]
                size = np.diff(places)
                _, first = np.unique(print_, return_index=True)
                use = np.zeros(len(print_), bool)
                use[first] = True
                use &= (size > 0) & ~np.isin(print_, seen)  # a set once a chunk
                seen = np.concatenate([seen, print_[use]])
                inside = np.repeat(use, size)
                held.append((value[inside], np.repeat(print_, size)[inside]))
            value, class_ = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            order = np.argsort(value)
            value, class_ = value[order], class_[order]
            several = _frequency(value) > 1
            names, count = np.unique(class_[several], return_counts=True)
            common = np.unique(value[several])
            value, class_ = value[~several], class_[~several]
            ids, rows = [], []
            if len(names):
                ids.append(-1 - int(names[0] % np.uint64(buckets)))
                rows.append(_frozen(names, count))
            of = (common % np.uint64(buckets)).astype(np.int32)
            many = {int(of[p[0]]): (common[p] >> np.uint64(32)).astype(np.uint32) for p in _parts(of)}
            bucket = (value % np.uint64(buckets)).astype(np.int32)
            one = {int(bucket[p[0]]): p for p in _parts(bucket)}
            for b in sorted(one.keys() | many.keys()):
                p = one.get(b, np.zeros(0, np.int64))
                short = (value[p] >> np.uint64(32)).astype(np.uint32)
                names, which = np.unique(class_[p], return_inverse=True)
                order = np.lexsort((short, which))
                count = np.bincount(which, minlength=len(names))
                count = count.astype(np.uint8 if len(count) == 0 or count.max() < 256 else np.int32)
                ids.append(b)
                named = np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()
                rows.append(_frozen(short[order], count, named, many.get(b, np.zeros(0, np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Thawed parts of each bucket; rows are sorted by bucket. Those of buckets below zero come one by one."""
    bucket, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (b != bucket or b < 0) and blobs:
                yield [_thawed(x) for x in blobs]
                blobs = []
            bucket = b
            blobs.append(blob)
    if blobs:
        yield [_thawed(x) for x in blobs]


def _entries(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Values and owners, sorted by value."""
    value = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([np.repeat(p[2], p[1]) for p in parts])
    order = np.lexsort((owner, value))
    return value[order], owner[order]


def _frequency(value: np.ndarray) -> np.ndarray:
    """How often each of sorted values occurs."""
    if not len(value):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(at, len(value)))
    return np.repeat(count, count)


def _shared(buckets: int):
    """For the bucket of each class, packed: how many of its shingles in the fragments of a task others have too."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names, count = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            names, which = np.unique(names, return_inverse=True)
            count = np.bincount(which, count).astype(np.int32)
            bucket = (mix(names) % np.uint64(buckets)).astype(np.int32)
            parts = _parts(bucket)
            packed = [_frozen(names[p], count[p]) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])

        for parts in _by_bucket(batches):
            if len(parts[0]) == 2:  # counts of a chunk
                held.append(parts[0])
                if sum(len(h[0]) for h in held) > 1 << 19:
                    yield flush()
                continue
            value, count = (np.concatenate([p[k] for p in parts]) for k in range(2))
            names = np.concatenate([np.cumsum(np.ascontiguousarray(p[2].T).view(np.uint64).ravel(), dtype=np.uint64) for p in parts])
            # a class that came from several chunks counts once; what it lacks here, the chunk has counted
            _, at = np.unique(names, return_index=True)
            use = np.zeros(len(names), bool)
            use[at] = True
            owner = np.repeat(np.arange(len(names)), count)
            many = np.unique(np.concatenate([p[3] for p in parts]))
            value, owner = np.concatenate([value[use[owner]], many, many]), np.concatenate([owner[use[owner]], np.full(2 * len(many), len(names))])
            order = np.argsort(value)
            shared = np.bincount(owner[order[_frequency(value[order]) > 1]], minlength=len(names) + 1)[: len(names)]
            at = np.flatnonzero(shared)
            held.append((names[at], shared[at]))
            if sum(len(h[0]) for h in held) > 1 << 19:
                yield flush()
        if held:
            yield flush()

    return run


@released
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the buckets of classes: each class once, with the sum of its parts."""
    for parts in _by_bucket(batches):
        names, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        names, which = np.unique(names, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(which, count).astype(np.int64))], ["one", "shared"])


def _keep_sets(n: int):
    """(id, one, text) in; the set of each row whose class it names, packed."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                value, places = _sets(batch.column(2), n)
                ok = np.flatnonzero(_prints(value, places)[0].view(np.int64) == batch.column(1).to_numpy())
                packed = [value[a:b].tobytes() for a, b in zip(places[ok].tolist(), places[ok + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(np.diff(places)[ok]), pa.array(packed, pa.binary())], ["id", "size", "members"])

    return run


def _send_sets(buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                raw = batch.column(1).to_pylist()
                value = np.frombuffer(b"".join(raw), np.uint64)
                sizes = np.array([len(r) // 8 for r in raw], np.int64)
                owner, size = np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes)
                bucket = (value % np.uint64(buckets)).astype(np.int64)
                ids, rows = [], []
                for p in _parts(bucket):
                    p = p[np.lexsort((value[p], owner[p]))]
                    names, first, count = np.unique(owner[p], return_index=True, return_counts=True)
                    ids.append(int(bucket[p[0]]))
                    rows.append(_frozen(value[p], count, names, size[p[first]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"])

    return run


def _frequencies(buckets: int):
    """For the bucket of each class, packed: shingles that others have too, and in how many classes each lies."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            value, count, owner, size = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            bucket = (mix(owner.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            parts = _parts(bucket)
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([_frozen(value[p], count[p], owner[p], size[p]) for p in parts], pa.binary())], ["bucket", "packed"])

        for parts in _by_bucket(batches):
            value, owner = _entries(parts)
            count = _frequency(value)
            at = count > 1
            names, first = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
            sizes = np.concatenate([p[3] for p in parts])[first]
            held.append((value[at], count[at].astype(np.int32), owner[at], sizes[np.searchsorted(names, owner[at])].astype(np.int32)))
            if sum(len(h[0]) for h in held) > 1 << 20:
                yield flush()
        if held:
            yield flush()

    return run


def _prefixes(percent: int):
    """Prefix shingles of the classes that can still link, from the buckets of classes."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_bucket(batches):
            value, count, owner, size = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((value, count, owner))  # each class in the order of all shingles, rare ones first
            value, count, owner, size = value[order], count[order].astype(np.int64), owner[order], size[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
            shared = np.diff(np.append(first, len(owner)))
            n = size[first]
            # shingles that only this class has stand first in the order, and link with nothing
            length = n - -(-percent * n // 100) + 1 - (n - shared)
            length[100 * shared < percent * n] = 0
            place = np.arange(len(owner)) - np.repeat(first, shared)
            at = place < np.repeat(length, shared)
            common = np.add.reduceat(np.log(count), first) / n if len(first) else np.zeros(0)
            made = [value.view(np.int64), owner, size, np.repeat(common, shared)]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in made], ["shingle", "id", "size", "common"])

    return run


@released
def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set cut at fixed places of the order of all shingles."""
    for batch in batches:
        ids, numbers, parts = [], [], []
        for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            value = np.frombuffer(raw, np.uint64)
            cuts = np.searchsorted(value, np.arange(FRAGMENTS + 1, dtype=np.float64) * 2.0**64 / FRAGMENTS)
            for k in range(FRAGMENTS):
                if cuts[k] < cuts[k + 1]:
                    ids.append(id_)
                    numbers.append(k)
                    parts.append(value[cuts[k] : cuts[k + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["id", "fragment", "part"])


@released
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        count = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), True)) for a, b in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64())], ["a", "b", "overlap"])


def overlaps(pairs: DataFrame, sets: DataFrame, star: int = STAR) -> DataFrame:
    """(a, b, overlap) for pairs (a, b) of sets (id, members): partial overlaps by fragment, summed.

    An ``a`` with over ``star`` pairs is several tasks, with a copy of its set each.
    """
    parts = sets.select("id", "members").mapInArrow(_fragments, "id long, fragment int, part binary")
    left = parts.select(F.col("id").alias("a"), "fragment", F.col("part").alias("left"))
    large = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / star).cast("int").alias("copies")).where("copies > 1"))
    found = large.count()
    if found:
        large = F.broadcast(large) if found <= BROADCAST else large
        copy = F.coalesce(F.pmod(F.xxhash64("b"), "copies"), F.lit(0)).cast("int").alias("copy")
        pairs = pairs.join(large, "a", "left").select("a", "b", copy)
        left = left.join(large, "a", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        met = pairs.join(left, ["a", "copy"])
    else:
        met = pairs.join(left, "a")
    met = met.join(parts.select(F.col("id").alias("b"), "fragment", F.col("part").alias("right")), ["b", "fragment"])
    partial = met.select("a", "b", "left", "right").mapInArrow(_overlaps, "a long, b long, overlap long")
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _block_overlaps(asked: list[np.ndarray], held: list[np.ndarray]) -> np.ndarray:
    """Overlaps of each of ``asked`` with each of ``held`` (sets of sorted values): partial ones by fragment, summed."""
    sides = []
    for sets in (asked, held):
        value = np.concatenate(sets)
        sides.append((value, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for value, owner in sides:
        at = np.minimum(np.searchsorted(both, value), max(len(both) - 1, 0))
        ok = both[at] == value if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], owner[ok][order]))
    total = np.zeros((len(asked), len(held)), np.int64)
    for first in range(0, len(both), FRAGMENT):
        last = min(first + FRAGMENT, len(both))
        marks = []
        for (at, owner), sets in zip(places, (asked, held), strict=True):
            low, high = np.searchsorted(at, [first, last])
            mark = np.zeros((len(sets), last - first), np.float32)
            mark[owner[low:high], at[low:high] - first] = 1
            marks.append(mark)
        total += (marks[0] @ marks[1].T).astype(np.int64)
    return total


def _meet(percent: int):
    """(pivot, block, asks, id, component, members) sorted by the first three in; a forest of links (a, b) out."""

    def links(asked: list[tuple], held: list[tuple]) -> pa.RecordBatch | None:
        overlap = _block_overlaps([x[2] for x in asked], [x[2] for x in held])
        size = [np.array([len(x[2]) for x in side], np.int64) for side in (asked, held)]
        component = [np.array([x[1] for x in side], np.int64) for side in (asked, held)]
        union = size[0][:, None] + size[1] - overlap
        a, b = np.nonzero((overlap * 100 >= union * percent) & (component[0][:, None] != component[1]))
        if not len(a):
            return None
        ids = [np.array([x[0] for x in side], np.int64) for side in (asked, held)]
        nodes, roots = forest(ids[0][a], ids[1][b])
        far = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], ["a", "b"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, asked, size = None, [], [], 0
        for batch in batches:
            for pivot, block, asks, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, block) != group:
                    if asked and held and (found := links(asked, held)) is not None:
                        yield found
                    group, held, asked, size = (pivot, block), [], [], 0
                row[2] = np.frombuffer(row[2], np.uint64)
                (asked if asks else held).append(row)
                size += len(row[2]) if asks else 0
                if len(asked) >= BLOCK_SETS or size >= BLOCK_SHINGLES:
                    if held and (found := links(asked, held)) is not None:
                        yield found
                    asked, size = [], 0
        if asked and held and (found := links(asked, held)) is not None:
            yield found

    return run


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = width(spark)
    packed = "bucket int, packed binary"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = saved(docs.mapInArrow(_describe(n), "doc_id long, size long, one long, two long"))
    whole = described.where("doc_id is not null and size > 0")
    classes = whole.groupBy("one", "two", "size").agg(F.min("doc_id").alias("id"))

    # 2: classes that share enough with any others
    def dealt(sent: DataFrame) -> DataFrame:
        return sent.repartition(parts, "bucket").sortWithinPartitions("bucket")

    usable = docs.where("doc_id is not null and text is not null")
    buckets = max(parts, (whole.agg(F.sum("size")).first()[0] or 0) // FRAGMENT_SHINGLES)
    shared = dealt(usable.select("text").mapInArrow(_send_shingles(n, buckets), packed)).mapInArrow(_shared(buckets), packed)
    shared = dealt(shared).mapInArrow(_summed, "one long, shared long")
    left = saved(classes.join(shared, "one").where(F.col("shared") * 100 >= F.col("size") * percent).select("id", "one"))
    count = left.count()

    # 3: their sets, frequencies and prefixes
    chosen = F.broadcast(left) if count <= BROADCAST else left
    rows = usable.join(chosen, usable["doc_id"] == chosen["id"]).select("id", "one", "text")
    sets = saved(rows.mapInArrow(_keep_sets(n), "id long, size long, members binary").dropDuplicates(["id"]))
    buckets = max(parts, (sets.agg(F.sum("size")).first()[0] or 0) // FRAGMENT_SHINGLES)
    counted = dealt(sets.select("id", "members").mapInArrow(_send_sets(buckets), packed)).mapInArrow(_frequencies(buckets), packed)
    lists = saved(dealt(counted).mapInArrow(_prefixes(percent), "shingle long, id long, size long, common double"))

    # 4: each with the pivot of its lists
    pivots = lists.groupBy("shingle").agg(F.max(F.struct("common", (-F.col("id")).alias("id"), "size")).alias("p"), F.count("*").alias("n")).where("n > 1")
    pivots = pivots.select("shingle", (-F.col("p.id")).alias("pivot"), F.col("p.size").alias("pivot_size"))
    beside = lists.join(pivots, "shingle").where("id != pivot").select("pivot", "pivot_size", "id", "size").distinct()
    beside = saved(beside)
    near = F.least("size", "pivot_size") * 100 >= F.greatest("size", "pivot_size") * percent
    stars = beside.where(near).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    sizes = sets.select("id", "size")
    compared = overlaps(stars, sets).join(sizes.select(F.col("id").alias("a"), F.col("size").alias("n")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("m")), "b")
    links = saved(compared.where(F.col("overlap") * 100 >= (F.col("n") + F.col("m") - F.col("overlap")) * percent).select("a", "b"))
    component = saved(connected_components(links).select(F.col("node").alias("id"), "component"))

    # 5: what is left over in the lists of each pivot, in blocks
    member = beside.join(component, "id", "left").join(component.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_component")), "pivot", "left")
    member = saved(member.select("pivot", "id", "size", F.coalesce("component", "id").alias("component"), (F.coalesce("component", "id") != F.coalesce("pivot_component", "pivot")).alias("apart")))
    blocks = member.groupBy("pivot").agg(F.bool_or("apart").alias("any"), F.count("*").alias("n"), F.sum("size").alias("s")).where("any and n > 1")
    blocks = blocks.select("pivot", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = member.join(blocks, "pivot")
    held = member.select("pivot", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "id", "component")
    asking = member.where("apart").select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "component")
    met = held.union(asking).join(sets.select("id", "members"), "id").select("pivot", "block", "asks", "id", "component", "members")
    more = met.repartition(parts, "pivot", "block").sortWithinPartitions("pivot", "block", "asks").mapInArrow(_meet(percent), "a long, b long")

    # documents of a class, and those that share a doc_id, are linked by their ids already
    found = connected_components(links.union(more)).withColumnRenamed("node", "id")
    known = classes.join(found, "id", "left").select("one", "two", "size", F.coalesce("component", "id").alias("component_id"))
    placed = whole.join(known, ["one", "two", "size"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = described.select("doc_id", F.col("size").alias("n_shingles")).join(placed, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under links of Jaccard 0.8 or more between sets of 5-word shingles."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
