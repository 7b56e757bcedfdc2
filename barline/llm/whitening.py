"""Whitening of embeddings by spectrum slicing (operator 11).

Entries are whole numbers, floor(scale * c) + shift. The covariance is that of the distinct vectors, centred before
multiplying. The number of its eigenvalues above a shift is the number of positive pivots of the LDLᵀ of the shifted
covariance (Sylvester's law of inertia; symmetric pivoting with blocks of one and two). Such counts close an
interval around each leading eigenvalue until it stands alone there; Rayleigh quotient iteration then converges
cubically, and counts on both sides of what it found certify its number. Where eigenvalues are so near that no
count tells them apart, their common interval is certified as a whole and their vectors are made orthogonal.

The distinct vectors, their sums and the products of centred rows are Spark jobs; the driver holds one matrix of the
square of the dimension, whatever the number of rows.

Vectors that are null or empty, or hold a null or non-finite entry, are left out. So are vectors of another length
than most have (of equally frequent ones the shorter counts), and entries whose whole number leaves the range of 53
bits. Rows without vec_id, or with one that repeats, are rows like others. Directions without variance have no component, so
that fewer than the wanted number can come back; one distinct vector, or none, gives no row. A deviation that
exceeds a long is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded_batches, saved
from ._words import released

#: Eigenvalues up to this share of the largest are no variance, but rounding.
RANK = 1e-12
_KINDS = (np.int16, np.int32, np.int64)


def _packed(values: np.ndarray, shift: int) -> bytes:
    """Whole numbers less the shift in the smallest type that holds them: equal vectors, equal bytes."""
    values = values - shift
    kind = next(k for k in range(3) if k == 2 or np.abs(values).max() <= np.iinfo(_KINDS[k]).max)
    return bytes([kind]) + values.astype(_KINDS[kind]).tobytes()


def _unpacked(vectors: pa.Array, shift: int) -> np.ndarray:
    """Rows of whole numbers."""
    return np.stack([np.frombuffer(v, _KINDS[v[0]], offset=1).astype(np.int64) for v in vectors.to_pylist()]) + shift


def _whole(scale: float, shift: int):
    """(vec_id, embedding) in; vec_id, dimension and packed vector of rows that are valid."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(size)
            wrong = np.concatenate([[0], np.cumsum(~(np.abs(values) < 2.0**53))])  # a NaN is not below either
            good = np.flatnonzero((size > 0) & (wrong[ends] == wrong[ends - size]))
            raw = [_packed(values[ends[k] - size[k] : ends[k]].astype(np.int64) + shift, shift) for k in good.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(size[good].astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "size", "vector"])

    return run


def _sums(shift: int):
    """The sum of every dimension over a task's vectors, as hundreds of thousands of rows at a time."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column(0), shift)
                low = x & 0xFFFFFFFF  # halves, so that no sum leaves its range
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array((x >> 32).sum(0)), pa.array(low.sum(0))], ["i", "high", "low"])

    return run


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n, rounded once: n x - S is exact."""
    if n * int(np.abs(x).max()) < 1 << 61:
        return (n * x - np.array(total, np.int64)) / n
    return ((n * x.astype(object) - np.array(total, object)) / n).astype(np.float64)


def _products(project, names: list[str]):
    """Rows of the matrix of products of a task's rows (``project`` gives them from packed vectors)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = first = None
        for batch in batches:
            if batch.num_rows:
                c = project(batch.column(0))
                total = c.T @ c if total is None else total + c.T @ c
                first = c.sum(0) if first is None else first + c.sum(0)
        if total is not None:
            made = np.hstack([total, first[:, None]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made), dtype=np.int32)), pa.array([r.tobytes() for r in made], pa.binary())], names)

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of one row of all tasks' matrices."""
    total = np.sum([np.frombuffer(v, np.float64) for v in table["row"].to_pylist()], axis=0)
    return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})


def _covariance(vectors: DataFrame, n: int, project) -> np.ndarray:
    """The covariance (divisor n) of projected vectors, every task's matrix added row by row."""
    kind = "i int, row binary"
    rows = vectors.mapInArrow(_products(project, ["i", "row"]), kind).groupBy("i").applyInArrow(_added, kind).collect()
    made = np.stack([np.frombuffer(r["row"], np.float64) for r in sorted(rows, key=lambda r: r["i"])])
    mean = made[:, -1] / n
    v = made[:, :-1] / n - np.outer(mean, mean)
    return (v + v.T) / 2


def inertia(a: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are positive, and how many are negative, from its LDLᵀ.

    Each pivot is one diagonal entry or a block of two rows, whichever keeps the rest from growing (Bunch and Kaufman).
    """
    a = np.array(a, np.float64)
    alpha = (1 + 17**0.5) / 8
    positive = negative = 0
    while (n := len(a)) > 0:
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most = column[r - 1] if n > 1 else 0.0
        pair = False
        if max(abs(a[0, 0]), most) == 0:
            a = a[1:, 1:]
            continue
        if abs(a[0, 0]) < alpha * most:
            rest = np.abs(a[r])
            rest[r] = 0
            sigma = rest.max()
            if abs(a[0, 0]) * sigma < alpha * most * most:
                if abs(a[r, r]) >= alpha * sigma:
                    order = [r, *[k for k in range(n) if k != r]]
                else:
                    order, pair = [0, r, *[k for k in range(1, n) if k != r]], True
                a = a[np.ix_(order, order)]
        if pair:
            block, low = a[:2, :2], a[2:, :2]
            positive, negative = positive + 1, negative + 1  # such a block has one eigenvalue of either sign
            a = a[2:, 2:] - low @ np.linalg.solve(block, low.T)
        else:
            d, low = a[0, 0], a[1:, 0]
            positive, negative = positive + (d > 0), negative + (d < 0)
            a = a[1:, 1:] - np.outer(low / d, low)
    return int(positive), int(negative)


def leading(v: np.ndarray, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues above rounding, falling, and their unit eigenvectors as columns."""
    size = len(v)
    above = lambda s: inertia(v - s * np.eye(size))[0]
    top = float(np.abs(v).sum(1).max())  # no eigenvalue is larger
    if not top:
        return np.zeros(0), np.zeros((size, 0))
    top *= 1 + 1e-9
    count = min(count, above(RANK * top))
    close = 4e-15 * top * size
    values: list[float] = []
    vectors = np.zeros((size, 0))
    known = {top: 0, RANK * top: above(RANK * top)}
    rng = np.random.default_rng(seed)
    while (k := len(values)) < count:
        # the interval (low, high] that holds eigenvalue k + 1 and, if counts can tell, no other
        low = max(s for s, c in known.items() if c > k)
        high = min(s for s, c in known.items() if c <= k)
        while known[low] - known[high] > 1 and high - low > close:
            middle = (low + high) / 2
            known[middle] = above(middle)
            low, high = (middle, high) if known[middle] > k else (low, middle)
        pair = None
        while known[low] - known[high] == 1 and high - low > close and (pair := _rayleigh(v, low, high, close, vectors, rng)) is None:
            middle = (low + high) / 2
            known[middle] = above(middle)
            low, high = (middle, high) if known[middle] > k else (low, middle)
        if pair is None:  # as near as rounding: found together, each orthogonal to the others
            members = _subspace(v, (low + high) / 2, vectors, known[low] - k, rng)
            found = np.einsum("ij,ij->j", members, v @ members)
            values += found.tolist()
            vectors = np.column_stack([vectors, members])
            continue
        value, vector = pair
        delta = max(close, 1e-13 * value)
        if above(value + delta) > k or above(value - delta) < k + 1:
            raise ArithmeticError(f"eigenvalue {k + 1} could not be certified")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
        # what is known stays right: a count below the eigenvalue holds it, one above does not
        known[value - delta] = above(value - delta)
    order = np.argsort(-np.array(values), kind="stable")[:count]
    return np.array(values)[order], vectors[:, order]


def _without(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - vectors @ (vectors.T @ x)
    return x / np.linalg.norm(x, axis=0)


def _solved(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """The inverse of the shifted matrix on ``x``; a shift that is an eigenvalue to the last bit moves by rounding."""
    step = 0.0
    while True:
        try:
            return np.linalg.solve(v - (shift + step) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            step = max(2 * step, 1e-16 * float(np.abs(v).max()))


def _rayleigh(v: np.ndarray, low: float, high: float, close: float, vectors: np.ndarray, rng) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of the interval; None where it leaves the interval."""
    shift = (low + high) / 2
    x = _without(rng.standard_normal(len(v)), vectors)
    x = _without(_solved(v, shift, x), vectors)
    last = np.inf
    for _ in range(30):
        shift = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - shift * x))
        if not low < shift <= high:
            return None
        if rest <= 1e-16 * abs(shift) or rest >= last / 2 and rest <= close:
            return shift, x
        last = rest
        x = _without(_solved(v, shift, x), vectors)
    return None


def _subspace(v: np.ndarray, shift: float, vectors: np.ndarray, members: int, rng) -> np.ndarray:
    """Orthogonal vectors of a cluster of eigenvalues around ``shift``, by inverse iteration of all at once."""
    x = rng.standard_normal((len(v), members))
    for _ in range(8):
        x = np.linalg.qr(_without(x, vectors))[0]
        x = _solved(v, shift, x)
    x = np.linalg.qr(_without(x, vectors))[0]
    return x


def _exact_square(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum of (n x - S) squared of each row; None beyond a long."""
    far = max(n * int(np.abs(x).max()), max(map(abs, total)))
    if far < 1 << 61:
        far = int(np.abs(d := n * x - np.array(total, np.int64)).max())
        if far * far * x.shape[1] < 1 << 62:
            return (d * d).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1)
    return [s if s < 1 << 63 else None for s in exact]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whitened(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """For each valid row of ``vectors`` (vec_id, embedding) and each component its whitened coordinate.

    Besides: n distinct vectors, the row's exact deviation, the component's eigenvalue and share of the variance, and
    how far the covariance of the whitened distinct vectors, counted anew, is from the identity.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.mapInArrow(_whole(scale, shift), "vec_id long, size int, vector binary")
    sizes = valid.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], _OUT)
    size = sizes[0]["size"]
    valid = valid.where(F.col("size") == size)
    fit = saved(valid.select("vector").distinct())
    n = fit.count()
    halves = fit.mapInArrow(_sums(shift), "i int, high long, low long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    total = [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(halves.collect(), key=lambda r: r["i"])]
    v = _covariance(fit, n, lambda c: _centred(_unpacked(c, shift), n, total))
    values, axes = leading(v, components)
    if not len(values):
        return spark.createDataFrame([], _OUT)
    axes = axes / np.sqrt(values)
    project = lambda c: _centred(_unpacked(c, shift), n, total) @ axes
    error = float(np.abs(_covariance(fit, n, project) - np.eye(len(values))).max())
    explained = values / np.trace(v)

    @released
    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                x = _unpacked(batch.column(2), shift)
                m = len(x)
                deviation = pa.array(_exact_square(x, n, total), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each),
                        pa.array((_centred(x, n, total) @ axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.tile(values, m)),
                    ],
                    [c.split()[0] for c in _OUT.split(", ")],
                )

    return valid.mapInArrow(shown, _OUT)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Up to 16 whitened coordinates of all valid rows of ``embeddings``."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
