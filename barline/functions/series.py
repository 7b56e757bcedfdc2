"""Windows and scans over ordered bars: rows of one symbol in date order.

Periods count rows, not days. A value whose window is not full, or holds a null, is null.

How a series lies in the table is its layout. By default a series is whole: one window holds it. A long one can lie in
blocks, each with some rows of the blocks before it in front (``bar_halo``); then a window holds one block, and what
a scan inherits from the blocks before is its carry. Where the rows in front are so many that an exponential mean has forgotten
what came before them (``warm``), it needs no carry, and the scans of a block begin with these rows. A stored one is new bars
behind the last rows of what is known, with carries from the stored state. Indicators are written once for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Whole:
    """Every series in one window."""

    keys: tuple[str, ...] = ("symbol",)
    parted = False
    warm = False

    def carry(self, df: DataFrame, parts: dict[str, Column], folds: dict, beside: tuple[str, ...] = ()) -> DataFrame:
        """``df`` with a column for each fold, in the order of the scans, and with the parts ``beside``, of a row's own block.
        A scan that needs no carry has None for its fold."""
        raise NotImplementedError

    def scanned(self, df: DataFrame, out: str) -> DataFrame:
        return df

    def looks_back(self, rows: int) -> None:
        """An exponential mean forgets what lies so many rows back."""


class Measured(Whole):
    """For how many rows back the exponential means of an indicator reach, together: one may be taken of another."""

    def __init__(self) -> None:
        self.reach = 0

    def looks_back(self, rows: int) -> None:
        self.reach += rows


class Blocks(Whole):
    """Series in blocks: columns bar_block, bar_halo and bar_row (the place in the series). Every block but the last of a
    series has ``rows`` own rows or more. With ``warm``, exponential means need no more than the halo, all of which lies in the
    block before; there bar_tail tells the rows that are in the halo of the next block."""

    keys = ("symbol", "bar_block")
    parted = True

    def __init__(self, rows: int, warm: bool = False) -> None:
        self.rows = rows
        self.warm = warm

    def carry(self, df: DataFrame, parts: dict[str, Column], folds: dict, beside: tuple[str, ...] = ()) -> DataFrame:
        """Folds of what the blocks before gave: one small row a block, scanned by symbol and broadcast, so that bars stay
        where they are. A fold takes a window of all blocks before, or of the last k, up to the ``to``-th before."""
        series = Window.partitionBy("symbol").orderBy("bar_block")
        before = lambda k=None, to=1: series.rowsBetween(Window.unboundedPreceding if k is None else -k, -to)
        blocks = df.groupBy("symbol", "bar_block").agg(*[c.alias(name) for name, c in parts.items()])
        found = [fold(before).alias(out) for out, fold in folds.items() if fold]
        carries = blocks.select(F.col("symbol").alias("__symbol"), F.col("bar_block").alias("__block"), *found, *beside)
        same = F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("bar_block") == F.col("__block"))
        return df.join(F.broadcast(carries), same, "left").drop("__symbol", "__block")


class Stored(Whole):
    """New bars behind stored ones: columns bar_halo, bar_row and carry_0, carry_1, ... in the order of the scans."""

    parted = True

    def __init__(self) -> None:
        self.scans: list[str] = []

    def carry(self, df: DataFrame, parts: dict[str, Column], folds: dict, beside: tuple[str, ...] = ()) -> DataFrame:
        df = df.withColumns({name: parts[name].over(Window.partitionBy(*self.keys)) for name in beside})
        names = {out: f"carry_{k}" for k, out in enumerate(folds, len(self.scans))}
        return df.withColumns({out: F.col(name) if name in df.columns else F.lit(None).cast("double") for out, name in names.items()})

    def scanned(self, df: DataFrame, out: str) -> DataFrame:
        """Keeps a copy of what a scan gave: its last value is the next carry."""
        self.scans.append(f"scan_{len(self.scans)}")
        return df.withColumn(self.scans[-1], F.col(out))


_layout: ContextVar[Whole] = ContextVar("layout", default=Whole())


@contextmanager
def laid_out(layout: Whole) -> Iterator[None]:
    token = _layout.set(layout)
    try:
        yield
    finally:
        _layout.reset(token)


def order() -> WindowSpec:
    return Window.partitionBy(*_layout.get().keys).orderBy("date")


def running() -> WindowSpec:
    """All rows up to this one."""
    return order().rowsBetween(Window.unboundedPreceding, 0)


def frame(period: int) -> WindowSpec:
    return order().rowsBetween(1 - period, 0)


def row_number() -> Column:
    """Place of a row in its series, from 0."""
    return F.col("bar_row") if _layout.get().parted else F.row_number().over(order()) - 1


def previous(column: str | Column, rows: int = 1) -> Column:
    return F.lag(column, rows).over(order())


def rolling(function, column: str | Column, period: int) -> Column:
    """An aggregate of the last ``period`` values, all of them present."""
    return F.when(F.count(column).over(frame(period)) == period, function(column).over(frame(period)))


def mean(column: str | Column, period: int) -> Column:
    return rolling(F.avg, column, period)


def total(column: str | Column, period: int) -> Column:
    return rolling(F.sum, column, period)


def highest(column: str | Column, period: int) -> Column:
    return rolling(F.max, column, period)


def lowest(column: str | Column, period: int) -> Column:
    return rolling(F.min, column, period)


def _own(column: str | Column) -> Column:
    """A value that counts in scans: not one of a halo, unless scans begin there."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.col("bar_halo"), column) if _layout.get().parted and not _layout.get().warm else column


def _given(column: str | Column, part) -> dict[str, Column]:
    """What a block gives to the carries of the blocks behind it, from an aggregate of its own values; where scans begin in
    halos, the next block gets that of the values before its halo only (``_head``)."""
    if not _layout.get().warm:
        return {"": part(_own(column))}
    column = F.col(column) if isinstance(column, str) else column
    own = F.when(~F.col("bar_halo"), column)
    return {"": part(own), "_head": part(F.when(~F.col("bar_tail"), own))}


def _scans(df: DataFrame, columns: dict[str, str], aggregate, join) -> DataFrame:
    """Running aggregates of ``columns`` by their new names; ``join`` puts what the rows before this part gave in front.
    All of them take their carries from one table."""
    layout = _layout.get()
    df = df.withColumns({out: aggregate(_own(c)).over(running()) for out, c in columns.items()})
    if layout.parted:
        carries = {out: f"__carry{k}" for k, out in enumerate(columns)}
        parts = {f"__part{k}{head}": p for k, c in enumerate(columns.values()) for head, p in _given(c, aggregate).items()}

        def fold(before, part: str) -> Column:
            if not layout.warm:
                return aggregate(F.col(part)).over(before())
            return join(aggregate(F.col(part)).over(before(to=2)), aggregate(F.col(f"{part}_head")).over(before(1)))

        df = layout.carry(df, parts, {c: lambda before, k=k: fold(before, f"__part{k}") for k, c in enumerate(carries.values())})
        df = df.withColumns({out: join(F.col(c).cast(df.schema[out].dataType), F.col(out)) for out, c in carries.items()}).drop(*carries.values())
    for out in columns:
        df = layout.scanned(df, out)
    return df


def _joined(operation):
    return lambda carry, local: F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(operation(carry, local))


def running_sum(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the sum of all rows of the series up to each one."""
    return running_sums(df, {out: column})


def running_sums(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The running sums of several columns, by their new names."""
    return _scans(df, columns, F.sum, _joined(lambda a, b: a + b))


def running_product(df: DataFrame, column: str, out: str) -> DataFrame:
    """Of a long series it may leave the range of doubles: there take the running sum of logarithms."""
    return _scans(df, {out: column}, F.product, _joined(lambda a, b: a * b))


def last_known(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the last value up to each row that is not null."""
    layout = _layout.get()
    df = df.withColumn(out, F.last(_own(column), ignorenulls=True).over(running()))
    if layout.parted:
        parts = {f"__part{head}": p for head, p in _given(column, lambda own: F.max_by(own, F.when(own.isNotNull(), F.col("date")))).items()}
        last = lambda part, window: F.last(part, ignorenulls=True).over(window)
        df = layout.carry(df, parts, {"__carry": lambda before: F.coalesce(last("__part_head", before(1)), last("__part", before(to=2))) if layout.warm else last("__part", before())})
        df = df.withColumn(out, F.coalesce(out, F.col("__carry").cast(df.schema[out].dataType))).drop("__carry")
    return layout.scanned(df, out)


def positive(**periods: float) -> None:
    for name, value in periods.items():
        if value <= 0:
            raise ValueError(f"{name} must be greater than zero")


def forgotten(decay: float) -> int:
    """After so many rows a decay is zero in doubles."""
    return math.ceil(330 / -math.log10(decay))


def exponential(df: DataFrame, column: str, out: str, period: int, first: int, seed_mean: bool = True, before: str | None = None) -> DataFrame:
    """``df`` with ``out``: e += (x - e) * 2 / (period + 1), begun at row ``first`` with the mean of the last
    ``period`` values or, without ``seed_mean``, with the value itself. ``before`` names a column for the value one row before.

    A scan without recursion: within stretches of rows the result is a weighted running sum, short enough that the
    weights stay in range; what a stretch inherits is the last value of the stretch before. All windows share the
    partitioning of the layout, so that the scan adds no shuffle. A block is one affine map, its decay and its sum; the
    maps of the blocks before make its carry: of the last ones only, since beyond them the decay is zero in doubles. For
    the same reason a block with a long halo (``warm``) needs none.
    """
    return exponentials(df, [(column, out, period, first)], seed_mean, before)


def exponentials(df: DataFrame, scans: list[tuple[str, str, int, int]], seed_mean: bool = True, before: str | None = None) -> DataFrame:
    """Several scans (column, out, period, first) that do not build on each other, with one table of carries.
    ``before`` is of the first."""
    layout = _layout.get()
    decays = [(period - 1) / (period + 1) for _, _, period, _ in scans]
    slow = [d for d in decays if d > 0]
    if slow:
        layout.looks_back(forgotten(max(slow)))
    parts, folds, begins = {}, {}, []
    each = range(len(scans))
    t, u, o, b, l, seed, known = ([f"__{x}{k}" for k in each] for x in ("t", "u", "o", "b", "l", "seed", "known"))  # noqa: E741
    made = [*t, *u, *o, *b, *l, *seed, *known, *(f"__carry{k}" for k in each)]
    df = df.withColumns({t[k]: row_number() - scans[k][3] for k in each})
    if seed_mean:  # of one window only, so that no frame slides over the others
        seeds = [F.when(F.col(t[k]).between(1 - scans[k][2], 0), F.col(scans[k][0])) for k in each]
        df = df.withColumns({known[k]: F.count(seeds[k]).over(running()) for k in each} | {seed[k]: F.avg(seeds[k]).over(running()) for k in each})
    for k, (column, _, period, _) in enumerate(scans):
        first_value = F.when(F.col(known[k]) == period, F.col(seed[k])) if seed_mean else F.col(column)
        df = df.withColumn(u[k], _own(F.when(F.col(t[k]) == 0, first_value).when(F.col(t[k]) > 0, F.col(column) * (1 - decays[k]))))
    weight = lambda k, rows: F.pow(F.lit(decays[k]), rows)
    for k in each:  # after all windows in the order of dates, so that rows are sorted once for each scan
        if decays[k] == 0:
            continue
        stretch = math.floor(200 / -math.log10(decays[k]))
        df = df.withColumns({o[k]: F.pmod(t[k], F.lit(stretch)), b[k]: F.floor(F.col(t[k]) / stretch)})
        inside = Window.partitionBy(*layout.keys, b[k]).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(l[k], weight(k, F.col(o[k])) * F.sum(F.col(u[k]) * weight(k, -F.col(o[k]))).over(inside))
        behind = Window.partitionBy(*layout.keys).orderBy(b[k], "date").rowsBetween(Window.unboundedPreceding, -1)  # sorted like ``inside``
        carried = F.last(F.when(F.col(o[k]) == stretch - 1, F.col(l[k])), ignorenulls=True).over(behind)
        df = df.withColumn(l[k], F.col(l[k]) + F.coalesce(carried * weight(k, F.col(o[k]) + 1), F.lit(0.0)))
    for k, (_, out, period, _) in enumerate(scans):
        if period == 1:
            df = df.withColumn(out, F.col(u[k]))
            folds[f"__carry{k}"] = None
            continue
        decay = decays[k]
        started = F.col(t[k]) >= 0
        df = df.withColumn(out, _own(F.when(started, F.col(l[k]))))
        counts = _own(F.when(started, F.col("date")))
        parts |= {f"__n{k}": F.count(counts), f"__e{k}": F.max_by(F.col(out), counts), f"__begin{k}": F.min(F.when(counts.isNotNull(), F.col(t[k])))}
        begins.append(f"__begin{k}")

        def fold(before_, n=f"__n{k}", e=f"__e{k}", decay=decay) -> Column:
            last = before_(2 + math.ceil(forgotten(decay) / layout.rows))
            maps = F.collect_list(F.struct(F.col(n).alias("n"), F.col(e).alias("e"))).over(last)
            step = lambda at, m: at * F.pow(F.lit(decay), m["n"]) + F.coalesce(m["e"], F.lit(0.0))
            return F.when(F.sum(n).over(last) > 0, F.aggregate(maps, F.lit(0.0), step))

        folds[f"__carry{k}"] = fold
    inherited = F.lit(None).cast("double")
    if layout.parted and not layout.warm and parts:
        df = layout.carry(df, parts, folds, tuple(begins))
        for k, (_, out, period, first) in enumerate(scans):
            if period > 1:
                since = F.col(f"__t{k}") - F.col(f"__begin{k}")
                df = df.withColumn(out, F.col(out) + F.coalesce(F.col(f"__carry{k}") * F.pow(F.lit(decays[k]), since + 1), F.lit(0.0)))
                if k == 0:
                    inherited = F.when(since == 0, F.col("__carry0"))
    if before:
        column, out, period, first = scans[0]
        value = F.when(row_number() > first, previous(column)) if period == 1 else F.coalesce(inherited, previous(out))
        df = df.withColumn(before, value)
    for _, out, _, _ in scans:
        df = layout.scanned(df, out)
    return df.drop(*made, *begins)
