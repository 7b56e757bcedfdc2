"""Indicators over series that no single task should hold, and over bars that are appended to known ones.

``in_blocks`` cuts every series of over ``rows`` bars into blocks of neighbouring bars, each with the last ``halo`` bars
or more before it, so that bounded windows see what they need; one shuffle by symbol and block serves all windows.
Scans (exponential means, running sums and products, held values) take a carry from a table of one row a block, which
is broadcast; for it the columns that they scan are read once more. Exponential means of series that are much longer than such a
mean reaches back need none: their blocks have halos of that length.

``append_bars`` keeps a row of state for each symbol and indicator: the last bars and what every scan has reached. New
bars are computed from it without their history.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import Blocks, Measured, Stored, laid_out

#: Blocks in all series together, at most: what is known of them is broadcast, about 8 * (cut, count, targets) each.
MOST_BLOCKS = 20_000
#: A block is made of about so many cells, and a halo of whole cells.
CELLS = 8
#: Cells of one series, at most; blocks of longer series grow, so that their halos don't grow beside them.
_MOST_CELLS = 1 << 15
#: Quantiles of one series, at most; cells between two of them are evenly spaced.
_QUANTILES = 4096
#: Rows of a task, about, where there are more than the session's shuffle partitions take: sorted more than once in memory.
_TASK_ROWS = 1 << 18
#: Rows that a task reads from files, about, in such times the rows of a task: it holds them until it has dealt them out.
_READ = 4
#: Blocks grow to this share of a task before a series gets more cells than quantiles: hashed to tasks, they fill them evenly.
_SHARE = 8
#: Blocks have so many times the rows that exponential means reach back, and series so many such blocks, if they do without carries.
_WARM = 4
_HIDDEN = ("bar_block", "bar_halo", "bar_row", "bar_tail")


def history(function: Callable[..., DataFrame], **params) -> int:
    """Bars before a row that an indicator looks at, outside its scans: its whole-number parameters together suffice."""
    given = {name: p.default for name, p in inspect.signature(function).parameters.items() if p.default is not p.empty} | params
    flat = [v for x in given.values() for v in (x if isinstance(x, tuple) else (x,))]
    return max(54, 2 + sum(v for v in flat if isinstance(v, int) and not isinstance(v, bool)))


def _place(bars: DataFrame) -> Column:
    """The date as a number."""
    kind = bars.schema["date"].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date("date").cast("long")
    return F.unix_micros("date") if isinstance(kind, T.TimestampType) else F.col("date").cast("long")


def _with_cell(df: DataFrame, quantiles: int) -> DataFrame:
    """``df`` with __cell: how many of the cuts (fewer than ``quantiles``, a power of two) are at or before the place; 0 where
    there are no cuts.

    A binary search with a column for each step, so that it is compiled with the join before it: a row is never
    copied with the cuts of its series.
    """
    df = df.withColumn("__cell", F.lit(0))
    for k in range(quantiles.bit_length()):
        at, step = F.col("__cell"), quantiles >> k
        df = df.withColumn("__cell", F.when(F.get("__cuts", at + (step - 1)) <= F.col("__place"), at + step).otherwise(at))
    return df


def _spaced(cuts: list[int], pieces: int) -> list[int]:
    """The cuts, and evenly spaced ones between each and the next: ``pieces`` cells for one. Counts are taken of what they
    cut, so that they need not be even."""
    between = {a + (b - a) * k // pieces for a, b in zip(cuts, cuts[1:]) for k in range(1, pieces)}
    return sorted(between | set(cuts))


def _arranged(counts: list[int], rows: int, halo: int) -> list[list[tuple[int, int]]]:
    """For each cell the blocks that get it (its own first), and the place of the first bar of each."""
    before = [0, *accumulate(counts)]
    first_cell, size = [0], 0
    targets: list[list[int]] = []
    for k, n in enumerate(counts):
        if size >= rows and before[-1] - before[k] >= halo:
            first_cell.append(k)
            size = 0
        targets.append([len(first_cell) - 1])
        size += n
    places = {}
    for block, k in enumerate(first_cell):
        behind = 0
        while k > 0 and behind < halo:
            k -= 1
            behind += counts[k]
            targets[k].append(block)
        places[block] = block, before[k]
    return [[places[block] for block in blocks] for blocks in targets]


def _tasks(spark: SparkSession, rows: float) -> int:
    """Partitions of a shuffle of so many rows: what the session says, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / _TASK_ROWS))


def _read_in_shares(spark: SparkSession, rows: int) -> None:
    """So many rows are read by tasks of some rows each: shuffled into hundreds of partitions, a task holds what it reads.

    Sets ``spark.sql.files.minPartitionNum`` of the session, if that is more than its tasks are now."""
    tasks = ceil(rows / (_READ * _TASK_ROWS))
    if tasks > int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism):
        spark.conf.set("spark.sql.files.minPartitionNum", str(tasks))


def in_blocks(bars: DataFrame, rows: int, halo: int, built: Callable[..., DataFrame] | None = None, reach: int = 0) -> DataFrame | None:
    """``bars`` with bar_block, bar_halo and bar_row, every bar once in its block and again in each halo; None where no
    series has over ``rows`` bars.

    Cuts are quantiles of the dates of long series, and points between them where blocks would be too large a part of a
    task; the exact counts between them give each bar its place. The driver sees cuts and counts only, as many as there
    are cells: with over MOST_BLOCKS * rows bars in long series, or over _MOST_CELLS cells in one, blocks grow instead.

    ``built(lines, *keys)`` makes bars of lines that have a symbol and a date, grouped by these and the keys: then ``bars`` are
    such lines, cut and shuffled into blocks as they are, and each block makes its bars. Where a series is much longer than
    ``reach``, halos are that long and there is bar_tail, which is true of a bar that is in the next halo too.
    """
    if rows < max(halo, 1):
        raise ValueError("a block holds at least as many rows as a halo")
    spark = bars.sparkSession
    seen = Observation()
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("rows"))
    longest = counts.where(F.col("n") > rows).orderBy(F.desc("n")).limit(MOST_BLOCKS).collect()
    if not longest:
        return None
    most, lines = longest[0]["n"], seen.get["rows"]
    _read_in_shares(spark, lines)
    warm = 0 < reach * _WARM * _WARM <= most
    if warm:
        halo = max(halo, reach)
        rows = max(rows, halo * _WARM)
    even = min(ceil(most * CELLS / _QUANTILES), _TASK_ROWS // _SHARE)
    rows = max(rows, ceil(sum(r["n"] for r in longest) / MOST_BLOCKS), even, ceil(most * CELLS / _MOST_CELLS))
    if len(longest) == MOST_BLOCKS:  # there may be more of them: all are as short as the last
        rows = max(rows, longest[-1]["n"])
    if most <= rows:
        return None
    kind = bars.schema["symbol"].dataType
    symbol = T.StructField("__symbol", kind)
    cells = {r["symbol"]: min(_MOST_CELLS, ceil(r["n"] * CELLS / rows)) for r in longest if r["n"] > rows}
    pieces = {symbol: ceil(n / _QUANTILES) for symbol, n in cells.items()}
    quantiles = 1 << (min(_QUANTILES, max(cells.values())) - 1).bit_length()
    wanted = [(symbol, ceil(n / pieces[symbol])) for symbol, n in cells.items()]
    long = spark.createDataFrame(wanted, T.StructType([symbol, T.StructField("__cells", T.IntegerType())]))
    placed = bars.withColumn("__place", _place(bars))
    same = F.col("symbol").eqNullSafe(F.col("__symbol"))
    here = placed.select("symbol", "__place").join(F.broadcast(long), same)
    marks = F.percentile_approx("__place", [k / quantiles for k in range(1, quantiles)], 10_000)
    chosen = F.transform(F.sequence(F.lit(1), F.col("__cells") - 1), lambda k: F.get("q", (k * quantiles / F.col("__cells")).cast("int") - 1))
    found = here.groupBy("symbol", "__cells").agg(marks.alias("q")).where("__cells > 1").select("symbol", F.array_distinct(chosen).alias("cuts")).collect()
    cut = T.StructType([symbol, T.StructField("__cuts", T.ArrayType(T.LongType(), False))])
    cuts = {r["symbol"]: _spaced(sorted(r["cuts"]), pieces[r["symbol"]]) for r in found}
    most_cells = 1 << max((len(c) for c in cuts.values()), default=0).bit_length()
    known = F.broadcast(spark.createDataFrame(list(cuts.items()), cut))
    places = _with_cell(placed.select("symbol", "__place").join(known, same), most_cells).select("symbol", "__place", "__cell")
    if built:  # several lines may be one bar
        places = places.repartition(_tasks(spark, lines), "symbol", "__place").distinct()
    sizes = places.groupBy("symbol", "__cell").count().collect()
    by_symbol: dict[object, list[int]] = {s: [0] * (len(c) + 1) for s, c in cuts.items()}
    for r in sizes:
        by_symbol[r["symbol"]][r["__cell"]] = r["count"]
    target = T.StructType([T.StructField("block", T.IntegerType(), False), T.StructField("first", T.LongType(), False), T.StructField("tail", T.BooleanType(), False)])
    made = T.StructType([*cut.fields, T.StructField("__targets", T.ArrayType(T.ArrayType(target, False), False))])
    arranged = {s: [[(*to, len(cell) > 1) for to in cell] for cell in _arranged(n, rows, halo)] for s, n in by_symbol.items()}
    layout = spark.createDataFrame([(s, c, arranged[s]) for s, c in cuts.items()], made)
    dealt = _with_cell(placed.join(F.broadcast(layout), same, "left"), most_cells)
    whole = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("first"), F.lit(False).alias("tail")))
    dealt = dealt.select(*bars.columns, F.posexplode(F.coalesce(F.get("__targets", F.col("__cell")), whole)).alias("__at", "__to"))
    keys = {"bar_block": F.col("__to.block"), "bar_halo": F.col("__at") > 0, "__first": F.col("__to.first")} | ({"bar_tail": F.col("__to.tail")} if warm else {})
    dealt = dealt.select(*bars.columns, *[c.alias(name) for name, c in keys.items()])
    tasks = _tasks(spark, lines * (1 + (1 / _WARM if warm else 0) + 1 / CELLS))
    if built or tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(tasks, "symbol", "bar_block")
    if built:
        dealt = built(dealt, *keys)
    row = F.row_number().over(Window.partitionBy("symbol", "bar_block").orderBy("date")) - 1 + F.col("__first")
    return dealt.withColumn("bar_row", row).drop("__first")


def over_blocks(function: Callable[..., DataFrame], bars: DataFrame, rows: int = 1 << 20, built: Callable[..., DataFrame] | None = None, **params) -> DataFrame:
    """``function(bars, **params)``, with series of over ``rows`` bars in blocks of about so many, or of several times what
    its exponential means reach back where series are much longer still. With ``built``, ``bars`` are lines of which it makes bars."""
    halo = history(function, **params)
    whole = built(bars) if built else bars
    measured = Measured()
    with laid_out(measured):
        function(whole, **params)  # a plan, which is not run
    laid = in_blocks(bars, max(rows, halo), halo, built, measured.reach)
    if laid is None:
        return function(whole, **params)
    with laid_out(Blocks(max(rows, halo), "bar_tail" in laid.columns)):
        made = function(laid, **params)
    return made.where(~F.col("bar_halo")).drop(*_HIDDEN)


def append_bars(function: Callable[..., DataFrame], bars: DataFrame, state: DataFrame | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(new bars with the indicator, state after them).

    The state has a row for each symbol: its number of bars, its last date, the last bars (``tail``) and one carry for
    each scan. Symbols without new bars keep theirs. A bar that is not later than the last known one raises. While a
    series is no longer than its tail, it is computed from its beginning.
    """
    keep = history(function, **params)
    layout = Stored()
    names = bars.columns
    new = bars.select("*", F.lit(False).alias("bar_old"))
    if state is None:
        known = new.select("symbol").distinct().select("symbol", F.lit(0).cast("long").alias("n"), F.lit(None).cast(bars.schema["date"].dataType).alias("last"))
        carried: list[str] = []
        rows = new
    else:
        touched = state.join(bars.select("symbol").distinct(), "symbol", "left_semi")
        carried = [c for c in state.columns if c.startswith("carry_")]
        known = touched.select("symbol", "n", "last", *carried)
        tail = touched.select("symbol", F.explode("tail").alias("b")).select("symbol", "b.*").select(*names, F.lit(True).alias("bar_old"))
        rows = new.unionByName(tail)
    rows = rows.join(known, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = F.col("bar_old") | F.col("last").isNull() | (F.col("date") > F.col("last"))
    rows = rows.where(F.when(late, True).otherwise(F.raise_error(F.concat(F.lit("a bar is not later than those known of "), "symbol")).cast("boolean")))
    whole = F.col("n") <= keep  # then the tail is the whole series
    rows = rows.withColumns({c: F.when(~whole, F.col(c)) for c in carried} | {"bar_halo": F.col("bar_old") & ~whole})
    series = Window.partitionBy("symbol").orderBy("date")
    rows = rows.withColumn("bar_row", F.row_number().over(series) - 1 + F.when(whole, F.lit(0)).otherwise(F.col("n") - keep))
    with laid_out(layout):
        made = function(rows, **params)
    last = [F.max_by(F.when(~F.col("bar_halo"), F.col(s)), F.when(~F.col("bar_halo"), F.col("date"))).alias(s.replace("scan_", "carry_")) for s in layout.scans]
    bar = F.struct(*[c for c in names if c != "symbol"])
    placed = made.withColumn("__back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    recent = F.sort_array(F.collect_list(F.when(F.col("__back") <= keep, F.struct("date", bar.alias("bar")))))
    after = placed.groupBy("symbol").agg(
        (F.max("n") + F.count_if(~F.col("bar_old"))).alias("n"), F.max("date").alias("last"), F.transform(recent, lambda r: r["bar"]).alias("tail"), *last
    )
    if state is not None:
        after = after.unionByName(state.join(bars.select("symbol").distinct(), "symbol", "left_anti"))
    shown = made.where(~F.col("bar_old")).drop("bar_old", "bar_halo", "bar_row", "n", "last", *carried, *layout.scans)
    return shown, after
