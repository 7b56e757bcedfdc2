"""The registered queries of the equity library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import REGISTRY
from ..operators.long_series import append_bars, over_blocks
from . import bars, indicator_sql, records, stored, tables


#: Products over a whole series span many orders of magnitude: summed and shown as logarithms.
_LOGARITHMS = ("i30_nvi", "i31_pvi")


def _known(name: str) -> tuple[Callable[..., DataFrame], tuple[str, ...], dict]:
    """An indicator, its columns and its parameters."""
    function, columns = REGISTRY[name]
    return (function, tuple(f"{c}_ln" for c in columns), {"ln": True}) if name in _LOGARITHMS else (function, columns, {})


def _shown(column: str) -> Column:
    return F.col(column) if column == "obv" else (F.floor(F.col(column) * 10000 + 0.5) / 10000.0).alias(column)


def _indicator(name: str) -> Callable[[SparkSession, str], DataFrame]:
    function, columns, params = _known(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(bars.daily_bars(spark, sf_dir), **params).select("symbol", "date", *map(_shown, columns))

    return run


def _long(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The indicator over the tape, in blocks of 4096 bars so that small tables have several as well."""
    function, columns, params = _known(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_blocks(function, bars.tape_lines(spark, sf_dir), rows=4096, built=bars.tape_bars, **params).select("symbol", "date", *map(_shown, columns))

    return run


def _appended(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The indicator of all bars, the later half of them computed from the state after the earlier half."""
    function, columns, params = _known(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = bars.daily_bars(spark, sf_dir)
        first, state = append_bars(function, days.where("date < '1995-06-01'"), **params)
        second, _ = append_bars(function, days.where("date >= '1995-06-01'"), state, **params)
        return first.union(second).select("symbol", "date", *map(_shown, columns))

    return run


#: Indicators of appended bars that are registered: an exponential mean, a running sum, a product, nested scans.
APPENDED = ("i02_ema", "i12_obv", "i22_trix", "i30_nvi", "i33_chaikin_oscillator")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _indicator(name) for name in REGISTRY} | {f"long_{name}": _long(name) for name in indicator_sql.LONG} | {f"append_{name}": _appended(name) for name in APPENDED} | tables.queries() | records.queries() | stored.queries()


def oracle_sql() -> dict[str, str]:
    whole = indicator_sql.oracle_sql()
    return whole | indicator_sql.long_sql() | {f"append_{name}": whole[name] for name in APPENDED} | tables.oracle_sql() | records.oracle_sql() | stored.oracle_sql()
