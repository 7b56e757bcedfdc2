"""Validity of records as boolean columns, and assertions over batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import NUMBERS, trimmed

#: Exchanges that count as US equities.
US_EXCHANGES = ("NASDAQ", "NYSE", "NYSE MKT", "NYSE AMERICAN", "NYSE ARCA")
_all = lambda *parts: reduce(lambda a, b: a & b, parts)


def filled(c: str) -> Column:
    return F.coalesce(F.length(trimmed(F.col(c))) > 0, F.lit(False))


def finite(c: str) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))


def company_faults() -> Column:
    """The names of the fields that make a company invalid."""
    wrong = {c: ~filled(c) for c in ("symbol", "name", "sector", "industry", "country", "website")} | {"market_cap": F.coalesce(F.col("market_cap") < 0, F.lit(False))}
    return F.filter(F.array(*[F.when(w, F.lit(c)) for c, w in wrong.items()]), lambda c: c.isNotNull())


def valid_company() -> Column:
    return F.size(company_faults()) == 0


def valid_price() -> Column:
    ohlc = ("open", "high", "low", "close")
    order = (F.col("high") >= F.greatest("low", "open", "close")) & (F.col("low") <= F.least("open", "close"))
    return _all(F.col("date").isNotNull(), *[finite(c) & (F.col(c) >= 0) for c in ohlc], F.coalesce(F.col("volume") >= 0, F.lit(False)), finite("dividends"), finite("stock_splits"), F.coalesce(order, F.lit(False)))


def valid_news() -> Column:
    return _all(*[filled(c) for c in ("title", "publisher", "summary", "url")])


def valid_income_statement() -> Column:
    return _all(F.col("fiscal_date").isNotNull(), *[F.col(c).isNull() | finite(c) for c in NUMBERS], F.coalesce(F.col("shares_outstanding") >= 0, F.lit(True)))


def reject_invalid_batches(df: DataFrame, key: str, valid: Column) -> DataFrame:
    """The rows of the keys all of whose rows are valid: one bad row rejects its batch."""
    good = df.groupBy(key).agg(F.bool_and(valid).alias("__ok")).where("__ok").select(key)
    return df.join(good, key, "left_semi")


def is_us_equity(c: Column) -> Column:
    return F.coalesce(F.upper(c).isin(*US_EXCHANGES), F.lit(False))


def require(df: DataFrame, wrong: Column, message: str) -> DataFrame:
    """``df``, whose evaluation fails on the first row for which ``wrong`` holds."""
    return df.where(F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(True))


def same_symbol(requested: str = "requested_symbol") -> Column:
    return F.col("symbol").eqNullSafe(F.col(requested))


def require_symbol(df: DataFrame) -> DataFrame:
    return require(df, ~filled("symbol"), "a symbol is blank")


def require_same_symbol(df: DataFrame, requested: str = "requested_symbol") -> DataFrame:
    return require(df, ~same_symbol(requested), "a provider answered for another symbol")
