"""Cleaning and schema conformance of staged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split sees it, for Java's patterns.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Field names of the records.
TEXTS = {"company": ("name", "sector", "industry", "country", "website"), "news": ("title", "publisher", "summary", "url")}
NUMBERS = ("total_revenue", "gross_profit", "operating_income", "net_income", "eps")

_TEXT, _NUMBER, _LONG = T.StringType(), T.DoubleType(), T.LongType()
#: Schemas of the four records, for ``conform``.
COMPANY = T.StructType([T.StructField(c, _TEXT, False) for c in ("symbol", *TEXTS["company"])] + [T.StructField("market_cap", _LONG)])
PRICE = T.StructType([T.StructField("date", T.TimestampType(), False)] + [T.StructField(c, _NUMBER, False) for c in ("open", "high", "low", "close")] + [T.StructField("volume", _LONG, False), T.StructField("dividends", _NUMBER), T.StructField("stock_splits", _NUMBER)])
NEWS = T.StructType([T.StructField(c, _TEXT, False) for c in TEXTS["news"]] + [T.StructField("published_at", T.TimestampType())])
INCOME_STATEMENT = T.StructType([T.StructField("fiscal_date", T.DateType(), False)] + [T.StructField(c, _NUMBER) for c in NUMBERS] + [T.StructField("shares_outstanding", _LONG)])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_symbol(c: Column) -> Column:
    return F.upper(trimmed(c))


def clean_text(c: Column) -> Column:
    """One space for each run of white space, none at the ends; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, SPACE, " ")), F.lit(""))


def clean_company(df: DataFrame) -> DataFrame:
    return df.withColumns({"symbol": clean_symbol(F.col("symbol"))} | {c: clean_text(F.col(c)) for c in TEXTS["company"]})


def clean_news(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c)) for c in TEXTS["news"]})


def clean_price(df: DataFrame) -> DataFrame:
    doubles = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close")}
    extras = {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)) for c in ("dividends", "stock_splits")}
    return df.withColumns(doubles | extras | {"volume": F.col("volume").cast("long")})


def clean_income_statement(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in NUMBERS} | {"shares_outstanding": F.col("shares_outstanding").cast("long")})


def conform(df: DataFrame, schema: T.StructType, on_error: str = "raise", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` cast to ``schema``, with the columns ``keys`` as they are. Rows with a value that can't be cast, or a null that may not be, raise, or with
    ``on_error="mark"`` get false in ``conforms``. Missing nullable columns are null."""
    absent = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if absent:
        raise ValueError(f"missing columns: {sorted(absent)}")
    made, fine = [], F.lit(True)
    for field in schema:
        old = F.col(field.name) if field.name in df.columns else F.lit(None)
        new = old.try_cast(field.dataType)
        made.append(new.alias(field.name))
        fine = fine & ((old.isNull() & F.lit(field.nullable)) | (old.isNotNull() & new.isNotNull()))
    out = df.select(*keys, *made, fine.alias("conforms"))
    if on_error == "mark":
        return out
    return out.where(F.when(F.col("conforms"), True).otherwise(F.raise_error("a record does not conform"))).drop("conforms")
