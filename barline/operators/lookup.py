"""Joins and lookups between companies, securities, prices, news and statements.

Spark chooses the join. Strict forms raise, the others leave unknown keys out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_known(keys: DataFrame, table: DataFrame, on: list[str]) -> None:
    """Raises if a key is not in the table."""
    missing = keys.select(*on).distinct().join(table, on, "left_anti").limit(1).collect()
    if missing:
        raise LookupError(f"not found: {missing[0].asDict()}")


def securities_of(symbols: DataFrame, securities: DataFrame, strict: bool = True) -> DataFrame:
    if strict:
        require_known(symbols, securities, ["symbol"])
    return symbols.select("symbol").distinct().join(securities, "symbol")


def with_company(securities: DataFrame, companies: DataFrame, strict: bool = True) -> DataFrame:
    """Securities with their companies' columns. A security whose company is missing raises, or is left out."""
    joined = securities.join(companies.withColumnRenamed("id", "company_id").withColumn("__known", F.lit(True)), "company_id", "left" if strict else "inner")
    known = F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat(F.lit("no company "), F.col("company_id").cast("string"))).cast("boolean"))
    return (joined.where(known) if strict else joined).drop("__known")


def companies_of(symbols: DataFrame, securities: DataFrame, companies: DataFrame) -> DataFrame:
    """(symbol, company_id and the company's columns) of cleaned symbols; one without listing or company raises."""
    return with_company(securities_of(symbols, securities).select("symbol", "company_id"), companies)


def security_of(securities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Securities by company and symbol."""
    return among(securities, wanted, ["company_id", "symbol"])


def ciks_of(symbols: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """(symbol, cik) of symbols; an unknown one raises."""
    joined = symbols.select("symbol").distinct().join(ticker_map.select("symbol", "cik"), "symbol", "left")
    return joined.withColumn("cik", F.coalesce("cik", F.raise_error(F.concat(F.lit("no cik for "), "symbol"))))


def prices(securities: DataFrame, prices: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Bars with their symbols, all of them or of some symbols; order by date where an order is shown."""
    chosen = securities if symbols is None else securities.where(F.col("symbol").isin(symbols))
    return prices.join(chosen.select(F.col("id").alias("security_id"), "symbol"), "security_id")


def company_news(securities: DataFrame, news: DataFrame, symbol: str) -> DataFrame:
    """Newest first; undated news come before all others."""
    owner = securities.where(F.col("symbol") == symbol).select("company_id")
    return news.join(owner, "company_id", "left_semi").orderBy(F.col("published_at").desc_nulls_first())


def newest_first(news: DataFrame) -> DataFrame:
    """The news of every company with their ``place``: newest first, undated ones before all others, ties by url."""
    order = Window.partitionBy("company_id").orderBy(F.col("published_at").desc_nulls_first(), "url")
    return news.withColumn("place", F.row_number().over(order))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Prices by (security_id, date), news by url, statements by (company_id, fiscal_date)."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def among(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among ``keys``: companies by cik, securities by symbol or company."""
    return table.join(keys.select(*on), on, "left_semi")


def news_at(news: DataFrame, wanted: DataFrame) -> DataFrame:
    """News by company and time; no time matches no time."""
    w = wanted.select(F.col("company_id").alias("__c"), F.col("published_at").alias("__p")).distinct()
    return news.join(w, (news["company_id"] == w["__c"]) & news["published_at"].eqNullSafe(w["__p"]), "left_semi")


def rekey(table: DataFrame, old: str, new: str, mapping: DataFrame) -> DataFrame:
    """``table`` with the key ``new`` in place of ``old``; raises where the mapping has none."""
    joined = table.join(mapping.select(old, new), old, "left")
    return joined.where(F.when(F.col(new).isNull(), F.raise_error(f"no {new}").cast("boolean")).otherwise(True)).drop(old)


def without(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    return parents.join(children, on, "left_anti")


def latest(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("b")).select("symbol", "b.*")
