"""The columns that readers see of prices, news, companies and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import clean_symbol
from .lookup import with_company

# Columns of the answers.
PRICES = ("date", "open", "high", "low", "close", "volume", "dividends", "stock_splits")
ARTICLES = ("title", "publisher", "summary", "url", "published_at")
COMPANIES = ("id", "symbol", "name", "sector", "industry", "country", "website", "market_cap")


def price_rows(prices: DataFrame) -> DataFrame:
    return prices.select("symbol", *PRICES)


def news_rows(news: DataFrame) -> DataFrame:
    return news.select("company_id", *ARTICLES)


def company_rows(securities: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies under each of their listings' symbols."""
    listed = securities.select("company_id", clean_symbol(F.col("symbol")).alias("symbol"))
    return with_company(listed, companies).withColumnRenamed("company_id", "id").select(*COMPANIES)


def indicator_rows(bars: DataFrame, columns: list[str], volume: bool = False) -> DataFrame:
    """Each symbol's dates with the close, the volume if the indicator reads it, and the indicator."""
    return bars.select("symbol", "date", "close", *(["volume"] if volume else []), *columns)


def universe_by_symbol(universe: DataFrame) -> DataFrame:
    return universe.orderBy("symbol")


def fiscal_dates_ascending(statements: DataFrame) -> DataFrame:
    return statements.orderBy("cik", "fiscal_date")
