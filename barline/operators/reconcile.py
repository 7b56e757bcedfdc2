"""Deduplication, reconciliation with stored tables, and integrity checks.

A sync returns (new table, rows to append or change, counts) and writes nothing: ``publish`` writes once, after
all checks.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clean import COMPANY, INCOME_STATEMENT, NEWS, PRICE, clean_company, clean_income_statement, clean_news, clean_price, clean_symbol, conform, trimmed
from .lookup import companies_of, new_rows, rekey, securities_of
from .validate import is_us_equity, reject_invalid_batches, require, require_same_symbol, require_symbol, valid_company, valid_income_statement, valid_news, valid_price

# Concepts of a statement, the tags that report each in the order of preference, preferred units.
CONCEPTS = ("total_revenue", "gross_profit", "operating_income", "net_income", "eps", "shares_outstanding")

FACT_TAGS = {
    "total_revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "eps": ["EarningsPerShareDiluted", "EarningsPerShareBasic"],
    "shares_outstanding": ["WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic"],
}
FACT_UNITS = {"total_revenue": "USD", "gross_profit": "USD", "operating_income": "USD", "net_income": "USD", "eps": "USD-per-shares", "shares_outstanding": "shares"}


def normalise_universe(df: DataFrame) -> DataFrame:
    made = {"cik": trimmed(F.col("cik")), "name": trimmed(F.col("name")), "symbol": clean_symbol(F.col("symbol")), "exchange": clean_symbol(F.coalesce("exchange", F.lit("")))}
    return df.withColumns(made).where("cik != '' and name != '' and symbol != ''")


def dedupe_universe(df: DataFrame, position: str = "pos") -> DataFrame:
    """The last record of each (cik, symbol) by position."""
    rest = [c for c in df.columns if c not in ("cik", "symbol")]
    return df.groupBy("cik", "symbol").agg(F.max_by(F.struct(*rest), position).alias("r")).select("cik", "symbol", "r.*")


def symbol_conflicts(df: DataFrame) -> DataFrame:
    """Symbols with two ciks."""
    return df.groupBy("symbol").agg(F.count_distinct("cik").alias("n_ciks")).where("n_ciks > 1")


def representatives(df: DataFrame) -> DataFrame:
    """For each cik the name under its smallest symbol, and how many listings it has."""
    return df.groupBy("cik").agg(F.min_by("name", "symbol").alias("name"), F.count("*").alias("listings"))


def merge_companies(companies: DataFrame, feed: DataFrame) -> DataFrame:
    """By cik: new companies come in with an empty profile, known ones take the name, absent ones stay."""
    rest = [c for c in companies.columns if c not in ("cik", "name")]
    empty = {"market_cap": F.lit(None).cast("long")}
    fresh = F.col("__new").isNotNull() & F.col("__old").isNull()
    joined = companies.withColumn("__old", F.lit(1)).join(feed.select("cik", F.col("name").alias("__name")).withColumn("__new", F.lit(1)), "cik", "full")
    profile = [F.when(fresh, empty.get(c, F.lit("" if dict(companies.dtypes)[c] == "string" else None))).otherwise(F.col(c)).alias(c) for c in rest]
    return joined.select("cik", F.coalesce("__name", "name").alias("name"), *profile)


def merge_securities(securities: DataFrame, feed: DataFrame) -> DataFrame:
    """By symbol: new listings come in, those of the same company take the exchange, another company's raise. Other
    columns of ``securities`` stay, and are null for new ones."""
    f = feed.select("symbol", F.col("cik").alias("__cik"), F.col("exchange").alias("__exchange"))
    joined = securities.join(f, "symbol", "full")
    clash = F.col("cik").isNotNull() & F.col("__cik").isNotNull() & (F.col("cik") != F.col("__cik"))
    joined = joined.where(F.when(clash, F.raise_error(F.concat(F.lit("another company has "), "symbol")).cast("boolean")).otherwise(True))
    made = {"symbol": F.col("symbol"), "cik": F.coalesce("cik", "__cik"), "exchange": F.coalesce("__exchange", "exchange")}
    return joined.select(*[made[c].alias(c) if c in made else c for c in securities.columns])


def sync_universe(companies: DataFrame, securities: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both tables after a feed of (cik, symbol, name, exchange, pos), and the number of listings taken."""
    listed = dedupe_universe(normalise_universe(feed)).where(is_us_equity(F.col("exchange")))
    by_symbol = listed.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("n_ciks"))
    taken, ciks, symbol = by_symbol.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n_ciks"), F.max_by("symbol", "n_ciks")).first()
    if (ciks or 0) > 1:
        raise ValueError(f"{symbol} is listed under several ciks")
    return merge_companies(companies, representatives(listed)), merge_securities(securities, listed), taken


def staged_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], valid: Column, batch: str, first_by: Column | None = None) -> DataFrame:
    """The rows that an insert-only sync appends: of batches whose rows are all valid those with a new key.

    Of rows with one key the first by ``first_by`` stays; without it such rows raise while they are written, as do null
    keys, so that nothing is written then.
    """
    staged = new_rows(reject_invalid_batches(incoming, batch, valid), existing, keys)
    same = Window.partitionBy(*keys)
    if first_by is not None:
        return staged.withColumn("__n", F.row_number().over(same.orderBy(first_by))).where("__n = 1").drop("__n")
    counted = staged.withColumn("__n", F.count(F.lit(1)).over(same))
    shown = F.to_json(F.struct(*keys))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    fault = F.when(no_key, F.concat(F.lit("a key is null: "), shown)).when(F.col("__n") > 1, F.concat(F.lit("twice in one batch: "), shown))
    return counted.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).drop("__n")


def sync_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], valid: Column, batch: str, on_duplicate: str = "error", first_by: Column | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Insert-only sync of prices, news or statements: batches with an invalid row are left out whole.

    Duplicates in a batch raise, or with ``on_duplicate="first"`` the first by ``first_by`` (by all columns where that is
    not given) stays. One job counts the rows and looks for duplicates; ``staged_rows`` with ``append_batch`` does both
    while it writes.
    """
    staged = new_rows(reject_invalid_batches(incoming, batch, valid), existing, keys)
    if on_duplicate == "first":
        order = first_by if first_by is not None else F.struct(*sorted(incoming.columns))
        staged = staged_rows(existing, incoming, keys, valid, batch, order)
        return existing.unionByName(staged, allowMissingColumns=True), staged, staged.count()
    once = staged.groupBy(*keys).agg(F.count("*").alias("n"))
    found = once.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max_by(F.struct(*keys), "n"), F.max("n")).first()
    if (found[2] or 0) > 1:
        raise ValueError(f"twice in one batch: {found[1].asDict()}")
    return existing.unionByName(staged, allowMissingColumns=True), staged, found[0]


def price_records(incoming: DataFrame, securities: DataFrame) -> DataFrame:
    """Prices (symbol and a price record) resolved to security_id, conformed and cleaned.

    A blank or unknown symbol and a record that does not conform raise.
    """
    rows = clean_price(conform(incoming.withColumn("symbol", clean_symbol(F.col("symbol"))), PRICE, keys=("symbol",)))
    owners = securities_of(require_symbol(rows), securities).select("symbol", F.col("id").alias("security_id"))
    return rekey(rows, "symbol", "security_id", owners)


def sync_prices(existing: DataFrame, incoming: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Prices by new security and date: resolved, conformed, cleaned, and validated whole for each security."""
    return sync_rows(existing, price_records(incoming, securities), ["security_id", "date"], valid_price(), "security_id")


def sync_news(existing: DataFrame, incoming: DataFrame, securities: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """News (symbol and a news record) after resolving, conforming, cleaning and whole-batch validation, by new url.

    An unknown symbol and a record that does not conform raise; a symbol with an invalid record is left out whole. Of
    records with one url the first by ``pos``, if there is such a column, and then by the other columns stays.
    """
    keys = ("symbol", "pos") if "pos" in incoming.columns else ("symbol",)
    rows = clean_news(conform(incoming.withColumn("symbol", clean_symbol(F.col("symbol"))), NEWS, keys=keys))
    owners = companies_of(require_symbol(rows), securities, companies).select("symbol", "company_id")
    rows = rekey(rows, "symbol", "company_id", owners)
    rest = [c for c in rows.columns if c != "pos"]
    first = F.struct(*[c for c in ("pos",) if c in rows.columns], *sorted(rest))
    _, staged, count = sync_rows(existing, rows, ["url"], valid_news(), "company_id", "first", first)
    staged = staged.select(*rest)
    return existing.unionByName(staged, allowMissingColumns=True), staged, count


def sync_statements(existing: DataFrame, incoming: DataFrame, securities: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Statements (symbol and a statement record), as ``sync_news``, by new company and fiscal date."""
    rows = clean_income_statement(conform(incoming.withColumn("symbol", clean_symbol(F.col("symbol"))), INCOME_STATEMENT, keys=("symbol",)))
    owners = companies_of(require_symbol(rows), securities, companies).select("symbol", "company_id")
    return sync_rows(existing, rekey(rows, "symbol", "company_id", owners), ["company_id", "fiscal_date"], valid_income_statement(), "company_id")


def sync_profiles(companies: DataFrame, incoming: DataFrame, securities: DataFrame) -> DataFrame:
    """Companies (with id and cik) after the profiles of requested symbols; one that is invalid or answers for another
    symbol raises."""
    rows = clean_company(conform(incoming.withColumn("requested_symbol", clean_symbol(F.col("requested_symbol"))), COMPANY, keys=("requested_symbol",)))
    rows = require_same_symbol(require(rows, ~valid_company(), "a profile is invalid"))
    owners = companies_of(rows, securities, companies.select("id", "cik")).select("symbol", "cik")
    return update_profiles(companies, rows.join(owners, "symbol"))


def statements_of_facts(facts: DataFrame) -> DataFrame:
    """Annual statements of long facts as ``parse_facts`` gives them, by the preferred tags and units."""
    return annual_statements(first_available(facts, FACT_TAGS, FACT_UNITS))


def update_profiles(companies: DataFrame, incoming: DataFrame) -> DataFrame:
    """Profiles of known companies overwritten, and their cik where ``new_cik`` has one; none is created here."""
    changed = [c for c in ("name", "sector", "industry", "country", "website", "market_cap") if c in incoming.columns]
    given = ["new_cik"] if "new_cik" in incoming.columns else []
    new = incoming.select("cik", F.lit(True).alias("__hit"), *given, *[F.col(c).alias(f"__{c}") for c in changed])
    joined = companies.join(new, "cik", "left")
    made = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in changed} | {"cik": F.coalesce("new_cik", "cik") for _ in given}
    return joined.select(*[made[c].alias(c) if c in made else c for c in companies.columns])


def first_available(facts: DataFrame, tags: dict[str, list[str]], units: dict[str, str]) -> DataFrame:
    """Of long facts (cik, tag, unit, unit_pos, ...) those that stand for each concept.

    The first tag of a concept that has any unit counts, in its preferred unit or else its first one. The choice
    is made for a company and concept, not for a date.
    """
    rows = [(c, t, k, units.get(c)) for c, names in tags.items() for k, t in enumerate(names)]
    wanted = facts.sparkSession.createDataFrame(rows, "concept string, tag string, tag_pos int, preferred string")
    found = facts.join(F.broadcast(wanted), "tag")
    rank = F.struct("tag_pos", (~F.col("unit").eqNullSafe(F.col("preferred"))).cast("int").alias("other"), "unit_pos")
    best = found.groupBy("cik", "concept").agg(F.min_by(F.struct("tag", "unit"), rank).alias("b")).select("cik", "concept", "b.*")
    return found.join(best, ["cik", "concept", "tag", "unit"]).drop("tag_pos", "preferred")


def is_annual() -> Column:
    return F.coalesce(F.col("form").isin("10-K", "10-K/A") & (F.col("fp") == "FY"), F.lit(False))


def annual_statements(facts: DataFrame) -> DataFrame:
    """Facts (cik, concept, end, val, form, fp, filed, pos) as one row for each company and fiscal date of revenue."""
    annual = facts.where(is_annual() & F.col("end").isNotNull()).withColumn("fiscal_date", F.to_date("end"))
    latest = F.struct(F.coalesce("filed", F.lit("")), -F.col("pos"))
    columns = []
    for concept in CONCEPTS:
        mine = (F.col("concept") == concept) & F.col("val").isNotNull()
        value = F.max_by(F.when(mine, F.col("val")), F.when(mine, latest))
        columns.append(value.cast("long" if concept == "shares_outstanding" else "double").alias(concept))
    out = annual.groupBy("cik", "fiscal_date").agg(F.bool_or(F.col("concept") == "total_revenue").alias("__dated"), *columns)
    return out.where("__dated").drop("__dated")


def write_representatives(companies: DataFrame, securities: DataFrame) -> DataFrame:
    """Companies (with id) with symbol and exchange of their representative listing; those without a listing keep theirs."""
    found = representative_listings(securities).select(F.col("company_id").alias("__id"), F.col("symbol").alias("__symbol"), F.col("exchange").alias("__exchange"))
    joined = companies.join(found, companies["id"] == found["__id"], "left")
    made = {c: F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("symbol", "exchange")}
    return joined.select(*[made[c].alias(c) if c in made else c for c in companies.columns])


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, whose evaluation fails on a row with a null key: the audit and the job that uses its rows are one."""
    wrong = F.lit(False)
    for k in keys:
        wrong = wrong | F.col(k).isNull()
    return require(df, wrong, f"a key is null: {keys}")


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    wrong = F.lit(False)
    for k in keys:
        wrong = wrong | F.col(k).isNull()
    return df.where(wrong)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return children.join(parents, on, "left_anti")


def derive_securities(companies: DataFrame) -> DataFrame:
    return companies.select(F.col("id").alias("company_id"), "symbol", "exchange")


def representative_listings(securities: DataFrame) -> DataFrame:
    """The listing with the lowest id of each company."""
    return securities.groupBy("company_id").agg(F.min_by(F.struct("symbol", "exchange"), "id").alias("s")).select("company_id", "s.*")


def first_of_each(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be greater than zero")
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def publish(df: DataFrame, path: str, append: bool = False) -> None:
    """One write job: its commit makes all rows visible or none."""
    df.write.mode("append" if append else "errorifexists").parquet(path)


def publish_all(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes tables as one new version of a folder; readers see all of them or, until the last is written, none."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{folder}/v{time.time_ns():020}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{version}/_COMPLETE")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest complete version of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().getName() for s in files.listStatus(where))
    done = [v for v in versions if v.startswith("v") and files.exists(path(f"{folder}/{v}/_COMPLETE"))]
    if not done:
        raise LookupError(f"{folder} has no complete version")
    return spark.read.parquet(f"{folder}/{done[-1]}/{name}")
