"""A training-data pipeline over ``documents``: five stages, each on all that its predecessor kept.

Every stage is written as Parquet in the shared folder and read again as the next one's documents.

Only the columns of documents are read; extra ones go with the first stage. Null and empty texts have no language and
go there as well. Texts of any length are read whole. An empty table leaves no documents, and no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import jaccard_join, language_id, packing, secret_scan, superkmers
from barline.llm._session import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others (no letters, or no language above a third) go."""
    net = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.identify(docs, net)
    return judged.where("lang_pred != 'und' and score >= 1 / 3D").select(*COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: of the smallest doc_id, and of rows that share it, one with text.

    Rows without doc_id are compared with no others; of those that are equal in all columns one stays.
    """
    first = jaccard_join.similar_components(docs).where("doc_id = component_id")
    first = saved(first.groupBy("doc_id").count())
    docs = docs.select(*COLUMNS)
    once = docs.join(first.where("count = 1"), "doc_id", "left_semi")
    repeated = docs.join(first.where("count > 1"), "doc_id", "left_semi")
    order = F.struct(F.col("text").isNull(), F.xxhash64("text"), *COLUMNS)
    repeated = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), order).alias("row")).select("row.*")
    return once.union(repeated).union(docs.where("doc_id is null").distinct())


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; documents of which nothing is left go."""
    kept = superkmers.dedup_substrings(docs).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    clean = secret_scan.fit_and_redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 1024 ids."""
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("substring dedup", remove_repeats),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Training a network and packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
