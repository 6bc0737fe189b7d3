"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's rows as Parquet
to the shared scratch folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colblocks.llm.common import Scratch
from colblocks.llm.langid import identify
from colblocks.llm.line_dedup import dedup_lines
from colblocks.llm.mixing import mix, repetitions
from colblocks.llm.pieces import encode
from colblocks.llm.shingles import near_duplicates


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject. Null texts and texts without a letter go."""
    return identify(docs).where("NOT _rejected").select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a larger doc_id keeps; n_chars follows the text."""
    return dedup_lines(docs).withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def first_of_each(spark: SparkSession, docs: DataFrame, named: DataFrame) -> DataFrame:
    """Of each component of ``named(doc_id, th, component_id)`` the document with the smallest doc_id, once."""
    named = named.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = named.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_th")).agg(F.count(F.lit(1)).alias("_n"))
    kept = Scratch(spark, "kept").stage(kept, "kept")
    again = not kept.where("_n > 1").isEmpty()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_th")), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if again else out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles have a similarity of 0.8 or more the first."""
    return first_of_each(spark, docs, near_duplicates(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them; n_chars follows the text."""
    return repetitions(mix(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of each row of the mix."""
    return encode(docs.select("doc_id", "text")).selectExpr("doc_id", "_n_tokens AS n_tokens", "_ids AS ids", "_round_trip AS round_trip")


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", unrepeated_lines),
    ("simhash", distinct_documents),
    ("mixing", mixed_sources),
    ("pieces", encoded),
]

#: SQL expresses neither the centroids nor the fingerprints nor the merges; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
