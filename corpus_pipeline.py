"""From raw documents to packed sequences: five stages over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from esquina.llm import lines, neardup, packing, quality, substrings
from esquina.llm.ship import ship
from esquina.operators.stage import shared_dir


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with ``n_chars`` that of the changed text."""
    kept = docs.select(*columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the newest policy rejects go."""
    ship(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go; every document stays, and copies as a whole are left to the next stage."""
    ship(spark)
    return sized(lines.remove_common_lines(docs, spare_copies=True), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the least id stays."""
    ship(spark)
    return neardup.keep_one(docs, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start anywhere else too go; every document stays."""
    ship(spark)
    return sized(substrings.remove_repeats(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' token pieces in sequences of 4096."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), spaced=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]
# Tokenization is not expressible in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
