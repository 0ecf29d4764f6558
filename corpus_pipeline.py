"""A training-data pipeline of five of the operators: each stage takes what the one before kept.

``run`` applies the stages to ``documents``.  The first four return the columns of
``documents``; the last returns the mix, a row per document that it takes.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables
and extra columns of any name, which it hands on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontamination import decontaminate
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.near_copies import drop_near_copies
from corpusloom.llm.pii import sanitise
from corpusloom.llm.quality_rules import score_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, the likelihood ratio or a toxic word reject go; so a null text, which has no words, goes."""
    judged = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True, reject_toxic=True)
    return judged.filter("kept").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity 0.8 or more) one document stays.

    Candidates share Golay codewords in segments of their SimHash fingerprints; whole shingle sets decide.
    It is the one with the smallest id, a null id after all others; null, empty and blank texts
    are one group.  Rows are judged by their own texts, not by their ids.
    """
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands within its error budget go; a null text stays."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its text is the sanitised one, a null one stays null."""
    clean = sanitise(docs, carry=True)
    changed = {"text": F.col("sanitised"), "n_chars": F.length("sanitised").cast("long")}
    return clean.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often."""
    return mix_sources(docs).filter("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_sanitisation", pii_sanitisation),
    ("source_mixing", source_mixing),
]

#: SQL can't express the likelihood ratio, the near copies or the knapsack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
