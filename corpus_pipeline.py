"""The corpus pipeline: quality rules, near and substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All
but the last return the columns of documents: rejected documents are gone, cut texts are shorter, n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import decontamination, near_dedup, packing, quality_rules, substring_dedup
from stratalode.llm._support import free_name, materialise, recounted
from stratalode.session import share_code

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage whose workers find this library."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(share_code(spark), docs, sf_dir)

    return run


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's robust ellipsoid."""
    row = F.xxhash64("doc_id", "text", "lang", "source")  # rows that share a doc_id, or have none, are judged each
    key = free_name(docs, "row")
    kept = quality_rules.judge(docs.withColumn("doc_id", row)).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, row).join(kept, key, "left_semi").select(*docs.columns)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_one(docs)


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that an earlier document has."""
    return recounted(substring_dedup.remove(docs))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; mostly hit documents are gone."""
    return recounted(decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with the sources' proportions in every window."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the robust estimates, the signatures or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
