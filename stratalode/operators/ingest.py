"""Resuming interrupted ingestion, and keeping an index in step with what is accepted: both do only what isn't done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Job states that can be resumed, in order, and those in which nothing is left to do.
RESUMABLE, DONE = ("chunks_validated", "kg_validated", "indexed"), ("completed", "review")
#: States of an extraction that keep its document from being published.
FAILED = ("review", "quarantined")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def todo(jobs: DataFrame, accepted: DataFrame, done: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Accepted chunks (document_id, chunk_id, ...) of jobs (document_id, status) in these states that done (chunk_id) lacks."""
    open_ = jobs.where(F.col("status").isin(*states)).select("document_id")
    return accepted.join(open_, "document_id", "left_semi").join(done.select("chunk_id"), "chunk_id", "left_anti")


def resume(jobs: DataFrame, accepted: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(document_id, was, status, extracted, indexed): every resumable job taken up where it stopped.

    Tables under path hold what is done: extractions (chunk_id, status) and vectors (chunk_id, vec). A job after validated
    chunks has its missing extractions made; one without failed extractions has its missing vectors made; then it is
    completed, else in review. Work is found by anti-joins with what was written, so a run that breaks off is continued and
    a further run does nothing. extracted and indexed tell what this run did.
    """
    spark = jobs.sparkSession
    kinds = "chunk_id long, document_id string, status string", "chunk_id long, document_id string, vec array<double>"
    stored = lambda k: _stored(spark, f"{path}/{('extractions', 'vectors')[k]}", kinds[k])

    add = lambda k, rows: rows.write.mode("append").parquet(f"{path}/{('extractions', 'vectors')[k]}")
    counted = [stored(k).groupBy("document_id").agg(F.count("*").alias("n")) for k in (0, 1)]
    for k, df in enumerate(counted):  # what was there before this run adds to it
        df.write.mode("overwrite").parquet(f"{path}/before-{k}")
    known = [spark.read.parquet(f"{path}/before-{k}") for k in (0, 1)]
    add(0, extract(todo(jobs, accepted, stored(0), RESUMABLE[:1])).select("chunk_id", "document_id", "status"))
    failed = stored(0).where(F.col("status").isin(*FAILED)).select("document_id").distinct()
    sound = jobs.join(failed, "document_id", "left_anti")
    add(1, embed(todo(sound, accepted, stored(1), RESUMABLE[:2])).select("chunk_id", "document_id", "vec"))
    now = [stored(k).groupBy("document_id").agg(F.count("*").alias("all")).join(known[k], "document_id", "left").select("document_id", (F.col("all") - F.coalesce("n", F.lit(0))).alias(("extracted", "indexed")[k])) for k in (0, 1)]
    status = F.when(~F.col("status").isin(*RESUMABLE), F.col("status")).when(F.col("failed"), "review").otherwise("completed")
    out = jobs.join(failed.withColumn("failed", F.lit(True)), "document_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    out = out.select("document_id", F.col("status").alias("was"), status.alias("status"))
    for df in now:
        out = out.join(df, "document_id", "left")
    return out.fillna(0, ["extracted", "indexed"])


def changes(current: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """(key, action): what brings an index in step: insert, update or delete.

    current: (key, visible, content, version), index: (key, content, version). Visible rows that the index lacks, or has with
    other content or of another model's version, are put; rows that aren't visible any more, or are gone, are deleted.
    """
    have = index.select(key, F.lit(True).alias("held"), F.col("content").alias("c"), F.col("version").alias("v"))
    both = current.join(have, key, "full_outer")
    visible, held = F.coalesce("visible", F.lit(False)), F.coalesce("held", F.lit(False))
    same = F.col("content").eqNullSafe(F.col("c")) & F.col("version").eqNullSafe(F.col("v"))
    action = F.when(visible & ~held, "insert").when(visible & ~same, "update").when(~visible & held, "delete")
    return both.select(key, action.alias("action")).where("action IS NOT NULL")


def applied(current: DataFrame, index: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """The index (key, content, version) after the changes found."""
    kept = index.select(key, "content", "version").join(found, key, "left_anti")
    put = current.select(key, "content", "version").join(found.where("action <> 'delete'"), key, "left_semi")
    return kept.unionByName(put)
