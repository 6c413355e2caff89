"""Sources and sinks: text and JSON readers, keyed merges, partitioned replacement, staged publication."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file as one document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], first: int | None = None, last: int | None = None) -> DataFrame:
    """path, text of binary documents by an extractor of page texts: pages marked `[[Page n]]`, joined by form feeds."""
    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            pages = extract(raw)
            lo, hi = max(1, first or 1), min(len(pages), last or len(pages))
            return "\f".join(f"[[Page {k}]]\n\n{pages[k - 1]}" for k in range(lo, hi + 1))

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of evaluation queries."""
    return spark.read.json(path, multiLine=True)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merge(old: DataFrame, new: DataFrame, keys: list[str], newer: str) -> DataFrame:
    """Old and new rows, one a key: the one with the greatest `newer`; of a tie the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(newer, "__new"))
    return both.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*").select(*old.columns)


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of all groups that new doesn't hold, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def delete_where(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(key).distinct(), key, "left_anti").select(*child.columns)


def publish(df: DataFrame, path: str, valid: Column) -> DataFrame:
    """Write df as staged, check it, and write it as ready; a row that isn't valid stops the publication."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged")
    if staged.where(~valid).limit(1).count():
        raise ValueError("staged rows fail the check")
    staged.write.mode("overwrite").parquet(f"{path}/ready")
    return spark.read.parquet(f"{path}/ready")


def upsert_vectors(index: DataFrame, batch: DataFrame, key: str, state: str, path: str) -> DataFrame:
    """index with the rows of batch (its columns, but for publish_state) in place of those of equal keys, in this state.

    The result is written by publish_state, so that searches of ready vectors read these only.
    """
    if state not in ("staged", "ready"):
        raise ValueError("the state is staged or ready")
    new = batch.withColumn("publish_state", F.lit(state)).select(*index.columns)
    index.join(new.select(key).distinct(), key, "left_anti").select(*index.columns).unionByName(new).write.partitionBy("publish_state").parquet(path)
    return index.sparkSession.read.parquet(path).select(*index.columns)


def publish_flip(staged: DataFrame, unit: str, sound: Column, path: str) -> DataFrame:
    """Staged rows as a ready snapshot, one unit (a document) at a time: of a unit with a row that isn't sound, all rows go.

    Rows are written as staged and checked as they were written; readers of ready rows never see a part of a unit.
    """
    spark = staged.sparkSession
    staged.write.parquet(f"{path}/staged")
    written = spark.read.parquet(f"{path}/staged")
    failed = written.where(~F.coalesce(sound, F.lit(False))).select(unit).distinct()
    written.join(failed, unit, "left_anti").select(*staged.columns).withColumn("publish_state", F.lit("ready")).write.parquet(f"{path}/ready")
    return spark.read.parquet(f"{path}/ready")


def append_trace(path: str, messages: DataFrame, runs: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Append a turn's messages, runs and sources to their tables, with scores to six places; returns the tables.

    Runs are written last: readers take the runs as the list of what is complete.
    """
    spark = runs.sparkSession
    rounded = sources.withColumn("score", F.round("score", 6))
    for name, df in (("messages", messages), ("sources", rounded), ("runs", runs)):
        df.write.mode("append").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("messages", "runs", "sources")}


def save_routes(routes: DataFrame, saves: DataFrame, touches: DataFrame) -> DataFrame:
    """routes (pattern, example, route, hits) after saves (pattern, example, route, at) and touches (pattern).

    A save replaces the route and keeps an example that is there; new patterns start at no hits; a touch of a known pattern
    adds one.
    """
    new = saves.groupBy("pattern").agg(F.min_by("example", "at").alias("first"), F.max_by("route", "at").alias("last"))
    both = routes.join(new, "pattern", "full").select("pattern", F.coalesce("example", "first").alias("example"), F.coalesce("last", "route").alias("route"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    more = touches.groupBy("pattern").agg(F.count("*").alias("more"))
    return both.join(more, "pattern", "left").select("pattern", "example", "route", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"))


def clean_json(value):
    """JSON values without NUL characters."""
    if isinstance(value, str):
        return value.replace("\x00", "")
    if isinstance(value, list):
        return [clean_json(v) for v in value]
    if isinstance(value, dict):
        return {clean_json(k): clean_json(v) for k, v in value.items()}
    return value


def sanitize_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else json.dumps(clean_json(json.loads(v)), sort_keys=True))

    return run(c)
