"""Structured Streaming twins of the sensor operators: watermarked rollups, idempotent ingestion, exact rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalode.functions import sensors as S


def read_events(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of new Parquet files, with the schema of an existing table."""
    return spark.readStream.schema(like.schema).parquet(path)


def rollup(stream: DataFrame, time: str = "observed_at", late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Count and mean by window and metric; readings later than the watermark are left out."""
    seen = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = seen.groupBy(F.window(time, size), "metric_name").agg(F.count("*").alias("n"), F.round(F.avg("numeric_value"), 4).alias("mean"))
    return g.select(F.col("window.start").alias("bucket"), "metric_name", "n", "mean")


def ingest(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings once each by (sensor, hash) within the watermark."""
    rows = S.normalise(stream).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return rows.withColumn("reading_hash", S.reading_hash()).withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["sensor_id", "reading_hash"])


def rate_limit(stream: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, allowed, refused of each batch: a hit passes if fewer than `limit` allowed ones lie within the seconds before."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = list(state.get[0]) if state.exists else []
        allowed = refused = 0
        for at in sorted(x for f in frames for x in f["at"].tolist()):
            passed = [x for x in passed if x > at - seconds]
            if len(passed) < limit:
                passed.append(at)
                allowed += 1
            else:
                refused += 1
        state.update((passed,))
        yield pd.DataFrame({"key": [key[0]], "allowed": [allowed], "refused": [refused]})

    slim = stream.select("key", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return slim.groupBy("key").applyInPandasWithState(run, "key long, allowed long, refused long", "passed array<double>", "update", GroupStateTimeout.NoTimeout)
