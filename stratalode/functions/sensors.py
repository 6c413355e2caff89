"""Sensor readings: normalisation, identity, idempotent merge, recent context and rate limits."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise(df: DataFrame) -> DataFrame:
    """Readings with a metric name of at most 80 lower-case characters and a value; others are left out."""
    clean = df.withColumn("metric_name", F.substring(F.lower(F.btrim("metric_name")), 1, 80))
    return clean.where("metric_name <> '' AND numeric_value IS NOT NULL")


def reading_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"), "metric_name", F.format_string("%.8f", "numeric_value")), 256)


def upsert(df: DataFrame) -> DataFrame:
    """One row a (sensor, hash): the first id, the value, and the latest metadata that isn't empty."""
    given = F.when(F.col("metadata_json").isNotNull() & (F.col("metadata_json") != "{}"), F.col("reading_id"))
    rows = df.withColumns({"reading_hash": reading_hash(), "__given": given})
    return rows.groupBy("sensor_id", "reading_hash").agg(F.min("reading_id").alias("reading_id"), F.max("numeric_value").alias("numeric_value"), F.max_by("metadata_json", "__given").alias("metadata_json"))


def context(df: DataFrame, now: str, hours: int = 24, last: int = 12) -> DataFrame:
    """Statistics and points of the last readings of each (sensor, metric) in the window before now."""
    recent = df.where(F.expr(f"observed_at > TIMESTAMP '{now}' - INTERVAL {hours} HOURS AND observed_at <= TIMESTAMP '{now}'"))
    w = Window.partitionBy("sensor_id", "metric_name").orderBy(F.desc("observed_at"), F.desc("reading_id"))
    top = recent.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    v = F.col("numeric_value")
    points = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.round(v, 4).alias("v")))), lambda x: x["v"])  # at most `last`
    g = top.groupBy("sensor_id", "metric_name").agg(
        F.count("*").alias("n"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v), 4).alias("mean"),
        F.min_by("numeric_value", "rn").alias("latest_value"), F.max("observed_at").alias("latest_at"), points.alias("points"),
    )
    return g.withColumn("summary", F.concat(F.col("metric_name"), F.lit(": n="), F.col("n").cast("string"), F.lit(", latest="), F.format_string("%.2f", "latest_value")))


def rate_limit(df: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, key, allowed: a hit passes if fewer than `limit` allowed hits lie in the seconds before it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        passed: deque = deque()
        out, span = [], pd.Timedelta(seconds=seconds)
        for r in rows.sort_values(["ts", "event_id"]).itertuples(index=False):
            while passed and passed[0] <= r.ts - span:
                passed.popleft()
            ok = len(passed) < limit
            if ok:
                passed.append(r.ts)
            out.append((r.event_id, r.key, ok))
        return pd.DataFrame(out, columns=["event_id", "key", "allowed"])

    return df.groupBy("key").applyInPandas(run, "event_id long, key long, allowed boolean")


def enforce_places(sensors: DataFrame, hives: DataFrame) -> DataFrame:
    """sensors (hive, place, ...) with a verdict; a sensor of a hive takes that hive's place where it has none of its own.

    hives: (hive, hive_place) of the same owner.
    """
    h = sensors.join(hives.withColumn("__known", F.lit(True)), "hive", "left")
    own, place = F.col("place"), F.col("hive_place")
    verdict = (
        F.when(F.col("hive").isNull(), "ok").when(F.col("__known").isNull(), "hive_of_another_owner").when(place.isNull() & own.isNotNull(), "hive_without_place")
        .when(own != place, "place_mismatch").otherwise("ok")
    )
    return h.withColumn("verdict", verdict).withColumn("place", F.coalesce(own, place)).drop("__known", "hive_place")
