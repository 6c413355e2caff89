"""Snapshots of a table by unit (a document): rows are staged, checked as they were written, and a pointer row makes them visible.

Folder: data/snapshot_id=.../ holds staged rows, pointers/ rows (unit, snapshot_id, seq). Readers take each unit's rows of the
snapshot that its latest pointer names, so they see all old or all new rows of a unit. Pointers of one commit are one file,
which appears as a whole. What was staged and never pointed to is pending and invisible; staging it again replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def stage(rows: DataFrame, path: str, snapshot_id: str) -> DataFrame:
    """Write the rows of a snapshot, in place of an earlier attempt's; returns them as they were written."""
    at = f"{path}/data/snapshot_id={snapshot_id}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """(unit, snapshot_id, seq): the latest pointer of each unit."""
    schema = "unit string, snapshot_id string, seq long"
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/pointers")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    latest = Window.partitionBy("unit").orderBy(F.desc("seq"), F.desc("snapshot_id"))
    return rows.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")


def commit(units: DataFrame, path: str, snapshot_id: str) -> None:
    """Point the units (unit) to a staged snapshot."""
    spark = units.sparkSession
    seq = (pointers(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
    units.select(F.col("unit").cast("string").alias("unit"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(seq).cast("long").alias("seq")).coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def publish(rows: DataFrame, path: str, snapshot_id: str, unit: str, checks: dict[str, Column]) -> DataFrame:
    """(unit, rows, failed, state): stage rows, check every row, and make those units visible all of whose rows are sound.

    checks: what must hold of a row, by name; one that can't be told does not hold. A unit that fails stays as it was, in review.
    """
    staged = stage(rows, path, snapshot_id)
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))).cast("array<string>")
    judged = staged.select(F.col(unit).cast("string").alias("unit"), broken.alias("broken"))
    names = judged.select("unit", F.explode_outer("broken").alias("name")).groupBy("unit").agg(F.array_sort(F.collect_set("name")).alias("failed"))  # as many as checks
    report = judged.groupBy("unit").agg(F.count("*").alias("rows")).join(names, "unit").withColumn("state", F.when(F.size("failed") == 0, "active").otherwise("review"))
    commit(report.where("state = 'active'").select("unit"), path, snapshot_id)
    return report


def active(spark: SparkSession, path: str, unit: str, schema: str) -> DataFrame:
    """The visible rows with their snapshot_id; schema is the rows' own."""
    data = spark.read.schema(f"{schema}, snapshot_id string").parquet(f"{path}/data")
    now = pointers(spark, path).select(F.col("unit").alias("__unit"), F.col("snapshot_id").alias("__id"))
    return data.join(now, (F.col(unit).cast("string") == F.col("__unit")) & (F.col("snapshot_id") == F.col("__id"))).drop("__unit", "__id")


def pending(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id): staged snapshots that no unit points to."""
    staged = spark.read.parquet(f"{path}/data").select("snapshot_id").distinct()
    return staged.join(pointers(spark, path).select("snapshot_id").distinct(), "snapshot_id", "left_anti")
