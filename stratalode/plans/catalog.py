"""The list of registered queries: each has a name, a function of the tables and, where SQL can say it, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[["Tables"], DataFrame]
#: Tables of long texts.
TEXTS = ("documents", "pages")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        """The table; one of texts in fewer splits than there are cores is dealt out, as its rows are costly to work on."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in TEXTS and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        return df


class Chosen(Tables):
    """The tables with only those documents whose doc_id is among the rows (doc_id), which are dropped before they are worked on."""

    def __init__(self, t: Tables, rows: DataFrame):
        super().__init__(t.spark, t.dir)
        self.rows = rows

    def __call__(self, name: str) -> DataFrame:
        df = super().__call__(name)
        return df.join(self.rows, "doc_id", "left_semi") if name == "documents" else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
