"""Ad-hoc SQL over registered tables: one SELECT statement, a bounded page of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Tables that statements may read.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_sql(tables, statement: str, row_limit: int = 250) -> DataFrame:
    """Rows of one SELECT over the tables of a folder; other statements and several statements are refused.

    The tables that the statement names are views of a session of its own, so Spark's parser resolves all names.
    """
    text = statement.strip().rstrip(";")
    if ";" in text or not re.match(r"(?is)(select|with)\b", text):
        raise ValueError("one SELECT statement is allowed")
    session = tables.spark.newSession()
    words = {w.lower() for w in re.findall(r"\w+", text)}
    for name in words.intersection(TABLES):
        session.read.parquet(f"{tables.dir}/{name}.parquet").createOrReplaceTempView(name)
    return session.sql(text).limit(row_limit)
