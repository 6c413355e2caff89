"""A published vector index, partitioned by state and tenant, and exact search in what a query may see."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READY = "ready"
#: Queries that one pass over the index answers; rows whose distances are held at once.
QUERY_BLOCK, ROWS = 2048, 2048


def write_index(vectors: DataFrame, path: str) -> DataFrame:
    """vectors (vec_id, vec, document_id, tenant_id, publish_state, ...) as a table whose state and tenant are folders."""
    vectors.repartition("publish_state", "tenant_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.partitionBy("publish_state", "tenant_id").parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)


def visible(index: DataFrame, queries: DataFrame, state: str = READY) -> DataFrame:
    """Rows of the index that any of the queries may see: of the state, of a query's tenant, of its documents where it names some.

    State and tenant prune folders, the tenant at run time; documents are a join before any distance is taken.
    """
    opens = queries.groupBy("tenant_id").agg(F.bool_or(F.col("document_ids").isNull()).alias("open"))
    named = queries.select("tenant_id", F.explode("document_ids").alias("document_id")).distinct().withColumn("named", F.lit(True))
    rows = index.where(F.col("publish_state") == state).join(F.broadcast(opens), "tenant_id")  # one row a tenant of a block of queries
    return rows.join(named, ["tenant_id", "document_id"], "left").where(F.col("open") | F.col("named")).drop("open", "named")


def search(index: DataFrame, queries: DataFrame, k: int, state: str = READY, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by squared distance among what each query may see.

    queries: (query_id, vec, tenant_id, document_ids array or null). They go to the tasks in blocks of bounded size; a task keeps
    its k best of each query.
    """
    spark, out = index.sparkSession, None
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    for b in range(blocks):
        mine = dealt.where(F.col("__block") == b).drop("__block")
        part = mine.select("query_id", "vec", "tenant_id", F.transform("document_ids", lambda d: d.cast("string")).alias("document_ids")).toArrow().to_pylist()
        known = spark.sparkContext.broadcast(([r["query_id"] for r in part], np.array([r["vec"] for r in part], float).reshape(len(part), -1 if part else 0), [r["tenant_id"] for r in part], [None if r["document_ids"] is None else set(r["document_ids"]) for r in part]))
        rows = visible(index, mine, state).select(F.col("vec_id").cast("long").alias("vec_id"), "vec", "tenant_id", F.col("document_id").cast("string").alias("document_id"))
        one = rows.mapInArrow(_searcher(known, k), "query_id long, vec_id long, distance double")
        out = one if out is None else out.union(one)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searcher(known, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, tenants, documents = known.value
        ids = np.array(ids, np.int64)
        by_tenant = {t: np.array([i for i, x in enumerate(tenants) if x == t]) for t in dict.fromkeys(tenants)}
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {t: (np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)) for t, q in by_tenant.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                of = np.array(piece["tenant_id"].to_pylist(), object)
                y_all = np.array(piece["vec"].to_pylist(), float).reshape(piece.num_rows, -1)
                names, keys = piece["document_id"].to_pylist(), piece["vec_id"].to_numpy()
                for t in dict.fromkeys(of):
                    asked, rows = by_tenant[t], np.flatnonzero(of == t)
                    x, y = vectors[asked], y_all[rows]
                    d = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)
                    for j, q in enumerate(asked):
                        if documents[q] is not None:
                            d[j, [names[r] not in documents[q] for r in rows]] = np.inf
                    d0, i0 = best[t]
                    d, i = np.concatenate([d0, d], axis=1), np.concatenate([i0, np.broadcast_to(keys[rows], d.shape)], axis=1)
                    order = np.lexsort((i, np.round(d, 9)), axis=1)[:, :k]
                    best[t] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        for t, (d, i) in best.items():
            q, place = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(ids[by_tenant[t][q]]), pa.array(i[q, place]), pa.array(d[q, place])], ["query_id", "vec_id", "distance"])

    return run
