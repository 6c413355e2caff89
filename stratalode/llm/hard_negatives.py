"""Hard-negative mining by slots of scores.

An anchor's positives are its best rows of the same label; each allows negatives whose score lies in a window of percents of its
own. The windows of an anchor overlap. Their upper limits, in descending order, cut the scores into disjoint slots: slot j lies
above the limit of slot j + 1. Each task keeps the k best rows of other labels per anchor and slot, Spark combines the tasks'
rows, and as slots descend, the k best of slots j, j + 1, ... in that order are the k best below limit j: this suffix answers
every window with that limit, after those under its lower limit are left out.

Anchors are asked in chunks of bounded bytes, each against all rows in two passes (positives, then negatives); a chunk goes to
the tasks as one matrix and a task scores blocks of rows by one product each. What a task holds is bounded by the chunk.

Components become floor(scale * x) and scores are exact integers, whatever their size; beyond LIMIT they count as LIMIT. Rows
with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths meet in
their common components. Equal scores go by the smaller id; rows with the same id and score count once, and a row is no
positive or negative of an anchor with its own id. Anchors that repeat with other vectors are asked each. Other columns are
left out. A negative positive score has no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalode.llm._support import materialise

#: Bytes of the matrix of anchors that are asked at once.
CHUNK_BYTES = 32 << 20
#: Rows and anchors whose scores are held at once.
ROWS, ANCHORS = 2048, 1024
#: Scores count up to here, so that their percents fit 64 bits.
LIMIT = (1 << 63) // 128
_LOWEST = -LIMIT - 1


def vectors_of(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix of floor(scale * x)) of the rows of (id, label, vector) that take part."""
    ids, labels, vectors = (batch[c] for c in ("id", "label", "vector"))
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls become nan
    end = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = (bad[end] == bad[end - size]) & ~np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in (ids, labels, vectors)])
    width = int(size.max(initial=0))
    matrix = np.zeros((len(size), width))
    if width:
        row = np.repeat(np.arange(len(size)), size)
        matrix[row, np.arange(len(flat)) - np.repeat(end - size, size)] = np.where(np.isfinite(flat), np.floor(scale * flat), 0)
    numbers = [pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64)[kept] for c in (ids, labels)]
    return *numbers, matrix[kept]


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole numbers, within LIMIT."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)))
    if np.abs(left).max() * np.abs(right).max() * width < 1 << 53:
        return left @ right.T  # every sum on the way is exact
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(left) @ whole(right).T, -LIMIT, LIMIT).astype(np.int64)


class Best:
    """The k best (score, id) of each key: higher scores first, then smaller ids; equal pairs count once."""

    def __init__(self, keys: int, k: int):
        self.score, self.id = np.full((keys, k), _LOWEST), np.zeros((keys, k), np.int64)

    def offer(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        old = np.unique(key)
        k = self.score.shape[1]
        key = np.concatenate([np.repeat(old, k), key])
        score = np.concatenate([self.score[old].ravel(), score.astype(np.int64)])
        ids = np.concatenate([self.id[old].ravel(), ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]) | (score == _LOWEST)
        key, score, ids = key[new], score[new], ids[new]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        top = place < k
        self.score[key[top], place[top]], self.id[key[top], place[top]] = score[top], ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.nonzero(self.score != _LOWEST)
        return key, self.score[key, place], self.id[key, place]


def slots(anchor: np.ndarray, score: np.ndarray, anchors: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower): limits of each anchor's slots, descending and disjoint; a row a anchor, empty slots have lower > upper."""
    up, down = high * score // 100, -(-low * score // 100)
    open_ = up >= down
    anchor, up, down = anchor[open_], up[open_], down[open_]
    order = np.lexsort((down, -up, anchor))
    anchor, up, down = anchor[order], up[order], down[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (up[1:] != up[:-1])]) if len(anchor) else np.zeros(0, bool)
    anchor, up, down = anchor[new], up[new], down[new]
    place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    upper = np.full((anchors, int(place.max(initial=0)) + 1), _LOWEST)
    lower = np.full(upper.shape, LIMIT)
    upper[anchor, place] = up
    lower[anchor, place] = down
    lower[:, :-1] = np.where(upper[:, :-1] > _LOWEST, np.maximum(lower[:, :-1], upper[:, 1:] + 1), lower[:, :-1])
    return upper, lower


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield vectors_of(batch.slice(at, ROWS), scale)


def _batch(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score)], ["anchor", "slot", "id", "score"])


def _positives(asked: Broadcast, scale: int, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_label, matrix = asked.value
        by_label = np.argsort(own_label, kind="stable")
        sorted_label = own_label[by_label]
        best = Best(len(own), k)
        for ids, labels, block in _blocks(batches, scale):
            for label in np.intersect1d(labels, sorted_label):
                rows = np.flatnonzero(labels == label)
                a, b = np.searchsorted(sorted_label, label), np.searchsorted(sorted_label, label, "right")
                for at in range(a, b, ANCHORS):
                    these = by_label[at : min(at + ANCHORS, b)]
                    s = scores(block[rows], matrix[these])
                    r, c = np.nonzero((s >= best.score[these, -1]) & (ids[rows][:, None] != own[these]))
                    if len(r):
                        best.offer(these[c], s[r, c], ids[rows[r]])
        anchor, score, ids = best.rows()
        yield _batch(anchor, score, ids, np.zeros(len(anchor)))

    return find


def _negatives(asked: Broadcast, limits: Broadcast, scale: int, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_label, matrix = asked.value
        upper, lower = limits.value
        n = upper.shape[1]
        best = Best(upper.size, k)
        used = np.flatnonzero((upper >= lower).any(1))
        for ids, labels, block in _blocks(batches, scale):
            for at in range(0, len(used), ANCHORS):
                these = used[at : at + ANCHORS]
                s = scores(block, matrix[these])
                least = np.maximum(lower[these], best.score.reshape(upper.shape + (k,))[these, :, -1])
                r, c = np.nonzero((s <= upper[these, 0]) & (s >= least.min(1)))
                s, a = s[r, c].astype(np.int64), these[c]
                slot = (upper[a] >= s[:, None]).sum(1) - 1
                on = (s >= least[c, slot]) & (labels[r] != own_label[a]) & (ids[r] != own[a])
                if on.any():
                    best.offer(a[on] * n + slot[on], s[on], ids[r[on]])
        key, score, ids = best.rows()
        yield _batch(key // n, score, ids, key % n)

    return find


def _combined(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot among the tasks' best."""
    place = F.dense_rank().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).distinct()


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """The first `negatives` rows of other labels in the window of each of the first `positives` rows of an anchor's label.

    vectors: (id, label, vector). anchor: which rows ask. A window of a positive score p are scores from low to high percent of p.
    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    asking = materialise(rows.where(anchor).distinct(), "anchors")
    count, width = asking.agg(F.count("*"), F.max(F.size("vector"))).first()
    chunks = max(1, -(-count * max(1, width or 0) * 8 // CHUNK_BYTES))
    dealt = asking.withColumn("chunk", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(chunks)))
    out = None
    for chunk in range(chunks):
        part = _asked(spark, rows, dealt.where(F.col("chunk") == chunk).drop("chunk"), positives, negatives, low, high, scale)
        part = part if chunks == 1 else materialise(part, "hard-negatives")
        out = part if out is None else out.unionByName(part)
    return out


def _asked(spark: SparkSession, rows: DataFrame, chunk: DataFrame, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """mine() for a chunk of anchors, whose size is bounded."""
    table = chunk.toArrow().combine_chunks()
    batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
    own, labels, matrix = vectors_of(batch, scale)
    asked, kinds = spark.sparkContext.broadcast((own, labels, matrix)), "anchor int, slot int, id long, score long"
    first = _combined(rows.mapInArrow(_positives(asked, scale, positives), kinds), positives)
    first = materialise(first.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives", files=max(1, len(own) * positives >> 18))
    best = first.select("anchor", "positive_score").toArrow()
    upper, lower = slots(best["anchor"].to_numpy().astype(np.int64), best["positive_score"].to_numpy(), len(own), low, high)
    limits = spark.sparkContext.broadcast((upper, lower))
    found = _combined(rows.mapInArrow(_negatives(asked, limits, scale, negatives), kinds), negatives)
    found = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("found"))  # k a slot
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(own)), pa.int32()), "anchor_id": own}))
    open_ = first.where("positive_score >= 0").withColumn("limit", F.expr(f"positive_score * {high} div 100")).where(f"limit >= (positive_score * {low} + 99) div 100")
    windows = open_.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("limit"))) - 1)
    suffix = F.slice(F.filter("found", lambda f: f["slot"] >= F.col("slot")), 1, negatives)
    inside = F.filter(suffix, lambda f: f["score"] * 100 >= F.col("positive_score") * low)
    picked = windows.join(found, "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("at", "f"))
    return picked.join(names, "anchor").select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives of each of the five positives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
