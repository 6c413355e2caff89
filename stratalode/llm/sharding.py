"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows of P input partitions go to S shards of exact sizes. How many rows partition p sends to shard s is drawn from the
multivariate hypergeometric law (what a uniform permutation would send), so every partition can permute and deal its own
rows alone; after the exchange each shard is permuted again: every row carries a random order, a shard's orders are cut
into blocks of about `block_rows` rows, and blocks are ranked alone. A block's first slot comes from the blocks' counts;
as labels and orders depend on the seed and a partition's number of rows only, these are counted without reading the rows.
So no task holds a shard, slots are gapless, and the driver holds one number a partition and shard.

Law: `rows`; shard sizes differ by one at most. Defined cases: null text counts as empty (size 1, text_crc32 0);
equal rows are rows of their own; fewer rows than shards leave the last shards empty; an empty table gives no rows; all
other columns pass through, but for ones named shard or slot, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalode.llm._support import free_name


_NUMPY_LIMIT = 10**9 - 1


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw; numpy's own below its limit, else by inversion outward from the mode."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    lo, hi, total = max(0, draws - bad), min(good, draws), good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    logc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p0 = math.exp(logc(good, mode) + logc(bad, draws - mode) - logc(total, draws))
    u, left, right, pl, pr = rng.random() - p0, mode, mode, p0, p0
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """counts[p, s] with row sums `rows` and column sums `sizes`, as a uniform permutation would give."""
    if sum(rows) != sum(sizes):
        raise ValueError("rows and sizes differ in their sums")
    rng, rest, out = np.random.default_rng(seed), np.array(sizes, np.int64), np.zeros((len(rows), len(sizes)), np.int64)
    for p, n in enumerate(rows):
        if rest.sum() < _NUMPY_LIMIT:
            out[p] = rng.multivariate_hypergeometric(rest, n, method="marginals") if len(rest) and n else 0
        else:
            left, behind = n, int(rest.sum())
            for s in range(len(sizes)):
                behind -= int(rest[s])
                out[p, s] = _hypergeometric(rng, int(rest[s]), behind, left)
                left -= int(out[p, s])
        rest -= out[p]
    return out


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


_ORDER_BITS = 62


class _Deal:
    """What partition p does with its rows, in turn: the shard and random order of each."""

    def __init__(self, p: int, counts: np.ndarray, seed: int):
        self.rng = np.random.default_rng([seed, p])
        self.shards = self.rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
        self.done = 0

    def next(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        shards, self.done = self.shards[self.done : self.done + n], self.done + n
        return shards, self.rng.integers(0, 1 << _ORDER_BITS, len(shards), dtype=np.int64)


def _block(shards: np.ndarray, order: np.ndarray, bits: int) -> np.ndarray:
    """Blocks of a shard follow each other; a block takes the orders with the same leading bits."""
    return (shards.astype(np.int64) << bits) | (order >> (_ORDER_BITS - bits))


def _dealer(matrix, seed: int, bits: int, added: list[str]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        mine = _Deal(p, matrix.value.get(p, np.zeros(0, np.int64)), seed)
        at = p << 40
        for batch in batches:
            n = batch.num_rows
            shards, order = mine.next(n)
            if len(shards) < n:
                raise RuntimeError(f"partition {p} has more rows than were counted")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_block(shards, order, bits)), pa.array(order), pa.array(np.arange(at, at + n))], [*batch.schema.names, *added])
            at += n
        if mine.done < len(mine.shards):
            raise RuntimeError(f"partition {p} has fewer rows than were counted")

    return deal


def _counter(matrix, seed: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                mine = _Deal(p, matrix.value[p], seed)
                blocks, n = np.unique(_block(*mine.next(len(mine.shards)), bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(n)], ["block", "n"])

    return count


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 20240229, block_rows: int = 2048) -> DataFrame:
    """df with `shard` and `slot`: a uniform random permutation cut into shards whose sizes differ by one at most.

    The input's partitions must come out alike when read again (a Parquet scan does); a difference raises an error.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    counted = dict((r[0], r[1]) for r in df.groupBy(F.spark_partition_id().alias("pid")).count().collect())
    pids = sorted(counted)
    sizes = _even(sum(counted.values()), shards)
    bits = max(0, -(-max(sizes) // block_rows) - 1).bit_length()
    matrix = communication_matrix([counted[p] for p in pids], sizes, seed)
    dealt_by = spark.sparkContext.broadcast(dict(zip(pids, matrix, strict=True)))  # a number a partition and shard
    partitions = spark.createDataFrame(pa.table({"pid": pa.array(pids, pa.int64())}))
    counts = partitions.repartition(max(1, min(len(pids), 4096))).mapInArrow(_counter(dealt_by, seed, bits), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    block, order, at, base, rank = (free_name(df, name) for name in ("block", "order", "at", "base", "rank"))
    ahead = Window.partitionBy(F.shiftright("block", bits)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # rows are blocks
    starts = counts.select(F.col("block").alias(block), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(base))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` long" for c in (block, order, at))])
    dealt = df.mapInArrow(_dealer(dealt_by, seed, bits, [block, order, at]), schema)
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(block).orderBy(order, at)).cast("long") - 1)
    return ranked.join(starts, block).select(*df.columns, F.shiftright(block, bits).cast("int").alias("shard"), (F.col(base) + F.col(rank)).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
