"""Links between chunks and assets of a document: page-range join, token score, best links, rollup per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalode.operators.context import STOPWORDS

# fixed values: what a page image needs to be linked, and how links of one asset are cut
LEAST_SHARE, BASE, TOP = 0.16, 0.64, 0.95
LEAST_CONFIDENCE, NEAR_BEST, PER_ASSET = 0.68, 0.08, 2
TOKENS = 6


def link_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of four or more characters without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda x: (F.length(x) >= 4) & ~x.isin(*STOPWORDS)))


def on_pages(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks (group, chunk_id, page_start, page_end, text) with the assets (group, asset_id, page, label) on their pages.

    The range is unrolled to its pages, so the join stays an equi-join.
    """
    pages = chunks.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    return pages.join(assets, ["group", "page"])


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with shared, share and confidence (null where the tokens don't meet the least share)."""
    a, b = link_tokens(F.col("label")), link_tokens(F.col("text"))
    out = pairs.withColumns({"__a": a, "__b": b}).withColumn("shared", F.slice(F.array_sort(F.array_intersect("__a", "__b")), 1, 8))
    share = F.when(F.size("__a") == 0, 0.0).otherwise(F.size("shared") / F.least(F.size("__a"), F.lit(TOKENS)))
    out = out.withColumn("share", F.round(share, 4)).drop("__a", "__b")
    return out.withColumn("confidence", F.when(F.col("share") >= LEAST_SHARE, F.round(F.least(F.lit(TOP), F.lit(BASE) + F.col("share")), 4)))


def best(links: DataFrame) -> DataFrame:
    """Per asset the links of enough confidence that lie near its best one, the strongest first."""
    w = Window.partitionBy("group", "asset_id")
    near = links.where(F.col("confidence") >= LEAST_CONFIDENCE).withColumn("__best", F.max("confidence").over(w)).where(F.col("__best") - F.col("confidence") <= NEAR_BEST)
    rank = F.row_number().over(w.orderBy(F.desc("confidence"), F.desc("share"), "chunk_id"))
    return near.withColumn("place", rank).where(F.col("place") <= PER_ASSET).drop("__best")


def rollup(links: DataFrame) -> DataFrame:
    """Per chunk its linked assets and the highest confidence."""
    return links.groupBy("group", "chunk_id").agg(F.array_sort(F.collect_set("asset_id")).alias("assets"), F.count_distinct("asset_id").alias("n_assets"), F.max("confidence").alias("best"))


def boosted(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks (group, chunk_id, page_start, page_end, score): a score rises to 0.1 above the best asset_score on their pages."""
    best = on_pages(chunks, assets).groupBy("group", "chunk_id").agg((F.max("asset_score") + 0.1).alias("best"))
    return chunks.join(best, ["group", "chunk_id"], "left").withColumn("score", F.greatest("score", "best")).drop("best")
