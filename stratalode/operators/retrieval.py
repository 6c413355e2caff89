"""Search over texts and vectors: scored substring search, exact nearest neighbours, hybrid merge, rerank, diversity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of the rerank score and of diversity
DISTANCE, LEXICAL, SECTION, TITLE, PHRASE, ONTOLOGY = 1.0, 0.25, 0.10, 0.14, 0.22, 0.14
PAGE_IMAGE, PAGE_NUMBER = 0.08, 0.03
VISUAL_QUERY = ("image", "visual", "diagram", "figure", "illustration", "scanned", "scan", "photo")
VISUAL_TEXT = ("scanned", "scan", "title page", "illustration", "diagram", "figure", "seal image", "engraving")
VISUAL_TEXT_BONUS, VISUAL_LENGTH, VISUAL_LENGTH_BONUS = 0.12, 120, 0.04
#: Documents that context may come from, by how widely it is to be spread.
SPREAD = {"single": 1, "few": 3, "broad": 4}
LEAST_DOCUMENT_SCORE = 0.05
# fixed values: by how much the first document leads where it stands alone, for pictures and for look-ups; the most chunks of a context
VISUAL_LEAD, LOOKUP_LEAD, MOST_CONTEXT = 1.25, 1.2, 10
DIVERSITY = 0.22
LIMIT = 24
QUERY_BLOCK = 2048
# fixed values: chunks chosen, base chunks whose neighbours come along; question types that synopses widen, and by how much
SELECTED, NEIGHBOURED = 8, 3
EXPANDED = ("explanation", "procedure", "comparison")
SECTIONS, SECTION_CHUNKS, DOCUMENTS, DOCUMENT_CHUNKS = 4, 3, 3, 2
TERM_BLOCK = 256


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) >= 3)


def dummy_vector(c: Column, dimensions: int = 16) -> Column:
    """A deterministic vector from the bytes of the text's SHA-256."""
    h = F.sha2(c, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0) * 2 - 1)


def lexical(docs: DataFrame, queries: DataFrame, fields: dict[str, tuple[str, float]], limit: int = LIMIT, block: int = TERM_BLOCK) -> DataFrame:
    """(query_id, doc_id, lexical_score, lexical_rank): each of a query's first 8 terms adds its field's weight where found.
    doc_id is a key of docs.

    fields: column -> (contains | prefix, weight). The stated queries go to the tasks in blocks of bounded size; one
    automaton of a block's distinct terms reads each text once, and only each task's own best rows leave it.
    """
    spark, out = docs.sparkSession, None
    blocks = max(1, -(-queries.count() // block))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.slice(terms(F.col("q")), 1, 8).alias("terms")).collect()
        known = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in part])
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in fields))
        one = source.mapInArrow(_lexical_scanner(known, list(fields.values()), limit), "query_id long, doc_id long, lexical_score double")
        out = one if out is None else out.union(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "doc_id")
    return out.withColumn("lexical_rank", F.row_number().over(w)).where(F.col("lexical_rank") <= limit)


def _lexical_scanner(known, fields: list[tuple[str, float]], limit: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asked = known.value
        names = sorted({x for _, ts in asked for x in ts})
        place = {x: k for k, x in enumerate(names)}
        counts = np.zeros((len(names), len(asked)))
        for j, (_, ts) in enumerate(asked):
            for x in ts:
                counts[place[x], j] += 1
        if not names:
            return
        machine = ahocorasick.Automaton()
        for x, k in place.items():
            machine.add_word(x, (k, len(x)))
        machine.make_automaton()
        caches: list[dict] = [{} for _ in fields]

        def worth(value: str | None, field: int) -> np.ndarray | float:
            kind, weight = fields[field]
            cache, small = caches[field], value is not None and len(value) <= 32
            if not value:
                return 0.0
            if small and value in cache:
                return cache[value]
            found = {k for end, (k, n) in machine.iter(value.lower()) if kind != "prefix" or end + 1 == n}
            score = weight * counts[sorted(found)].sum(axis=0) if found else 0.0
            if small and len(cache) < 4096:
                cache[value] = score
            return score

        ids = np.array([q for q, _ in asked], np.int64)
        best_s, best_d = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for lo in range(0, batch.num_rows, 1024):
                rows = range(lo, min(lo + 1024, batch.num_rows))
                scores = np.zeros((len(ids), len(rows)))
                for k, r in enumerate(rows):
                    for f in range(len(fields)):
                        scores[:, k] += worth(columns[f + 1][r], f)
                docs = np.array(columns[0][lo : lo + len(rows)], np.int64)
                best_s, best_d = np.concatenate([best_s, scores], axis=1), np.concatenate([best_d, np.broadcast_to(docs, scores.shape)], axis=1)
                order = np.lexsort((best_d, -best_s), axis=1)[:, :limit]
                best_s, best_d = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_d, order, 1)
        q, k = np.nonzero(best_s > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_d[q, k]), pa.array(best_s[q, k])], ["query_id", "doc_id", "lexical_score"])

    return scan


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, distance, dense_rank): exact k nearest rows (doc_id, vec) by squared distance.

    Queries (query_id, vec) go to the tasks in blocks of bounded size; each task keeps its own k best of a block, so just
    those reach the final ranking.
    """
    spark, out = rows.sparkSession, None
    total = queries.count()
    blocks = max(1, -(-total // block))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "vec").toArrow()
        ids = part.column("query_id").to_numpy()
        x = np.array(part.column("vec").to_pylist(), float)
        known = spark.sparkContext.broadcast((ids, x))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            ids, x = known.value
            if not len(ids):
                return
            best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    piece = batch.slice(lo, 1024)
                    y = np.array(piece.column(1).to_pylist(), float)
                    d = np.stack([((y - q) ** 2).sum(axis=1) for q in x])
                    best_d = np.concatenate([best_d, d], axis=1)
                    best_i = np.concatenate([best_i, np.broadcast_to(piece.column(0).to_numpy(), d.shape)], axis=1)
                    order = np.lexsort((best_i, np.round(best_d, 9)), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
            if best_d.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])), pa.array(best_i.reshape(-1)), pa.array(best_d.reshape(-1))], ["query_id", "doc_id", "distance"])

        one = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "vec").mapInArrow(run, "query_id long, doc_id long, distance double")
        out = one if out is None else out.union(one)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
    return out.withColumn("dense_rank", F.row_number().over(w)).where(F.col("dense_rank") <= k)


def distance_score(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(F.lit(1.0) - c, 6))


def merge(dense: DataFrame, found: DataFrame) -> DataFrame:
    """Full outer merge of dense and lexical matches."""
    both = dense.join(found, ["query_id", "doc_id"], "full_outer")
    source = F.concat_ws("+", F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical")))
    return both.select("query_id", "doc_id", "distance", F.least("dense_rank", "lexical_rank").alias("rank"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), source.alias("match_source"))


def overlap(q: Column, t: Column) -> Column:
    n = F.size(F.array_distinct(q))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / n)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def rerank(matches: DataFrame) -> DataFrame:
    """matches (query_id, q, doc_id, text, section, title, distance, rank) with rerank_score and new_rank."""
    q = terms(F.col("q"))
    whole = F.concat_ws(" ", F.col("title"), F.col("section"), F.col("text"))
    parts = F.coalesce(distance_score(F.col("distance")), F.lit(0.0)) * DISTANCE + overlap(q, terms(F.concat_ws(" ", "section", "text"))) * LEXICAL
    parts = parts + overlap(q, terms(F.col("section"))) * SECTION + overlap(q, terms(F.col("title"))) * TITLE
    parts = parts + F.when(F.contains(F.lower(whole), F.lower("q")), 1.0).otherwise(0.0) * PHRASE
    scored = matches.withColumn("rerank_score", F.round(parts, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("rank"), "doc_id")
    return scored.withColumn("new_rank", F.row_number().over(w))


def _holds(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(p)) for p in phrases))


def rerank_assets(matches: DataFrame) -> DataFrame:
    """matches (query_id, q, doc_id, text, label, kind, page, terms, distance, rank) with rerank_score and new_rank.

    kind: page_image or another; page: its number as text; terms: important terms of the asset.
    """
    q, shown = terms(F.col("q")), F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit("")))
    image = F.col("kind") == "page_image"
    flag = lambda test, value: F.when(test, value).otherwise(0.0)
    score = F.coalesce(distance_score(F.col("distance")), F.lit(0.0)) * DISTANCE + overlap(q, terms(shown)) * LEXICAL + overlap(q, terms(F.coalesce("label", F.lit("")))) * TITLE
    score = score + flag(F.contains(F.lower(shown), F.lower("q")), PHRASE) + overlap(q, F.col("terms")) * ONTOLOGY + flag(image, PAGE_IMAGE) + flag(F.array_contains(q, F.col("page")), PAGE_NUMBER)
    seen = flag(image, PAGE_IMAGE) + flag(_holds(shown, VISUAL_TEXT), VISUAL_TEXT_BONUS) + flag(F.length(F.trim("text")) >= VISUAL_LENGTH, VISUAL_LENGTH_BONUS)
    scored = matches.withColumn("rerank_score", F.round(F.round(score, 6) + flag(_holds(F.col("q"), VISUAL_QUERY), seen), 6))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("rank"), "doc_id")))


def allowed(scored: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, document, total, place): the documents that a query's context may come from, of the greatest summed scores.

    scored: (query_id, document, score); plans: (query_id, kind, spread). How many depends on the spread, on the kind of question
    and on how far the first is ahead of the second.
    """
    held = scored.groupBy("query_id", "document").agg(F.round(F.sum(F.greatest(F.lit(LEAST_DOCUMENT_SCORE), "score")), 6).alias("total"))
    w = Window.partitionBy("query_id")
    ranked_ = held.withColumns({"place": F.row_number().over(w.orderBy(F.desc("total"), "document")), "documents": F.count("*").over(w)})
    nth = lambda n: F.max(F.when(F.col("place") == n, F.col("total"))).over(w)
    both = ranked_.withColumns({"first": nth(1), "second": nth(2)}).join(plans.select("query_id", "kind", "spread"), "query_id")
    return both.where(F.col("place") <= documents_kept()).select("query_id", "document", "total", "place")


def documents_kept() -> Column:
    """Of (kind, spread, documents, first, second), the last two scores: how many documents stay."""
    ahead = lambda by: F.coalesce(F.col("first") >= by * F.col("second"), F.lit(True))
    kind, spread = F.col("kind"), F.col("spread")
    rules = (
        (spread == "broad", F.lit(SPREAD["broad"])), (kind == "visual_lookup", F.when(ahead(VISUAL_LEAD), 1).otherwise(2)), (F.col("documents") == 1, F.lit(1)), (spread == "single", F.lit(SPREAD["single"])), (spread == "few", F.lit(SPREAD["few"])),
        (kind.isin("definition", "source_lookup"), F.when(ahead(LOOKUP_LEAD), 1).otherwise(2)), (kind.isin("fact", "explanation", "procedure") & (F.col("documents") >= 3), F.lit(3)),
    )
    return F.coalesce(*(F.when(holds, n) for holds, n in rules), F.lit(2))


def plan(kind: Column, k: Column, visual: Column, spread: Column, kg_limit: int = 6, graph_limit: int = 6) -> dict[str, Column]:
    """How a question is searched: mode, search_k, select_k, neighbours, graph and assets, and how far its documents are spread.

    kind: its type; k: results asked for; visual: pictures are needed; spread: what the router said, used where it's a known one.
    """
    seen = visual | (kind == "visual_lookup")
    lookup, compared, wide = kind.isin("definition", "fact", "source_lookup"), kind == "comparison", ~kind.isin("definition", "fact", "source_lookup", "comparison", "visual_lookup")
    more = F.when(seen & (lookup | wide), F.greatest(3 * k, k + 6)).when(wide, F.greatest(2 * k, k + 3)).otherwise(F.greatest(2 * k, k + 4))
    least = F.when(kind == "visual_lookup", 3).when(compared, 5).otherwise(4)
    told = F.when(F.lower(F.trim(spread)).isin(*SPREAD), F.lower(F.trim(spread))).when(kind.isin("comparison", "fact", "explanation", "procedure"), "few").otherwise("single")
    mode = F.when(kind == "visual_lookup", "multimodal_focus").when(lookup, F.when(seen, "hybrid_visual_support").otherwise("hybrid_kg_support")).when(compared, "hybrid_compare").when(seen, "neighbor_visual_expansion").otherwise("neighbor_expansion")
    return {
        "mode": mode, "search_k": F.least(more, F.lit(LIMIT)).cast("int"), "select_k": F.least(F.greatest(least, k), F.lit(MOST_CONTEXT)).cast("int"), "expand": compared | wide, "kg": (kind != "visual_lookup") & F.lit(kg_limit > 0),
        "graph": (compared | kind.isin("explanation", "procedure")) & F.lit(graph_limit > 0), "assets": seen, "spread": F.when(kind.isin("visual_lookup", "comparison") & (told == "single"), "few").otherwise(told),
    }


def within_plan(dense: DataFrame, found: DataFrame, plans: DataFrame) -> DataFrame:
    """merge() of what each query's search_k lets in; a query whose vector failed has lexical matches only. plans: (query_id, search_k)."""
    most = plans.select("query_id", "search_k")
    cut = lambda df, rank: df.join(most, "query_id").where(F.col(rank) <= F.col("search_k")).drop("search_k")
    return merge(cut(dense, "dense_rank"), cut(found, "lexical_rank"))


def compress(scored: DataFrame, k: int, signature: int, plans: DataFrame | None = None, alike: float = DIVERSITY) -> DataFrame:
    """(query_id, doc_id, place): the context kept of scored (query_id, doc_id, document, score, text).

    Only the documents stay that the query's plan allows (query_id, kind, spread; a few where there is none); by score, a text
    goes whose signature (its first characters, white space evened) repeats a kept one's or shares `alike` of the words with one;
    k stay at most.
    A query has LIMIT * 2 candidates at most, so its fold is small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, kept = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for q, d, text, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    query, kept = q, []
                mine = set(words)
                if len(kept) < k and not any(text == s or len(mine & o) >= alike * max(1, len(mine | o)) for s, o in kept):
                    kept.append((text, mine))
                    out.append((q, d, len(kept)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["query_id", "doc_id", "place"])

    if plans is None:
        plans = scored.select("query_id").distinct().select("query_id", F.lit("fact").alias("kind"), F.lit("few").alias("spread"))
    few = allowed(scored, plans)
    text = F.substring(F.regexp_replace(F.lower("text"), "\\s+", " "), 1, signature)
    slim = scored.join(few.select("query_id", "document"), ["query_id", "document"], "left_semi").select("query_id", "doc_id", "score", text.alias("signature"))
    ordered = slim.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "doc_id")
    return ordered.select("query_id", "doc_id", "signature", terms(F.col("signature")).alias("words")).mapInArrow(run, "query_id long, doc_id long, place int")


def diversify(ranked: DataFrame, k: int = 8, penalty: float = DIVERSITY, signature: list[str] | None = None) -> DataFrame:
    """Greedy choice per query: a candidate's score less penalty times its largest likeness to what is kept; the kept list
    is sorted again and cut to k after each, so later items may evict earlier ones. At most LIMIT * 2 candidates a query.

    signature: columns of which a candidate that repeats an earlier choice's values is passed over once max(2, k // 2) are kept.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, int, int, set]] = []
        seen: set[str] = set()
        for r in rows.sort_values("new_rank").itertuples(index=False):
            if signature and r.signature in seen and len(kept) >= max(2, k // 2):
                continue
            seen.add(r.signature)
            mine = set(r.terms)
            like = max((len(mine & other) / max(1, len(mine | other)) for *_, other in kept), default=0.0)
            kept.append((round(r.rerank_score - penalty * like, 6), -int(r.new_rank), int(r.doc_id), mine))
            kept = sorted(kept, key=lambda x: (x[0], x[1]), reverse=True)[:k]
        return pd.DataFrame([(rows.query_id.iloc[0], d, s, i) for i, (s, _, d, _) in enumerate(kept, 1)], columns=["query_id", "doc_id", "score", "place"])

    slim = ranked.select("query_id", "doc_id", "rerank_score", "new_rank", F.array_distinct(terms(F.col("text"))).alias("terms"), F.to_json(F.array(*(F.col(c).cast("string") for c in signature or []))).alias("signature"))
    return slim.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, score double, place int")


def neighbours(base: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, chunk_id, at): those before and after a query's first chunks that aren't chosen themselves.

    base: (query_id, chunk_id, new_rank); links: (chunk_id, before, after).
    """
    near = base.where(F.col("new_rank") <= NEIGHBOURED).join(links, "chunk_id")
    ends = near.select("query_id", "new_rank", F.posexplode(F.array("before", "after")).alias("end", "chunk_id")).where("chunk_id IS NOT NULL")
    fresh = ends.join(base.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return fresh.groupBy("query_id", "chunk_id").agg(F.min(2 * F.col("new_rank") + F.col("end")).alias("at"))


def first_places(found: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("at")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def expand_by_synopsis(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, doc_id, guided, boost): first chunks of the best sections, then of the best documents none of them is from.

    hits: (query_id, document, section, lexical_score) of questions whose type is widened; chunks: (doc_id, document, section).
    A section's first chunks are the same for all queries, so they are cut out before they meet these.
    """
    first = lambda df, keys, order, n: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
    best = lambda keys: hits.groupBy("query_id", *keys).agg(F.max("lexical_score").alias("s"))
    sections = first(best(["document", "section"]), ["query_id"], [F.desc("s"), "document", "section"], SECTIONS)
    documents = first(best(["document"]), ["query_id"], [F.desc("s"), "document"], DOCUMENTS).join(sections.select("query_id", "document"), ["query_id", "document"], "left_anti")
    row = lambda df, guided, most, by, plus: df.select("query_id", "doc_id", F.lit(guided).alias("guided"), F.round(F.least(F.lit(most), F.col("s") / by + plus), 6).alias("boost"))
    a = sections.join(first(chunks, ["document", "section"], ["doc_id"], SECTION_CHUNKS), ["document", "section"])
    b = documents.join(first(chunks, ["document"], ["doc_id"], DOCUMENT_CHUNKS).drop("section"), "document")
    return row(a, "section", 0.42, 40, 0.08).unionByName(row(b, "document", 0.28, 48, 0.04))
