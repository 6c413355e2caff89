"""Context budgets, grounding of answers in evidence, extractive answers and conversation memory."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words that tell no topic
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "have", "not", "but", "you", "all")


# fixed values: the parts of a prompt in the order in which they give way, those that keep their first item, the one that loses its oldest
PARTS = ("topics", "constraints", "threads", "facts", "chains", "evidence", "sensors", "assets", "entities", "assertions", "chunks", "history")
KEEP_FIRST, OLDEST_GOES = ("facts", "chunks"), "history"


def fit(items: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, kept, trimmed, chars) of prompts: items (group, part, place, size) go one by one until the rest is within the limit.

    They go by part, the last of a part first, in the history the oldest first; one fact, one chunk and the newest turn stay.
    An item goes if what is there before it goes is over the limit, so running sums decide and no loop is needed.
    """
    of_part = Window.partitionBy(group, "part")
    ends = items.withColumn("__first", F.min("place").over(of_part)).withColumn("__last", F.max("place").over(of_part))
    oldest = F.col("part") == OLDEST_GOES
    stays = (F.col("part").isin(*KEEP_FIRST) & (F.col("place") == F.col("__first"))) | (oldest & (F.col("place") == F.col("__last")))
    order = [stays, F.array_position(F.array(*map(F.lit, PARTS)), F.col("part")), F.when(oldest, F.col("place")).otherwise(-F.col("place"))]
    w = Window.partitionBy(group)
    running = ends.withColumn("__before", F.sum("size").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    left = F.sum("size").over(w) - F.coalesce("__before", F.lit(0))
    judged = running.withColumn("__goes", ~stays & (left > limit))
    return judged.groupBy(group).agg(F.count_if(~F.col("__goes")).alias("kept"), F.count_if("__goes").alias("trimmed"), F.coalesce(F.sum(F.when(~F.col("__goes"), F.col("size"))), F.lit(0)).alias("chars"))


def newest_within(df: DataFrame, group: str, order: str, text: str, limit: int) -> DataFrame:
    """Rows of each group from the newest back while their characters fit the limit; the first that doesn't fit ends it.

    A plain running sum, so no fold is needed.
    """
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= limit)


def keywords(c: Column) -> Column:
    """Distinct lower-case words of three or more characters, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}_]{3,})"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*STOPWORDS)))


def excerpt(text: Column, first: Column, width: int = 120) -> Column:
    """width characters around the first place of a term, with dots where text was left out."""
    at = F.instr(F.lower(text), first)
    start = F.greatest(F.lit(1), at - width // 2)
    body = F.substr(text, start, F.lit(width))
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), body, F.when(start + width <= F.length(text), F.lit("...")).otherwise(F.lit("")))


def best_sentences(quotes: list[str], keywords: set[str], top: int = 3) -> str:
    """The extractive answer: sentences of the quotes by place and keyword hits."""
    seen, rows = set(), []
    for q in quotes[:4]:
        for k, s in enumerate(x.strip() for x in re.split(r"(?<=[.!?])\s+", q)[:4]):
            if len(s) >= 24 and s.lower() not in seen:
                seen.add(s.lower())
                words = set(re.findall(r"\w+", s.lower()))
                rows.append((-(2 * (k == 0) + len(words & keywords)), len(s), s))
    return " ".join(s for *_, s in sorted(rows)[:top])


def opening(c: Column) -> Column:
    """The start of a text that a memory keeps."""
    return F.substring(F.trim(F.split(F.coalesce(c, F.lit("")), "\\.")[0]), 1, 120)


def merge_memory(rows: DataFrame, group: str, order: str, text: str, limit: int = 600) -> DataFrame:
    """(group, summary): what the texts say first, oldest first, each once, as far as a budget of characters has room.

    Equal openings are merged before they are gathered.
    """
    once = rows.groupBy(group, opening(F.col(text)).alias("opening")).agg(F.min(order).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "opening"))), lambda x: x["opening"])
    said = once.groupBy(group).agg(F.filter(listed, lambda x: x != "").alias("said"))
    room = lambda kept, x: F.length(F.array_join(kept, "")) + F.length(x) <= limit
    kept = F.aggregate("said", F.array().cast("array<string>"), lambda acc, x: F.when(room(acc, x), F.array_append(acc, x)).otherwise(acc))
    return said.select(group, F.array_join(kept, " | ").alias("summary"))


#: The parts of an answer that a model returns as JSON; ids may also come with its citations.
ANSWER = "answer string, confidence string, abstained boolean, abstain_reason string, used_chunk_ids array<string>, citations array<struct<chunk_id:string>>"
#: Fixed value: confidence of an answer that comes as plain text.
PLAIN_CONFIDENCE = 0.74
PLAIN_CHUNKS = 3


def coerce_answer(content: Column, context_ids: Column) -> Column:
    """(answer, confidence, abstained, abstain_reason, used_chunk_ids, plain) of what a model returned.

    JSON is read as it is, from a code fence, or from the first brace to the last; ids that are blank go, and those of the
    citations stand in where none are left. Anything else is the answer in plain text, which rests on the context's first chunks.
    """
    whole = F.btrim(F.coalesce(content, F.lit("")), F.lit(" \n\r\t"))
    fenced = F.regexp_extract(whole, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    inner = F.when(fenced != "", fenced).otherwise(whole)
    braced = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    sound = F.when(F.get_json_object(whole, "$").isNotNull() & whole.startswith("{"), whole).when(F.get_json_object(braced, "$").isNotNull(), braced)
    p = F.from_json(sound, ANSWER)
    said = lambda ids: F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.btrim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    cited = said(F.transform(p["citations"], lambda x: x["chunk_id"]))
    read = F.struct(
        F.btrim(F.coalesce(p["answer"], F.lit(""))).alias("answer"), F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(p["abstained"], F.lit(False)).alias("abstained"),
        p["abstain_reason"].alias("abstain_reason"), F.when(F.size(said(p["used_chunk_ids"])) > 0, said(p["used_chunk_ids"])).otherwise(cited).alias("used_chunk_ids"), F.lit(False).alias("plain"),
    )
    plain = F.struct(whole.alias("answer"), F.lit(PLAIN_CONFIDENCE).alias("confidence"), F.lit(False).alias("abstained"), F.lit(None).cast("string").alias("abstain_reason"), said(F.slice(context_ids, 1, PLAIN_CHUNKS)).alias("used_chunk_ids"), F.lit(True).alias("plain"))
    return F.when(sound.isNotNull(), read).otherwise(plain)
