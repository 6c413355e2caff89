"""Rules around an answer: cleaning, abstention, routing, preferences, stable facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: phrases that an answer loses where it opens with them. A lead names the sources and ends with one of its marks, or
# may do without where the marks begin with "?"; a hedge is followed by a space, a preface by one of its marks.
SOURCES = ("sources", "indexed corpus", "retrieved evidence")
LEADS = {"based on": ":", "according to": "?:,", "from": "?:,"}
HEDGE_PHRASES = (("i think", "i believe", "i guess", "i would say"), ("i'm not sure, but", "i'm not sure but", "i'm not sure,", "i'm not sure", "i am not sure, but", "i am not sure but", "i am not sure,", "i am not sure"), ("it seems", "it looks like", "it appears"))
PREFACES = (("here's what", "heres what", "here's the short version", "heres the short version", "here's the simple version", "heres the simple version"), ("in plain terms",))
PREFACE_MARKS = ":-"


def opening(phrases: tuple[str, ...], after: str) -> str:
    """A pattern of texts that open with one of the phrases, longer ones first, and what follows it."""
    return f"(?i)^(?:{'|'.join(sorted(phrases, key=len, reverse=True))}){after}"


def _lead(words: str, marks: str) -> str:
    named = tuple(f"{words} {the}{provided}{source}" for source in SOURCES for the in ("", "the ") for provided in ("", "provided "))
    return opening(named, f"\\s*[{marks.lstrip('?')}]{'?' if marks.startswith('?') else ''}\\s*")


CLAIM_OPENINGS = tuple(_lead(words, marks) for words, marks in LEADS.items())
HEDGES = tuple(opening(p, "\\s+") for p in HEDGE_PHRASES) + tuple(opening(p, f"\\s*[{PREFACE_MARKS}]\\s*") for p in PREFACES)
# fixed values: what a user says, and the preference it tells
PREFERENCES = {
    "prefer_step_by_step": ("step by step", "steps", "walk me through"),
    "prefer_brief_answers": ("brief", "short answer", "keep it short"),
    "prefer_technical_depth": ("technical", "really technical", "deeply technical", "detailed"),
    "prefer_simple_language": ("simple", "plain language", "easy to understand"),
    "prefer_explicit_citations": ("cite", "citations", "sources", "evidence"),
    "prefer_visual_evidence": ("image", "images", "figure", "diagram", "visual"),
}
STYLES = {"technical": "prefer_technical_depth", "plain": "prefer_simple_language", "concise": "prefer_brief_answers"}
PROCEDURAL = ("step by step", "walk me through")
LEAST_CONFIDENCE = 0.55
MOST_RESULTS = 12


def _without(c: Column, openings: tuple[str, ...]) -> Column:
    return F.trim(F.regexp_replace(reduce(lambda x, p: F.regexp_replace(x, p, ""), openings, F.trim(c)), "\\s+", " "))


def clean_claim(c: Column) -> Column:
    return _without(c, CLAIM_OPENINGS)


def clean_answer(c: Column) -> Column:
    """The answer without a reference to its sources and without hedging at its start."""
    return _without(clean_claim(c), HEDGES)


def abstain_reason(citations: Column, confidence: Column, answer: Column, model_abstained: Column, grounded: Column, open_world: bool = True) -> Column:
    """Why no answer is given, or null. An open-world answer, one of enough confidence, needs no citation and no grounding."""
    said = F.trim(F.coalesce(answer, F.lit(""))) != ""
    sure = F.coalesce(confidence, F.lit(0.0)) >= LEAST_CONFIDENCE
    free = said & sure if open_world else F.lit(False)
    rules = (("no_valid_citations", (citations == 0) & ~free), ("low_confidence", ~sure), ("empty_answer", ~said), ("model_abstained", model_abstained), ("weak_grounding", ~grounded & ~free))
    return F.coalesce(*(F.when(holds, F.lit(reason)) for reason, holds in rules))


def route(asked: DataFrame, top_k: Column) -> DataFrame:
    """asked (kind, enabled, provider, has_key, failed, router_kind, router_top_k, confidence) with source, question_type, top_k.

    The router counts only if it may run, did run and is sure; else the question's own type and its number of results do.
    """
    why = F.coalesce(
        F.when(~F.col("enabled"), "fallback:disabled"), F.when(F.col("provider") != "remote", "fallback:provider_disabled"), F.when(~F.col("has_key"), "fallback:no_api_key"),
        F.when(F.col("failed"), "fallback:error"), F.when(F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE, "fallback:low_confidence"), F.lit("router"),
    )
    routed = asked.withColumn("source", why)
    ok = F.col("source") == "router"
    size = F.when(ok, F.greatest(F.lit(1), F.least(F.lit(MOST_RESULTS), F.col("router_top_k")))).otherwise(top_k)
    return routed.withColumn("question_type", F.when(ok, F.coalesce("router_kind", "kind")).otherwise(F.col("kind"))).withColumn("top_k", size.cast("int"))


def preferences(turns: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, preferences, style) of a user's turns; phrases are looked for within each turn, so the turns needn't be joined."""
    low = F.lower(F.col(text))
    says = lambda phrases: F.coalesce(F.bool_or(reduce(lambda x, y: x | y, (F.contains(low, F.lit(p)) for p in phrases))), F.lit(False))
    g = turns.groupBy(group).agg(*(says(p).alias(hint) for hint, p in PREFERENCES.items()), says(PROCEDURAL).alias("__steps"))
    style = F.coalesce(*(F.when(F.col(hint), F.lit(s)) for s, hint in STYLES.items()), F.when(F.col("__steps"), "procedural"), F.lit(""))
    return g.select(group, F.array_compact(F.array(*(F.when(F.col(h), F.lit(h)) for h in PREFERENCES))).alias("preferences"), style.alias("style"))


def stable_facts(facts: DataFrame, group: str, limit: int) -> DataFrame:
    """The best facts (group, place, fact) of (group, at, fact, source_type, confidence, assertions, supports).

    The first of equal facts, in any case, counts. A user's own report comes first, then a fact with support, then confidence,
    assertions, other support, length, and the earlier one.
    """
    some = facts.withColumn("fact", F.trim("fact")).where("fact <> ''")
    rest = ["at", "fact", "source_type", "confidence", "assertions", "supports"]
    once = some.groupBy(group, F.lower("fact").alias("__key")).agg(F.min_by(F.struct(*rest), F.struct("at", "fact")).alias("f")).select(group, "f.*")
    kind = F.when(F.col("source_type") == "user_self_report", 2).when(F.col("assertions") + F.col("supports") > 0, 1).otherwise(0)
    order = [F.desc(kind), F.desc(F.round(F.col("confidence") * 1000)), F.desc("assertions"), F.desc("supports"), F.desc(F.length("fact")), "at", "fact"]
    w = Window.partitionBy(group).orderBy(*order)
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(group, "place", "fact")
