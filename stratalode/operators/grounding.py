"""Grounding of answers: claims, the evidence rows that share their terms, and what follows for the answer.

Claims meet evidence by terms, never all with all: evidence is inverted once per group and term, and a term keeps the first few
rows that hold it, as no claim reports more. Claims then count their covered terms by class (any, numeric, not in the question).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalode.operators.answers import clean_claim

# fixed values: words that say nothing about a claim
STOPWORDS = (
    "about", "after", "also", "among", "because", "been", "being", "between", "could", "does", "doing", "each", "from", "have", "into", "more", "most",
    "only", "other", "over", "same", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under", "very",
    "what", "when", "where", "which", "while", "with", "would", "your",
)
TERM, TRIMMED = "[a-z0-9%:/.\\-]{3,}", ".,;:()[]{}"
# fixed values: limits of claims, what they report, and the shares that support them
CLAIM_CHARS, MOST_CLAIMS, MOST_IDS, MOST_UNSUPPORTED, SUBSET = 320, 8, 4, 6, 3
FEW_NOVEL, NOVEL_SHARE = 2, 0.6
RELAXED, LOOKUPS = ("explanation", "procedure", "comparison"), ("source_lookup", "visual_lookup")
LEAST_SHARE, STRICT_SHARE, SUBSET_SHARE = 0.66, 0.75, 0.25
ABSTAIN_REASONS = ("no_retrieval_results", "no_valid_citations", "low_confidence", "model_abstained", "agent_provider_disabled", "agent_generation_error", "empty_answer", "weak_grounding")
FALLBACKS = ("claim_verifier_error", "lexical_fallback", "supported_subset")


def terms(c: Column) -> Column:
    """Distinct lower-case terms of letters, digits and %:/.- with three or more characters, trimmed, without stop words."""
    found = F.regexp_extract_all(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(""))), F.lit(f"({TERM})"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(TRIMMED))), lambda x: (x != "") & ~x.isin(*STOPWORDS)))


def claims(answer: Column) -> Column:
    """Sentences and lines with two terms or a digit, cut to 320 characters, eight at most; the whole text where none has."""
    whole = F.regexp_replace(F.replace(F.coalesce(answer, F.lit("")), F.lit("\0"), F.lit("")), "^\\s+|\\s+$", "")
    parts = F.transform(F.split(whole, "(?<=[.!?;])\\s+|\\n+"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    said = F.filter(parts, lambda x: (F.size(terms(x)) >= 2) | x.rlike("[0-9]"))
    found = F.when(F.size(said) > 0, said).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.transform(found, lambda x: F.substring(x, 1, CLAIM_CHARS)), 1, MOST_CLAIMS)


def support(answers: DataFrame, evidence: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """(group, key, place, claim, supported, evidence_ids) of every claim of answers (group, key, answer, question).

    evidence: (group, at, id, text); a claim's ids come in the order of `at`. A claim is supported if its numeric terms are all
    covered, and of its terms that the question lacks all are (two at most) or 0.6; one without such terms, if any evidence shares
    a term. A claim without terms is not.
    """
    by = [*group, *key]
    split = answers.select(*by, "answer", terms(F.col("question")).alias("asked")).select(*by, "asked", F.posexplode(claims(F.col("answer"))).alias("place", "claim"))
    each = split.select(*by, "asked", "place", "claim", F.posexplode_outer(terms(F.col("claim"))).alias("nth", "term"))
    # a claim's text goes along with its first term only, all others know it by its hash
    said = F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("claim"))
    wanted = each.select(*by, "place", F.xxhash64("claim").alias("hash"), said.alias("claim"), "term", F.col("term").rlike("[0-9]").alias("numeric"), (~F.array_contains("asked", F.col("term"))).alias("novel"))
    held = evidence.select(*group, "at", "id", F.explode(terms(F.col("text"))).alias("term"))
    first = held.withColumn("n", F.row_number().over(Window.partitionBy(*group, "term").orderBy("at", "id"))).where(F.col("n") <= MOST_IDS)
    rows = first.groupBy(*group, "term").agg(F.collect_set(F.struct("at", "id")).alias("rows"))  # MOST_IDS at most
    met = wanted.join(rows, [*group, "term"], "left")
    hit, numeric, novel = F.col("rows").isNotNull(), F.coalesce("numeric", F.lit(False)), F.coalesce("novel", F.lit(False)) & F.col("term").isNotNull()
    told = F.array_distinct(F.array_sort(F.flatten(F.collect_list(F.when(numeric | novel, F.col("rows"))))))
    counted = met.groupBy(*by, "place", "hash").agg(
        F.max("claim").alias("claim"), F.count("term").alias("terms"), F.count_if(numeric).alias("numeric"), F.count_if(numeric & hit).alias("numeric_met"), F.count_if(novel).alias("novel"), F.count_if(novel & hit).alias("novel_met"), F.count_if(hit).alias("met"), told.alias("told")
    )
    share = F.when(F.col("novel") <= FEW_NOVEL, 1.0).otherwise(NOVEL_SHARE)
    ok = F.when((F.col("terms") == 0) | (F.col("numeric_met") < F.col("numeric")), False).when(F.col("novel") == 0, F.col("met") > 0).otherwise(F.col("novel_met") / F.col("novel") >= share)
    ids = F.slice(F.filter(F.array_distinct(F.transform("told", lambda x: x["id"].cast("string"))), lambda x: x != ""), 1, MOST_IDS)
    return counted.select(*by, "place", "claim", ok.alias("supported"), ids.alias("evidence_ids"))


def check(answers: DataFrame, judged: DataFrame, key: list[str], least: float = LEAST_SHARE) -> DataFrame:
    """(key, question_type, claims, supported, supported_ratio, unsupported_claims, passed), one row an answer (key, question_type).

    Two claims at most must all be supported. More need `least` of them for relaxed types of questions, which may miss one claim
    without a number; others need 0.75 and may miss none. An answer without claims doesn't pass.
    """
    missed = F.filter(F.array_sort(F.collect_list(F.struct("place", "claim", "supported"))), lambda x: ~x["supported"])  # eight at most
    g = judged.groupBy(*key).agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"), F.transform(missed, lambda x: x["claim"]).alias("missed"))
    out = answers.select(*key, "question_type").join(g, key, "left").withColumns({"claims": F.coalesce("claims", F.lit(0)), "supported": F.coalesce("supported", F.lit(0)), "missed": F.coalesce("missed", F.array().cast("array<string>"))})
    ratio = F.round(F.col("supported") / F.greatest("claims", F.lit(1)), 4)
    relaxed = F.col("question_type").isin(*RELAXED)
    needed = F.when(F.col("claims") <= 2, 1.0).when(relaxed, least).otherwise(max(STRICT_SHARE, least))
    numeric = F.exists("missed", lambda x: x.rlike("[0-9]"))
    enough = ~numeric & F.when(relaxed & (F.col("claims") >= 3), F.size("missed") <= 1).otherwise(F.size("missed") == 0)
    return out.select(*key, "question_type", "claims", "supported", ratio.alias("supported_ratio"), F.slice("missed", 1, MOST_UNSUPPORTED).alias("unsupported_claims"), ((F.col("claims") > 0) & (ratio >= needed) & enough).alias("passed"))


def supported_subset(checked: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """(key, answer, evidence_ids): the first three supported claims, where an answer may fall back on them.

    Not for look-ups, not with an unsupported number, and not under a quarter of supported claims.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("place", "claim", "evidence_ids"))))  # eight at most
    g = judged.groupBy(*key).agg(listed.alias("said")).where(F.size("said") > 0)
    fit = checked.where(~F.col("question_type").isin(*LOOKUPS) & (F.col("supported_ratio") >= SUBSET_SHARE) & ~F.exists("unsupported_claims", lambda x: x.rlike("[0-9]"))).select(*key)
    text = F.array_join(F.transform(F.slice("said", 1, SUBSET), lambda x: x["claim"]), " ")
    return g.join(fit, key).select(*key, clean_claim(text).alias("answer"), F.array_distinct(F.flatten(F.transform("said", lambda x: x["evidence_ids"]))).alias("evidence_ids"))


def judge_verdicts(verdicts: DataFrame, answers: DataFrame, evidence: DataFrame, group: list[str], key: list[str], least: float = LEAST_SHARE) -> DataFrame:
    """What a model's verdicts (group, key, place, claim, supported, basis, ids) mean for answers (group, key, answer, verdict).

    Ids that aren't among the group's evidence don't count. A claim stands on evidence, or without any on world knowledge if it
    has no number. Returns (group, key, claims, supported, supported_ratio, coverage, world_claims, passed).
    """
    by = [*group, *key]
    claim = F.trim("claim")
    each = verdicts.select(*by, "place", F.xxhash64(claim).alias("hash"), (claim != "").alias("said"), claim.rlike("[0-9]").alias("digits"), "supported", "basis", F.explode_outer("ids").alias("id"))
    known = evidence.select(*group, F.col("id").cast("string").alias("id"), F.lit(True).alias("known")).distinct()
    held = each.join(known, [*group, "id"], "left").groupBy(*by, "place", "hash", "said", "digits", "supported", "basis").agg(F.count_if("known").alias("ids"))
    world = F.col("supported") & (F.col("basis") == "world_knowledge") & (F.col("ids") == 0) & ~F.col("digits")
    stands = (F.col("supported") & (F.col("ids") > 0)) | world
    g = held.groupBy(*by).agg(F.count("*").alias("claims"), F.count_if("said").alias("seen"), F.count_if(stands).alias("supported"), F.count_if(world).alias("world_claims"), F.count_if(~stands & F.col("said")).alias("missed"))
    out = answers.select(*by, "verdict", F.greatest(F.size(claims(F.col("answer"))), F.lit(1)).alias("expected")).join(g, by, "left").fillna(0, ["claims", "seen", "supported", "world_claims", "missed"])
    ratio, coverage = F.when(F.col("claims") > 0, F.round(F.col("supported") / F.col("claims"), 4)).otherwise(0.0), F.round(F.col("seen") / F.col("expected"), 4)
    passed = F.coalesce("verdict", F.lit(False)) & (F.col("supported") >= 1) & (ratio >= least) & (coverage >= F.when(F.col("expected") <= 2, 1.0).otherwise(STRICT_SHARE)) & (F.col("missed") == 0)
    return out.select(*by, "claims", "supported", ratio.alias("supported_ratio"), coverage.alias("coverage"), "world_claims", passed.alias("passed"))


def review_state(a: dict[str, Column], least_confidence: float = 0.72, least: float = LEAST_SHARE) -> tuple[Column, Column]:
    """(status, reason) of an answer; the first that holds counts.

    a: abstained, abstain_reason, open_world, open_world_fallback, last_resort, method, world_claims and unsupported (counts),
    supported_ratio, confidence, supports (how many assertions, assets, sensor rows and evidence rows it rests on).
    """
    code = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(a["abstain_reason"], F.lit("")))), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    reasons = (
        (a["abstained"], F.when(code.isin(*ABSTAIN_REASONS), code).otherwise("model_abstained")), (a["open_world"], F.lit("open_world_answer")), (a["open_world_fallback"], F.lit("open_world_fallback")), (a["last_resort"], F.lit("last_resort_fallback")),
        (a["method"].isin(*FALLBACKS), a["method"]), (a["world_claims"] > 0, F.lit("world_knowledge_support")), (a["unsupported"] > 0, F.lit("unsupported_claims")),
        (a["supported_ratio"] < max(STRICT_SHARE, least), F.lit("weak_grounding_support")), (a["confidence"] < least_confidence, F.lit("low_answer_confidence")),
    )
    reason = F.coalesce(*(F.when(holds, why) for holds, why in reasons))
    return F.when(reason.isNotNull(), "needs_review").otherwise("unreviewed"), F.coalesce(reason, F.when(a["supports"] == 0, "chunk_only_answer"), F.lit(""))
