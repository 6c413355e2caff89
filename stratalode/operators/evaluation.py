"""Evaluation of answers against what a case expects; what a case leaves open always holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: least coverage of expected terms where a case names none
ANSWER_COVERAGE, CITATION_COVERAGE = 0.35, 0.25
CHECKS = ("router_ok", "abstention_ok", "document_ok", "forbidden_ok", "kind_ok", "grounding_ok", "citation_ok", "confidence_ok", "answer_ok", "support_ok")


def matching(names: Column, wanted: Column) -> Column:
    """The names that hold one of the wanted parts, in any case."""
    return F.filter(names, lambda n: F.exists(wanted, lambda w: F.contains(F.lower(n), F.lower(w))))


def judge(runs: DataFrame) -> DataFrame:
    """runs with the CHECKS and passed.

    A run: question_type, abstained, abstain_reason, confidence, grounded, citations, filenames, kinds, n_terms (expected
    terms), answer_coverage, citation_coverage; of the case, each may be null: expected_type, expected_abstained,
    expected_documents, forbidden_documents, expected_kinds, least_confidence, least_answer, least_citation.
    """
    c, silent = F.col, F.col("abstained")
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) < 1
    abstention = c("expected_abstained").isNull() | (silent == c("expected_abstained"))
    asked = c("n_terms") > 0
    checks = (
        c("expected_type").isNull() | (c("question_type") == c("expected_type")),
        abstention,
        empty("expected_documents") | ~empty(matching(c("filenames"), c("expected_documents"))),
        empty("forbidden_documents") | empty(matching(c("filenames"), c("forbidden_documents"))),
        empty("expected_kinds") | empty(F.array_except("expected_kinds", "kinds")),
        F.when(silent, abstention & (F.coalesce("abstain_reason", F.lit("")) != "")).otherwise(c("grounded")),
        silent | (c("citations") > 0),
        silent | (c("confidence") >= F.coalesce("least_confidence", F.lit(0.0))),
        c("answer_coverage") >= F.coalesce("least_answer", F.when(asked, ANSWER_COVERAGE).otherwise(0.0)),
        c("citation_coverage") >= F.coalesce("least_citation", F.when(asked & ~silent, CITATION_COVERAGE).otherwise(0.0)),
    )
    judged = runs.select("*", *(F.coalesce(ok, F.lit(False)).alias(name) for name, ok in zip(CHECKS, checks, strict=True)))
    return judged.withColumn("passed", reduce(lambda x, y: x & y, map(F.col, CHECKS)))


def summary(judged: DataFrame) -> DataFrame:
    """One row: cases, passed, their share, cases that expect an abstention, how many of these got one, and each check's count."""
    wants = F.coalesce("expected_abstained", F.lit(False))
    n, ok = F.count("*"), F.count_if("passed")
    return judged.agg(
        n.alias("queries"), ok.alias("passed"), F.round(ok / F.greatest(n, F.lit(1)), 4).alias("pass_rate"),
        F.count_if(wants).alias("abstention_cases"), F.count_if(wants & F.col("abstention_ok")).alias("abstention_passed"), *(F.count_if(c).alias(c) for c in CHECKS),
    )
