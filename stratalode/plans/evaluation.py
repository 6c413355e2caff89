"""Registered queries: the evaluation harness; expected terms come from `benchmark`, results from retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.operators import context as X
from stratalode.operators import evaluation as E
from stratalode.plans import retrieval as P
from stratalode.plans.catalog import Tables, query

_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
_EXPECTED = f"list_distinct(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN {_STOP}))"
_BASE = f"""{P.RERANK}, ex AS (SELECT query_id, {_EXPECTED} AS expected FROM q), hit AS (SELECT query_id, doc_id, source, new_rank, expected, list_filter(expected, lambda x: contains(lower(text), x)) AS hits FROM ranked JOIN ex USING (query_id) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
cov AS (SELECT *, round(CASE WHEN len(expected) = 0 THEN 1.0 ELSE CAST(len(hits) AS DOUBLE) / len(expected) END, 3) AS coverage FROM hit)"""


def expected(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: (F.length(x) >= 4) & ~x.isin(*X.STOPWORDS)))


def covered(t: Tables) -> DataFrame:
    r = P.ranked(t).withColumn("expected", expected(F.col("q")))
    hits = F.filter("expected", lambda x: F.contains(F.lower("text"), x))
    share = F.when(F.size("expected") == 0, 1.0).otherwise(F.size("hits") / F.size("expected"))
    return r.withColumn("hits", hits).select("query_id", "doc_id", F.col("title").alias("source"), "new_rank", "expected", "hits", F.round(share, 3).alias("coverage"))


@query("ev_terms", f"WITH q AS (SELECT item_id AS query_id, text AS q FROM benchmark) SELECT query_id, list_sort({_EXPECTED}) AS terms FROM q")
def ev_terms(t: Tables) -> DataFrame:
    return P.queries(t).select("query_id", F.array_sort(expected(F.col("q"))).alias("terms"))


@query("ev_hits", f"{_BASE} SELECT query_id, doc_id, list_sort(hits) AS hits FROM cov")
def ev_hits(t: Tables) -> DataFrame:
    return covered(t).select("query_id", "doc_id", F.array_sort("hits").alias("hits"))


@query("ev_coverage", f"{_BASE} SELECT query_id, max(coverage) AS best_coverage, arg_min(coverage, new_rank) AS first_coverage FROM cov GROUP BY query_id")
def ev_coverage(t: Tables) -> DataFrame:
    return covered(t).groupBy("query_id").agg(F.max("coverage").alias("best_coverage"), F.min_by("coverage", "new_rank").alias("first_coverage"))


_FOUND = "fo AS (SELECT query_id, list_sort(list(DISTINCT source)) AS names, ['SRC' || (query_id % 20), 'none'] AS wanted, ['Src1' || (query_id % 10)] AS barred FROM cov WHERE new_rank <= 12 GROUP BY query_id)"


def _documents(t: Tables) -> DataFrame:
    """The sources of a query's best twelve, with sources that its id makes it expect and bars."""
    g = covered(t).where("new_rank <= 12").groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("names"))
    k = F.col("query_id")
    return g.select("query_id", "names", F.array(F.concat(F.lit("SRC"), k % 20), F.lit("none")).alias("wanted"), F.array(F.concat(F.lit("Src1"), k % 10)).alias("barred"))


def _held(part: str) -> str:
    return f"list_filter(names, lambda n: len(list_filter({part}, lambda w: contains(lower(n), lower(w)))) > 0)"


@query("ev_docs", f"{_BASE}, {_FOUND} SELECT query_id, {_held('wanted')} AS expected_found, {_held('barred')} AS forbidden_found FROM fo")
def ev_docs(t: Tables) -> DataFrame:
    names = F.col("names")
    return _documents(t).select("query_id", E.matching(names, F.col("wanted")).alias("expected_found"), E.matching(names, F.col("barred")).alias("forbidden_found"))


_PASS = "best >= 0.5 AND n >= 3 AND sources <= 12"
_RUN = f"{_BASE}, run AS (SELECT query_id, max(coverage) AS best, count(*) AS n, count(DISTINCT source) AS sources FROM cov WHERE new_rank <= 12 GROUP BY query_id)"


def _run(t: Tables) -> DataFrame:
    return covered(t).where("new_rank <= 12").groupBy("query_id").agg(F.max("coverage").alias("best"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("ev_retrieval", f"{_RUN} SELECT query_id, best, n, sources, {_PASS} AS passed FROM run")
def ev_retrieval(t: Tables) -> DataFrame:
    return _run(t).withColumn("passed", F.expr(_PASS))


_CASES = f"""{_BASE}, {_FOUND}, rn AS (SELECT query_id, max(coverage) AS best, arg_min(coverage, new_rank) AS first, count(*) AS n, max(len(expected)) AS n_terms FROM cov WHERE new_rank <= 12 GROUP BY 1),
ag AS (SELECT rn.*, names, wanted, barred, best < 0.4 AS silent, CASE WHEN query_id % 5 = 0 THEN true END AS want_silent FROM rn JOIN fo USING (query_id)),
ck AS (SELECT query_id, silent, want_silent, query_id % 4 <> 0 OR query_id % 8 = 0 AS router_ok, coalesce(silent = want_silent, true) AS abstention_ok, len({_held('wanted')}) > 0 AS document_ok, len({_held('barred')}) = 0 AS forbidden_ok, query_id % 6 <> 0 AS kind_ok,
  CASE WHEN silent THEN coalesce(silent = want_silent, true) ELSE first >= 0.3 END AS grounding_ok, silent OR n > 0 AS citation_ok, silent OR best >= CASE WHEN query_id % 3 = 0 THEN 0.5 ELSE 0.0 END AS confidence_ok,
  first >= CASE WHEN n_terms > 0 THEN {E.ANSWER_COVERAGE} ELSE 0.0 END AS answer_ok, best >= CASE WHEN n_terms > 0 AND NOT silent THEN {E.CITATION_COVERAGE} ELSE 0.0 END AS support_ok FROM ag)"""
_ALL = " AND ".join(E.CHECKS)


@query("ev_agent", f"{_CASES} SELECT count(*) AS queries, count(*) FILTER ({_ALL}) AS passed, round(CAST(count(*) FILTER ({_ALL}) AS DOUBLE) / greatest(count(*), 1), 4) AS pass_rate, count(*) FILTER (want_silent) AS abstention_cases, count(*) FILTER (want_silent AND abstention_ok) AS abstention_passed, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in E.CHECKS)} FROM ck")
def ev_agent(t: Tables) -> DataFrame:
    """Coverage stands for confidence and grounding; a weak best one abstains. What cases expect comes from their ids."""
    k = F.col("query_id")
    g = covered(t).where("new_rank <= 12").groupBy("query_id").agg(F.max("coverage").alias("confidence"), F.min_by("coverage", "new_rank").alias("answer_coverage"), F.count("*").alias("citations"), F.max(F.size("expected")).alias("n_terms"))
    runs = g.join(_documents(t), "query_id").select(
        "*", (F.col("confidence") < 0.4).alias("abstained"), F.lit("low_confidence").alias("abstain_reason"), (F.col("answer_coverage") >= 0.3).alias("grounded"), F.col("names").alias("filenames"),
        F.array(F.lit("chunk")).alias("kinds"), F.col("confidence").alias("citation_coverage"), F.lit("fact").alias("question_type"), F.when(k % 8 == 0, "fact").when(k % 4 == 0, "definition").alias("expected_type"),
        F.when(k % 5 == 0, True).alias("expected_abstained"), F.col("wanted").alias("expected_documents"), F.col("barred").alias("forbidden_documents"), F.when(k % 6 == 0, F.array(F.lit("chunk"), F.lit("asset"))).alias("expected_kinds"),
        F.when(k % 3 == 0, 0.5).alias("least_confidence"), F.lit(None).cast("double").alias("least_answer"), F.lit(None).cast("double").alias("least_citation"),
    )
    return E.summary(E.judge(runs))


@query("ev_resolve", "WITH w AS (SELECT DISTINCT lower(trim(name)) AS name FROM (SELECT upper(source) AS name FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT ' ') WHERE trim(name) <> '') SELECT doc_id, source AS filename FROM documents JOIN w ON lower(source) = name")
def ev_resolve(t: Tables) -> DataFrame:
    """Documents, with their file names, that have one of the wanted names in any case; blank names want nothing."""
    d = t("documents").select("doc_id", F.col("source").alias("filename"))
    wanted = d.where("doc_id % 3 = 0").select(F.lower(F.trim(F.upper("filename"))).alias("name")).where("name <> ''").distinct()
    return d.join(wanted, F.lower("filename") == F.col("name"), "left_semi")


@query("ev_text", f"{P.RERANK} SELECT query_id, string_agg(substr(text, 1, 200), chr(10) ORDER BY new_rank) AS text, CAST(sum(length(text)) AS BIGINT) AS chars FROM ranked WHERE new_rank <= 5 GROUP BY query_id")
def ev_text(t: Tables) -> DataFrame:
    top = P.ranked(t).where("new_rank <= 5")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_rank", F.substring("text", 1, 200).alias("x")))), lambda s: s["x"]), "\n")  # five at most
    return top.groupBy("query_id").agg(parts.alias("text"), F.sum(F.length("text")).alias("chars"))
