"""Registered queries: budgets, citations, grounding, answers and memory over `conversations` and retrieved documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.operators import answers as A
from stratalode.operators import context as X
from stratalode.operators import grounding as G
from stratalode.operators import retrieval as R
from stratalode.operators import state as Z
from stratalode.plans import retrieval as P
from stratalode.plans.catalog import SQL, Tables, query
from stratalode.session import shared_path

_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


def kterms(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{3,}}'), lambda x: x NOT IN {_STOP}))"


def _cut(c: str, openings) -> str:
    for p in openings:
        c = f"""regexp_replace({c}, '{p.replace("'", "''")}', '')"""
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"




@query("bud_history", "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) WHERE used <= 2000")
def bud_history(t: Tables) -> DataFrame:
    return X.newest_within(t("conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "used")


_PARTS_SQL = "[" + ", ".join(f"'{p}'" for p in X.PARTS) + "]"


@query("bud_fit", f"""WITH i AS (SELECT conv_id, turn AS place, {_PARTS_SQL}[CAST(turn % 12 AS INTEGER) + 1] AS part, length(text) AS size FROM conversations),
e AS (SELECT *, (part IN ('facts', 'chunks') AND place = min(place) OVER p) OR (part = 'history' AND place = max(place) OVER p) AS stays FROM i WINDOW p AS (PARTITION BY conv_id, part)),
r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) - coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY stays, list_position({_PARTS_SQL}, part), CASE WHEN part = 'history' THEN place ELSE -place END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain FROM e)
SELECT conv_id, count(*) FILTER (stays OR remain <= 1200) AS kept, count(*) FILTER (NOT (stays OR remain <= 1200)) AS trimmed, CAST(coalesce(sum(size) FILTER (stays OR remain <= 1200), 0) AS BIGINT) AS chars FROM r GROUP BY 1""")
def bud_fit(t: Tables) -> DataFrame:
    """A conversation's turns as the items of a prompt, dealt to its twelve parts."""
    part = F.element_at(F.array(*map(F.lit, X.PARTS)), (F.col("turn") % 12 + 1).cast("int"))
    return X.fit(t("conversations").select("conv_id", F.col("turn").alias("place"), part.alias("part"), F.length("text").alias("size")), "conv_id", 1200)


@query("bud_bundle", "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 100), chr(10) ORDER BY turn) AS prompt, count(*) AS parts FROM conversations GROUP BY conv_id")
def bud_bundle(t: Tables) -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 100))
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("l"), F.count("*").alias("parts"))  # turns of one prompt
    return g.select("conv_id", F.array_join(F.transform("l", lambda s: s["x"]), "\n").alias("prompt"), "parts")


@query("src_mark", f"{P.RERANK} SELECT query_id, doc_id, match_source, new_rank <= 8 AND rerank_score > 0.2 AS selected FROM ranked")
def src_mark(t: Tables) -> DataFrame:
    return P.ranked(t).select("query_id", "doc_id", "match_source", ((F.col("new_rank") <= 8) & (F.col("rerank_score") > 0.2)).alias("selected"))


_FIRST = "coalesce(list_filter(terms, lambda x: length(x) >= 4)[1], '')"


@query("cite_excerpt", f"{P.RERANK}, cx AS (SELECT query_id, doc_id, text, instr(lower(text), {_FIRST}) AS at0, {_FIRST} AS f FROM ranked WHERE new_rank <= 5), sx AS (SELECT *, greatest(1, at0 - 60) AS start FROM cx WHERE f <> '') SELECT query_id, doc_id, CASE WHEN start > 1 THEN '...' ELSE '' END || substr(text, start, 120) || CASE WHEN start + 120 <= length(text) THEN '...' ELSE '' END AS excerpt FROM sx")
def cite_excerpt(t: Tables) -> DataFrame:
    first = F.coalesce(F.get(F.filter(R.terms(F.col("q")), lambda x: F.length(x) >= 4), F.lit(0)), F.lit(""))
    c = P.ranked(t).where("new_rank <= 5").withColumn("f", first).where("f <> ''")
    return c.select("query_id", "doc_id", X.excerpt(F.col("text"), F.col("f")).alias("excerpt"))


@query("cite_build", f"{P.RERANK} SELECT query_id, doc_id AS citation_id, 'chunk' AS kind, new_rank AS place FROM ranked WHERE new_rank <= 3 UNION ALL SELECT query_id, min(doc_id), 'source', CAST(0 AS INTEGER) FROM ranked GROUP BY query_id")
def cite_build(t: Tables) -> DataFrame:
    r = P.ranked(t)
    a = r.where("new_rank <= 3").select("query_id", F.col("doc_id").alias("citation_id"), F.lit("chunk").alias("kind"), F.col("new_rank").alias("place"))
    return a.unionByName(r.groupBy("query_id").agg(F.min("doc_id").alias("citation_id")).select("query_id", "citation_id", F.lit("source").alias("kind"), F.lit(0).alias("place")))


@query("cite_filter", f"{P.RERANK} SELECT query_id, doc_id FROM ranked JOIN labels USING (doc_id) WHERE quality = 1")
def cite_filter(t: Tables) -> DataFrame:
    return P.ranked(t).select("query_id", "doc_id").join(t("labels").where("quality = 1"), "doc_id", "left_semi").select("query_id", "doc_id")


@query("abstain", f"""{P.RERANK}, g AS (SELECT query_id, count(*) FILTER (new_rank <= 8 AND lexical_score > 0) AS citations, max(rerank_score) AS confidence, arg_min(doc_id, new_rank) AS doc_id, arg_min(text, new_rank) AS answer, arg_min(lexical_score, new_rank) > 0 AS grounded FROM ranked GROUP BY 1),
h AS (SELECT g.*, coalesce(toxic, 0) = 1 AS model_abstained, trim(answer) <> '' AS said FROM g LEFT JOIN labels USING (doc_id))
SELECT query_id, coalesce(CASE WHEN citations = 0 AND NOT (said AND confidence >= {A.LEAST_CONFIDENCE}) THEN 'no_valid_citations' WHEN confidence < {A.LEAST_CONFIDENCE} THEN 'low_confidence' WHEN NOT said THEN 'empty_answer' WHEN model_abstained THEN 'model_abstained' END, 'none') AS reason,
  coalesce(CASE WHEN citations = 0 THEN 'no_valid_citations' WHEN confidence < {A.LEAST_CONFIDENCE} THEN 'low_confidence' WHEN NOT said THEN 'empty_answer' WHEN model_abstained THEN 'model_abstained' WHEN NOT grounded THEN 'weak_grounding' END, 'none') AS strict_reason FROM h""")
def abstain(t: Tables) -> DataFrame:
    """The best document is the answer, its label of toxic text stands for a model that gives none; matched words are citations."""
    g = P.ranked(t).groupBy("query_id").agg(
        F.count_if((F.col("new_rank") <= 8) & (F.col("lexical_score") > 0)).alias("citations"), F.max("rerank_score").alias("confidence"),
        F.min_by("doc_id", "new_rank").alias("doc_id"), F.min_by("text", "new_rank").alias("answer"), (F.min_by("lexical_score", "new_rank") > 0).alias("grounded"),
    )
    h = g.join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    why = lambda free: F.coalesce(A.abstain_reason(F.col("citations"), F.col("confidence"), F.col("answer"), F.coalesce("toxic", F.lit(0)) == 1, F.col("grounded"), free), F.lit("none"))
    return h.select("query_id", why(True).alias("reason"), why(False).alias("strict_reason"))


_GSTOP = "(" + ", ".join(f"'{w}'" for w in G.STOPWORDS) + ")"


def gterms(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(replace(coalesce({c}, ''), chr(0), '')), '{G.TERM}'), lambda x: trim(x, '{G.TRIMMED}')), lambda x: x <> '' AND x NOT IN {_GSTOP}))"


@query("ground_terms", f"SELECT conv_id, turn, list_sort({gterms('text')}) AS terms FROM conversations")
def ground_terms(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.array_sort(G.terms(F.col("text"))).alias("terms"))


_WHOLE = r"regexp_replace(replace(coalesce(text, ''), chr(0), ''), '^\s+|\s+$', '', 'g')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_WHOLE}, '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: len({gterms('c')}) >= 2 OR regexp_matches(c, '[0-9]'))"
_CLAIMS = f"list_transform(CASE WHEN len({_SENTENCES}) > 0 THEN {_SENTENCES} WHEN {_WHOLE} <> '' THEN [{_WHOLE}] ELSE CAST([] AS VARCHAR[]) END, lambda c: substr(c, 1, {G.CLAIM_CHARS}))[1:{G.MOST_CLAIMS}]"


@query("ground_split", f"SELECT conv_id, turn, {_CLAIMS} AS claims FROM conversations WHERE role = 'assistant'")
def ground_split(t: Tables) -> DataFrame:
    return t("conversations").where("role = 'assistant'").select("conv_id", "turn", G.claims(F.col("text")).alias("claims"))


def answers(t: Tables) -> DataFrame:
    """Assistant turns as answers to the user's turn before, with its type; without one the question is empty."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = lambda c: F.last(F.when(F.col("role") == "user", c), ignorenulls=True).over(w)
    said = t("conversations").withColumns({"question": F.coalesce(before(F.col("text")), F.lit("")), "question_type": F.coalesce(before(P.question_type(F.lower("text"))), F.lit("fact"))})
    return said.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), "question", "question_type")


def evidence(t: Tables) -> DataFrame:
    """The conversation's other turns as the rows that an answer may rest on."""
    return t("conversations").where("role <> 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("turn").alias("id"), "text")


def judged(t: Tables) -> DataFrame:
    return G.support(answers(t), evidence(t), ["conv_id"], ["turn"])


def stored(t: Tables) -> DataFrame:
    """What was judged, written once for all that read it."""
    path = shared_path(t.spark, "judged")
    judged(t).write.parquet(path)
    return t.spark.read.parquet(path)


_BEFORE = "last_value(CASE WHEN role = 'user' THEN {} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)"
_SUPPORT = f"""WITH asked AS (SELECT conv_id, turn, role, text, coalesce({_BEFORE.format('text')}, '') AS question, coalesce({_BEFORE.format(P._CLASS)}, 'fact') AS question_type FROM (SELECT *, lower(text) AS x FROM conversations)),
ans AS (SELECT * FROM asked WHERE role = 'assistant'),
cs AS (SELECT conv_id, turn, question, unnest({_CLAIMS}) AS claim, CAST(generate_subscripts({_CLAIMS}, 1) - 1 AS INTEGER) AS place FROM ans),
ct AS (SELECT *, {gterms('claim')} AS a FROM cs),
cn AS (SELECT conv_id, turn, place, claim, a, list_filter(a, lambda x: regexp_matches(x, '[0-9]')) AS num, list_filter(a, lambda x: NOT list_contains(q, x)) AS nov FROM (SELECT *, {gterms('question')} AS q FROM ct)),
ev AS (SELECT conv_id, turn AS spot, {gterms('text')} AS b FROM conversations WHERE role <> 'assistant'),
ag AS (SELECT conv_id, list_distinct(flatten(list(b))) AS b FROM ev GROUP BY 1),
tl AS (SELECT c.conv_id, c.turn, c.place, list(CAST(spot AS VARCHAR) ORDER BY spot)[1:{G.MOST_IDS}] AS ids FROM cn c JOIN ev e ON e.conv_id = c.conv_id AND (list_has_any(c.num, e.b) OR list_has_any(c.nov, e.b)) GROUP BY 1, 2, 3),
r AS (SELECT c.conv_id, c.turn, place, claim, coalesce(CASE WHEN len(a) = 0 OR len(list_intersect(num, coalesce(b, []))) < len(num) THEN false WHEN len(nov) = 0 THEN len(list_intersect(a, coalesce(b, []))) > 0
  ELSE len(list_intersect(nov, coalesce(b, []))) / len(nov) >= CASE WHEN len(nov) <= {G.FEW_NOVEL} THEN 1.0 ELSE {G.NOVEL_SHARE} END END, false) AS supported, coalesce(ids, CAST([] AS VARCHAR[])) AS evidence_ids
  FROM cn c LEFT JOIN ag USING (conv_id) LEFT JOIN tl USING (conv_id, turn, place))"""


@query("ground_support", f"{_SUPPORT} SELECT conv_id, turn, place, claim, supported, evidence_ids FROM r")
def ground_support(t: Tables) -> DataFrame:
    """Every claim of every answer against the conversation's other turns, with the turns that it rests on."""
    return judged(t)


_CHECKED = f"""ck AS (SELECT a.conv_id, a.turn, a.question_type, count(claim) AS claims, count(claim) FILTER (supported) AS supported, coalesce(list(claim ORDER BY place) FILTER (NOT supported), CAST([] AS VARCHAR[])) AS missed
  FROM ans a LEFT JOIN r USING (conv_id, turn) GROUP BY 1, 2, 3),
checked AS (SELECT conv_id, turn, question_type, claims, supported, round(supported / greatest(claims, 1), 4) AS supported_ratio, missed[1:{G.MOST_UNSUPPORTED}] AS unsupported_claims,
  claims > 0 AND round(supported / greatest(claims, 1), 4) >= CASE WHEN claims <= 2 THEN 1.0 WHEN question_type IN {G.RELAXED} THEN {G.LEAST_SHARE} ELSE {G.STRICT_SHARE} END
  AND len(list_filter(missed, lambda x: regexp_matches(x, '[0-9]'))) = 0 AND len(missed) <= CASE WHEN question_type IN {G.RELAXED} AND claims >= 3 THEN 1 ELSE 0 END AS passed FROM ck)"""


@query("ground_check", f"{_SUPPORT}, {_CHECKED} SELECT * FROM checked")
def ground_check(t: Tables) -> DataFrame:
    """Whether an answer's claims carry it; the question before says how strict that is."""
    return G.check(answers(t), judged(t), ["conv_id", "turn"])


_SUBSET = f"""sub AS (SELECT conv_id, turn, {_cut(f"array_to_string(list(claim ORDER BY place)[1:{G.SUBSET}], ' ')", A.CLAIM_OPENINGS)} AS answer, flatten(list(evidence_ids ORDER BY place)) AS all_ids
  FROM r JOIN checked USING (conv_id, turn) WHERE r.supported AND question_type NOT IN {G.LOOKUPS} AND supported_ratio >= {G.SUBSET_SHARE} AND len(list_filter(unsupported_claims, lambda x: regexp_matches(x, '[0-9]'))) = 0 GROUP BY 1, 2)"""


@query("ground_subset", f"{_SUPPORT}, {_CHECKED}, {_SUBSET} SELECT conv_id, turn, answer, list_filter(all_ids, lambda x, i: list_position(all_ids, x) = i) AS evidence_ids FROM sub")
def ground_subset(t: Tables) -> DataFrame:
    """What is left of an answer if only its supported claims are said."""
    key, rows = ["conv_id", "turn"], stored(t)
    return G.supported_subset(G.check(answers(t), rows, key), rows, key)


_VERDICTS = f"""vd AS (SELECT conv_id, turn, place, CASE WHEN (turn + place) % 11 = 0 THEN '' ELSE trim(claim) END AS claim, supported OR (turn + place) % 5 = 0 AS says, CASE WHEN (turn + place) % 5 = 0 THEN [] WHEN (turn + place) % 7 = 0 THEN ['none'] ELSE evidence_ids END AS ids, (turn + place) % 5 = 0 AS world FROM r WHERE (turn + place) % 13 <> 0),
vs AS (SELECT *, says AND len(ids) > 0 AND ids <> ['none'] AS held, says AND world AND len(ids) = 0 AND NOT regexp_matches(claim, '[0-9]') AS known FROM vd),
vg AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (held OR known) AS supported, count(*) FILTER (claim <> '') AS seen, count(*) FILTER (known) AS world_claims, count(*) FILTER (NOT (held OR known) AND claim <> '') AS missed FROM vs GROUP BY 1, 2),
vx AS (SELECT a.conv_id, a.turn, greatest(len({_CLAIMS}), 1) AS expected, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(seen, 0) AS seen, coalesce(world_claims, 0) AS world_claims, coalesce(missed, 0) AS missed FROM ans a LEFT JOIN vg USING (conv_id, turn)),
model AS (SELECT conv_id, turn, claims, supported, CASE WHEN claims > 0 THEN round(supported / claims, 4) ELSE 0.0 END AS supported_ratio, round(seen / expected, 4) AS coverage, world_claims,
  turn % 9 <> 0 AND supported >= 1 AND supported / claims >= {G.LEAST_SHARE} AND round(seen / expected, 4) >= CASE WHEN expected <= 2 THEN 1.0 ELSE {G.STRICT_SHARE} END AND missed = 0 AS passed FROM vx)"""


def verdicts(judged_: DataFrame) -> DataFrame:
    """Verdicts as a model might give them, from the lexical ones: some claims left out, some on world knowledge or on rows that aren't there."""
    n = F.col("turn") + F.col("place")
    ids = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 7 == 0, F.array(F.lit("none"))).otherwise(F.col("evidence_ids"))
    rows = judged_.where(n % 13 != 0)
    return rows.select("conv_id", "turn", "place", F.when(n % 11 == 0, "").otherwise(F.trim("claim")).alias("claim"), (F.col("supported") | (n % 5 == 0)).alias("supported"), F.when(n % 5 == 0, "world_knowledge").otherwise("evidence").alias("basis"), ids.alias("ids"))


def model_checked(t: Tables, judged_: DataFrame) -> DataFrame:
    return G.judge_verdicts(verdicts(judged_), answers(t).withColumn("verdict", F.col("turn") % 9 != 0), evidence(t), ["conv_id"], ["turn"])


@query("ground_model", f"{_SUPPORT}, {_VERDICTS} SELECT * FROM model")
def ground_model(t: Tables) -> DataFrame:
    """A model's verdicts on claims, made from the lexical ones, scored: coverage of the claims, ids that exist, world knowledge."""
    return model_checked(t, judged(t))


_REVIEWED = f"""rv AS (SELECT m.*, k.unsupported_claims, (m.turn + m.conv_id) % 6 AS how FROM model m JOIN checked k USING (conv_id, turn)),
rw AS (SELECT *, CASE WHEN how = 0 THEN 'weak_grounding' WHEN how = 1 AND turn % 4 = 1 THEN 'open_world_answer' WHEN how = 1 THEN 'last_resort_fallback' WHEN how = 2 THEN 'lexical_fallback' WHEN world_claims > 0 THEN 'world_knowledge_support' WHEN len(unsupported_claims) > 0 THEN 'unsupported_claims'
  WHEN supported_ratio < {G.STRICT_SHARE} THEN 'weak_grounding_support' WHEN coverage < 0.72 THEN 'low_answer_confidence' END AS why FROM rv)"""


@query("ground_review", f"{_SUPPORT}, {_CHECKED}, {_VERDICTS}, {_REVIEWED} SELECT conv_id, turn, CASE WHEN why IS NULL THEN 'unreviewed' ELSE 'needs_review' END AS status, coalesce(why, CASE WHEN supported = world_claims THEN 'chunk_only_answer' ELSE '' END) AS reason FROM rw")
def ground_review(t: Tables) -> DataFrame:
    """The state of every answer: how it came about is told by its numbers, the rest by the checks; coverage stands for confidence."""
    key, rows = ["conv_id", "turn"], stored(t)
    m = model_checked(t, rows).join(G.check(answers(t), rows, key).select(*key, "unsupported_claims"), key)
    how = (F.col("turn") + F.col("conv_id")) % 6
    said = {
        "abstained": how == 0, "abstain_reason": F.lit("Weak grounding"), "open_world": (how == 1) & (F.col("turn") % 4 == 1), "open_world_fallback": F.lit(False), "last_resort": how == 1, "method": F.when(how == 2, "lexical_fallback").otherwise("claim_verifier"),
        "world_claims": F.col("world_claims"), "unsupported": F.size("unsupported_claims"), "supported_ratio": F.col("supported_ratio"), "confidence": F.col("coverage"), "supports": F.col("supported") - F.col("world_claims"),
    }
    status, reason = G.review_state(said)
    return m.select(*key, status.alias("status"), reason.alias("reason"))


@query("ground_rows", "SELECT 'document' AS kind, doc_id AS id, substr(text, 1, 1600) AS text FROM documents UNION ALL SELECT 'page', page_id, substr(html, 1, 1600) FROM pages UNION ALL SELECT 'sensor', event_id, event_type || '=' || printf('%.2f', value) FROM events")
def ground_rows(t: Tables) -> DataFrame:
    row = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), text.alias("text"))
    return row(t("documents"), "document", "doc_id", F.substring("text", 1, 1600)).unionByName(row(t("pages"), "page", "page_id", F.substring("html", 1, 1600))).unionByName(row(t("events"), "sensor", "event_id", F.concat(F.col("event_type"), F.lit("="), F.format_string("%.2f", "value"))))


@query("ans_extractive", f"""{P.RERANK}, tx AS (SELECT query_id, new_rank, list_filter(list_transform(terms, lambda x: x), lambda x: true) AS terms, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:4] AS parts FROM ranked WHERE new_rank <= 4),
sn AS (SELECT query_id, new_rank, terms, unnest(list_transform(parts, lambda x: trim(x))) AS s, generate_subscripts(parts, 1) AS k FROM tx),
un AS (SELECT * FROM sn WHERE length(s) >= 24 QUALIFY row_number() OVER (PARTITION BY query_id, lower(s) ORDER BY new_rank, k) = 1),
sc AS (SELECT query_id, s, CASE WHEN k = 1 THEN 2 ELSE 0 END + len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')), terms)) AS score FROM un),
bs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(s), s) AS rn FROM sc QUALIFY rn <= 3),
an AS (SELECT query_id, string_agg(s, ' ' ORDER BY rn) AS answer FROM bs GROUP BY 1) SELECT query_id, coalesce(answer, '') AS answer FROM (SELECT DISTINCT query_id FROM tx) LEFT JOIN an USING (query_id)""")
def ans_extractive(t: Tables) -> DataFrame:
    """A deterministic answer for each query from its best four documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("new_rank")
        return pd.DataFrame({"query_id": [rows.query_id.iloc[0]], "answer": [X.best_sentences(rows.text.tolist(), set(rows.terms.iloc[0]))]})

    top = P.ranked(t).where("new_rank <= 4").select("query_id", "new_rank", "text", R.terms(F.col("q")).alias("terms"))
    return top.groupBy("query_id").applyInPandas(run, "query_id long, answer string")


@query("ans_last_resort", f"{P.RERANK}, g AS (SELECT query_id, max(rerank_score) AS best FROM ranked GROUP BY 1) SELECT item_id AS query_id, CAST(CASE WHEN best >= 0.3 THEN 0.42 ELSE 0.28 END AS DOUBLE) AS confidence FROM benchmark LEFT JOIN g ON item_id = query_id")
def ans_last_resort(t: Tables) -> DataFrame:
    g = P.ranked(t).groupBy("query_id").agg(F.max("rerank_score").alias("best"))
    return P.queries(t).select("query_id").join(g, "query_id", "left").select("query_id", F.when(F.col("best") >= 0.3, F.lit(0.42)).otherwise(F.lit(0.28)).alias("confidence"))


_OPENINGS = ("Based on the provided sources: ", "According to sources, ", "I think ", "I'm not sure, but ", "It seems ", "In plain terms: ")
_OPENED = "(CASE turn % 7 " + " ".join(f"WHEN {k} THEN '{o.replace(chr(39), chr(39) * 2)}'" for k, o in enumerate(_OPENINGS)) + " ELSE '' END || text)"


@query("ans_clean", f"SELECT conv_id, turn, {_cut(_cut(f'trim({_OPENED})', A.CLAIM_OPENINGS), A.HEDGES)} AS answer FROM conversations WHERE role = 'assistant'")
def ans_clean(t: Tables) -> DataFrame:
    """Turns that open as models do, each seventh in another way."""
    opened = F.lit("")
    for k, opening in enumerate(_OPENINGS):
        opened = F.when(F.col("turn") % 7 == k, opening).otherwise(opened)
    return t("conversations").where("role = 'assistant'").select("conv_id", "turn", A.clean_answer(F.concat(opened, "text")).alias("answer"))


_SAID = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'))"


@query(
    "ans_coerce",
    f"""WITH a AS (SELECT conv_id, turn, (turn + conv_id) % 5 AS shape, {_SAID} AS said FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE shape WHEN 0 THEN said WHEN 4 THEN trim(said || ' {{open') ELSE said END AS answer, CASE shape WHEN 0 THEN 0.74 WHEN 4 THEN 0.74 WHEN 1 THEN 0.9 WHEN 2 THEN 0.25 ELSE 0.0 END::DOUBLE AS confidence,
  shape = 2 AS abstained, CASE shape WHEN 0 THEN 'c1,c3' WHEN 4 THEN 'c1,c3' WHEN 1 THEN 'a' WHEN 2 THEN '' ELSE 'k1,k2' END AS used, shape IN (0, 4) AS plain FROM a""",
)
def ans_coerce(t: Tables) -> DataFrame:
    """Each assistant turn in one of five shapes: plain, JSON, fenced JSON, JSON within text, and a broken object."""
    said, shape = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")), (F.col("turn") + F.col("conv_id")) % 5
    put = lambda *x: F.concat(*(c if hasattr(c, "cast") else F.lit(c) for c in x))
    json = put('{"answer": " ', said, ' ", "confidence": 0.9, "used_chunk_ids": ["a", " "]}')
    fence = put('```json\n{"answer": "', said, '", "confidence": "0.25", "abstained": true, "abstain_reason": "thin"}\n```')
    within = put('Here: {"answer": "', said, '", "citations": [{"chunk_id": "k1"}, {"chunk_id": ""}, {"chunk_id": "k2"}]} so.')
    content = F.when(shape == 0, said).when(shape == 1, json).when(shape == 2, fence).when(shape == 3, within).otherwise(put(said, " {open"))
    got = X.coerce_answer(content, F.array(F.lit("c1"), F.lit(" "), F.lit("c3"), F.lit("c4")))
    out = t("conversations").where("role = 'assistant'").select("conv_id", "turn", got.alias("r"))
    return out.select("conv_id", "turn", "r.answer", "r.confidence", "r.abstained", F.array_join("r.used_chunk_ids", ",").alias("used"), "r.plain")


@query("mem_topics", rf"WITH w AS (SELECT conv_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}]{{4,}}'), lambda x: x NOT IN {_STOP})) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM w GROUP BY 1, 2) SELECT conv_id, word, n, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS rn FROM c) WHERE rn <= 8")
def mem_topics(t: Tables) -> DataFrame:
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}]{4,})"), 1), lambda x: ~x.isin(*X.STOPWORDS))
    c = t("conversations").select("conv_id", F.explode(found).alias("word")).groupBy("conv_id", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "word")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 8")


_SAYS = ", ".join("coalesce(bool_or(" + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + f"), false) AS {hint}" for hint, phrases in {**A.PREFERENCES, "steps_asked": A.PROCEDURAL}.items())
_STYLE = "CASE " + " ".join(f"WHEN {hint} THEN '{style}'" for style, hint in A.STYLES.items()) + " WHEN steps_asked THEN 'procedural' ELSE '' END"
_WISHES = ("walk me through it", "a short answer, please", "be really technical", "in plain language", "cite it", "show a figure")
_WISH = "CASE conv_id % 11 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WISHES)) + " ELSE '' END"


@query("mem_prefs", f"WITH c AS (SELECT conv_id, concat_ws(' ', text, {_WISH}) AS text FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, {_SAYS} FROM c GROUP BY 1) SELECT conv_id, list_filter([{', '.join(f"CASE WHEN {h} THEN '{h}' END" for h in A.PREFERENCES)}], lambda x: x IS NOT NULL) AS preferences, {_STYLE} AS style FROM g")
def mem_prefs(t: Tables) -> DataFrame:
    """User turns with a wish after them in six of eleven conversations."""
    return A.preferences(t("conversations").where("role = 'user'").select("conv_id", F.concat_ws(" ", "text", F.expr(_WISH)).alias("text")), "conv_id")


_PAIR = f"a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')"


@query("mem_threads", f"WITH {_PAIR} SELECT conv_id, turn, len(list_intersect({kterms('text')}, {kterms('before')})) >= greatest(1, least(2, len({kterms('before')}))) AS same_thread FROM a WHERE before IS NOT NULL")
def mem_threads(t: Tables) -> DataFrame:
    a = t("conversations").where("role = 'user'").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    x, y = X.keywords(F.col("text")), X.keywords(F.col("before"))
    return a.select("conv_id", "turn", (F.size(F.array_intersect(x, y)) >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(y)))).alias("same_thread"))


@query("mem_facts", """WITH s AS (SELECT conv_id, turn, role, unnest(string_split(text, '.')) AS fact, generate_subscripts(string_split(text, '.'), 1) AS k FROM conversations),
f AS (SELECT conv_id, turn * 100000 + k - 1 AS spot, trim(fact) AS fact, role = 'user' AS own, CASE WHEN turn % 2 = 0 THEN 0.85 ELSE 0.8 END AS confidence, CASE WHEN role = 'user' THEN 0 ELSE turn % 3 END AS assertions, CASE WHEN role = 'user' THEN 0 ELSE turn % 2 END AS supports FROM s WHERE trim(fact) <> ''),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, lower(fact) ORDER BY spot, fact) = 1)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN own THEN 2 WHEN assertions + supports > 0 THEN 1 ELSE 0 END DESC, round(confidence * 1000) DESC, assertions DESC, supports DESC, length(fact) DESC, spot, fact) AS INTEGER) AS place, fact FROM o QUALIFY place <= 10""")
def mem_facts(t: Tables) -> DataFrame:
    """Sentences as facts: a user's own, or an assistant's with a support made from the turn's number."""
    own = F.col("role") == "user"
    s = t("conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\\.")).alias("k", "fact"))
    facts = s.select(
        "conv_id", (F.col("turn") * 100000 + F.col("k")).alias("at"), "fact", F.when(own, "user_self_report").otherwise("retrieval_grounded").alias("source_type"), F.when(F.col("turn") % 2 == 0, 0.85).otherwise(0.8).alias("confidence"),
        F.when(own, 0).otherwise(F.col("turn") % 3).alias("assertions"), F.when(own, 0).otherwise(F.col("turn") % 2).alias("supports"),
    )
    return A.stable_facts(facts, "conv_id", 10)


@query("mem_session", f"""WITH f AS (SELECT conv_id, turn AS spot, substr(trim(string_split(coalesce(text, ''), '.')[1]), 1, 120) AS opening FROM conversations WHERE role = 'user'), o AS (SELECT conv_id, opening, min(spot) AS spot FROM f WHERE opening <> '' GROUP BY 1, 2), l AS (SELECT conv_id, list([opening] ORDER BY spot, opening) AS l FROM o GROUP BY 1),
m AS (SELECT conv_id, array_to_string(list_reduce(l, lambda a, x: CASE WHEN length(array_to_string(a, '')) + length(x[1]) <= 600 THEN list_concat(a, x) ELSE a END, CAST([] AS VARCHAR[])), ' | ') AS summary FROM l)
SELECT conv_id, coalesce(summary, '') AS summary FROM (SELECT DISTINCT conv_id FROM f) LEFT JOIN m USING (conv_id)""")
def mem_session(t: Tables) -> DataFrame:
    return X.merge_memory(t("conversations").where("role = 'user'"), "conv_id", "turn", "text")


@query("mem_profile", f"""WITH f AS (SELECT event_type, event_id AS spot, concat_ws(' ', event_type, strftime(ts, '%Y-%m-%d')) AS opening FROM events), o AS (SELECT event_type, opening, min(spot) AS spot FROM f WHERE opening <> '' GROUP BY 1, 2), l AS (SELECT event_type, list([opening] ORDER BY spot, opening) AS l FROM o GROUP BY 1),
m AS (SELECT event_type, array_to_string(list_reduce(l, lambda a, x: CASE WHEN length(array_to_string(a, '')) + length(x[1]) <= 240 THEN list_concat(a, x) ELSE a END, CAST([] AS VARCHAR[])), ' | ') AS summary FROM l)
SELECT event_type, coalesce(summary, '') AS summary FROM (SELECT DISTINCT event_type FROM f) LEFT JOIN m USING (event_type)""")
def mem_profile(t: Tables) -> DataFrame:
    """Events as a user's history: what happened on which day."""
    rows = t("events").select("event_type", "event_id", F.concat_ws(" ", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("text"))
    return X.merge_memory(rows, "event_type", "event_id", "text", 240)


@query("mem_filter", f"WITH {_PAIR} SELECT conv_id, turn, list_sort(list_intersect({kterms('text')}, {kterms('before')})) AS kept FROM a WHERE before IS NOT NULL")
def mem_filter(t: Tables) -> DataFrame:
    a = t("conversations").where("role = 'user'").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return a.select("conv_id", "turn", F.array_sort(F.array_intersect(X.keywords(F.col("text")), X.keywords(F.col("before")))).alias("kept"))


@query("mem_recent", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def mem_recent(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t("conversations").withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("conv_id", "turn", "role", "text")


@query("mem_budget", f"""WITH f AS (SELECT conv_id, turn AS spot, substr(trim(string_split(coalesce(text, ''), '.')[1]), 1, 120) AS opening FROM conversations), o AS (SELECT conv_id, opening, min(spot) AS spot FROM f WHERE opening <> '' GROUP BY 1, 2), l AS (SELECT conv_id, list([opening] ORDER BY spot, opening) AS l FROM o GROUP BY 1),
m AS (SELECT conv_id, array_to_string(list_reduce(l, lambda a, x: CASE WHEN length(array_to_string(a, '')) + length(x[1]) <= 200 THEN list_concat(a, x) ELSE a END, CAST([] AS VARCHAR[])), ' | ') AS summary FROM l)
SELECT conv_id, coalesce(summary, '') AS summary FROM (SELECT DISTINCT conv_id FROM f) LEFT JOIN m USING (conv_id)""")
def mem_budget(t: Tables) -> DataFrame:
    return X.merge_memory(t("conversations"), "conv_id", "turn", "text", 200)


@query("mem_normalize", "SELECT key, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, lower(trim(text)) AS key FROM documents WHERE text IS NOT NULL) WHERE key <> '' GROUP BY key")
def mem_normalize(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.lower(F.trim("text")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("mem_goal", "SELECT conv_id, substr(split_part(arg_min(text, turn), '.', 1), 1, 160) AS goal, sha256(string_agg(role, ',' ORDER BY turn)) AS signature FROM conversations GROUP BY conv_id")
def mem_goal(t: Tables) -> DataFrame:
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")  # turns of one session
    return t("conversations").groupBy("conv_id").agg(F.substring(F.split_part(F.min_by("text", "turn"), F.lit("."), F.lit(1)), 1, 160).alias("goal"), F.sha2(roles, 256).alias("signature"))


@query(
    "mem_store",
    """WITH w AS (SELECT conv_id, turn, length(text) AS size FROM conversations WHERE role = 'assistant' AND turn % 7 <> 3), r AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
m AS (SELECT r.conv_id, r.turn, w.turn AS version, w.size FROM r ASOF LEFT JOIN w ON r.conv_id = w.conv_id AND r.turn >= w.turn)
SELECT conv_id, turn, CASE WHEN version IS NULL THEN 'none' WHEN turn - version > 3 THEN 'old' ELSE 'used' END AS state, CASE WHEN turn - version <= 3 THEN version END AS version, CASE WHEN turn - version <= 3 THEN size END AS size FROM m""",
)
def mem_store(t: Tables) -> DataFrame:
    """Answers write the session's memory, each seventh for another owner and so refused; a question reads what was last written, if not too old."""
    c = t("conversations")
    owned = c.where("role = 'assistant'").withColumn("owner", F.when(F.col("turn") % 7 == 3, F.col("conv_id") + 1).otherwise(F.col("conv_id")))
    writes = owned.where("owner = conv_id").select("conv_id", "turn", F.col("turn").alias("order"), F.length("text").cast("long").alias("size"))
    met = Z.as_of(c.where("role = 'user'").select("conv_id", "turn"), writes, ["conv_id"], "turn", "order", ["size"], F.floor(F.col("turn") / 64))
    age = F.col("turn") - F.col("last.turn")
    state = F.when(F.col("last").isNull(), "none").when(age > 3, "old").otherwise("used")
    return met.select("conv_id", "turn", state.alias("state"), F.when(age <= 3, F.col("last.turn")).alias("version"), F.when(age <= 3, F.col("last.size")).alias("size"))


@query("chat", "SELECT conv_id, string_agg(role || '> ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def chat(t: Tables) -> DataFrame:
    line = F.concat(F.col("role"), F.lit("> "), F.col("text"))
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("l"))  # turns of one session
    return g.select("conv_id", F.array_join(F.transform("l", lambda s: s["x"]), "\n").alias("transcript"))


@query("query_full", f"SELECT query_id, reason, CASE WHEN reason = 'none' THEN answer ELSE '' END AS answer FROM ({SQL['ans_extractive']}) JOIN ({SQL['abstain']}) USING (query_id)")
def query_full(t: Tables) -> DataFrame:
    """A whole question: retrieval, abstention and the extractive answer, which is empty where there is a reason for none."""
    said = F.when(F.col("reason") == "none", F.col("answer")).otherwise(F.lit(""))
    return ans_extractive(t).join(abstain(t), "query_id").select("query_id", "reason", said.alias("answer"))


@query("text_asset", "SELECT page_id, concat_ws(' ', CASE WHEN lower(url) IN ('', 'page') THEN NULL ELSE url END, substr(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1, 200)) AS text FROM pages")
def text_asset(t: Tables) -> DataFrame:
    label = F.when(~F.lower("url").isin("", "page"), F.col("url"))
    return t("pages").select("page_id", F.concat_ws(" ", label, F.substring(F.regexp_replace("html", "<[^>]*>", " "), 1, 200)).alias("text"))


@query("text_sensor", "SELECT user_id, event_type, event_type || ': ' || string_agg(printf('%.2f', value), ', ' ORDER BY rn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 8 GROUP BY 1, 2")
def text_sensor(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    top = t("events").withColumn("rn", F.row_number().over(w)).where("rn <= 8")
    points = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.format_string("%.2f", "value").alias("v")))), lambda x: x["v"])  # eight at most
    return top.groupBy("user_id", "event_type").agg(points.alias("p")).select("user_id", "event_type", F.concat(F.col("event_type"), F.lit(": "), F.array_join("p", ", ")).alias("text"))


@query("text_label", r"SELECT page_id, substr(regexp_replace(regexp_replace(url, '^https?://', ''), '\s+', ' ', 'g'), 1, 120) AS label FROM pages")
def text_label(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.substring(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "\\s+", " "), 1, 120).alias("label"))
