"""Registered queries: vectors, lexical search and hybrid ranking; `benchmark` texts are the queries over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.operators import answers as A
from stratalode.operators import linking as L
from stratalode.operators import retrieval as R
from stratalode.operators import state as Z
from stratalode.plans.catalog import Tables, query

TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 3)"
VECTOR = "list_transform(range(16), lambda i: CAST('0x' || substr(sha256({0}), 2 * i + 1, 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1)"
FIELDS = {"source": ("prefix", 28.0), "lang": ("contains", 20.0), "text": ("contains", 8.0)}
_Q = f"q AS (SELECT item_id AS query_id, text AS q, {TERMS.format('text')} AS terms FROM benchmark)"


def lex_sql(name: str, fields: dict, table: str = "documents", key: str = "doc_id", limit: int = R.LIMIT) -> str:
    score = " + ".join(f"CASE WHEN {'starts_with' if kind == 'prefix' else 'contains'}(lower(coalesce({c}, '')), term) THEN {weight}::DOUBLE ELSE 0.0::DOUBLE END" for c, (kind, weight) in fields.items())
    return f"""{name}_t AS (SELECT query_id, term, count(*) AS c FROM (SELECT query_id, unnest(terms[1:8]) AS term FROM q) GROUP BY 1, 2),
{name}_s AS (SELECT query_id, {key} AS doc_id, sum(c * ({score})) AS lexical_score FROM {name}_t, {table} GROUP BY 1, 2 HAVING sum(c * ({score})) > 0),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id) AS INTEGER) AS lexical_rank FROM {name}_s) WHERE lexical_rank <= {limit})"""


DENSE = f"""dense AS (SELECT * FROM (SELECT query_id, doc_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS INTEGER) AS dense_rank
  FROM (SELECT query_id, doc_id, list_distance(a.v, b.v) ** 2 AS distance FROM (SELECT query_id, {VECTOR.format('q')} AS v FROM q) a, (SELECT doc_id, {VECTOR.format('text')} AS v FROM documents WHERE text IS NOT NULL) b)) WHERE dense_rank <= {R.LIMIT})"""
HYBRID = f"""WITH {_Q}, {lex_sql('lex', FIELDS)}, {DENSE},
hybrid AS (SELECT query_id, doc_id, distance, least(dense_rank, lexical_rank) AS rank, coalesce(lexical_score, 0.0) AS lexical_score,
  concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END) AS match_source FROM dense FULL OUTER JOIN lex USING (query_id, doc_id))"""


def _overlap(q: str, t: str) -> str:
    return f"(CASE WHEN len({q}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_distinct(list_intersect({q}, {t}))) AS DOUBLE) / len(list_distinct({q})) END)"


RERANK = f"""{HYBRID}, m AS (SELECT h.*, q.q, q.terms, d.text, d.lang AS section, d.source AS title FROM hybrid h JOIN q USING (query_id) JOIN documents d USING (doc_id)),
s AS (SELECT *, round(coalesce(greatest(0.0::DOUBLE, round(1.0 - distance, 6)), 0.0) * {R.DISTANCE} + {_overlap('terms', TERMS.format("section || ' ' || text"))} * {R.LEXICAL}::DOUBLE
  + {_overlap('terms', TERMS.format('section'))} * {R.SECTION}::DOUBLE + {_overlap('terms', TERMS.format('title'))} * {R.TITLE}::DOUBLE
  + CASE WHEN contains(lower(concat_ws(' ', title, section, text)), lower(q)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * {R.PHRASE}::DOUBLE, 6) AS rerank_score FROM m),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank DESC, doc_id) AS INTEGER) AS new_rank FROM s)"""


def queries(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def hybrid(t: Tables) -> DataFrame:
    docs = t("documents").where("text IS NOT NULL")
    dense = R.nearest(docs.select("doc_id", R.dummy_vector(F.col("text")).alias("vec")), queries(t).select("query_id", R.dummy_vector(F.col("q")).alias("vec")), R.LIMIT)
    return R.merge(dense, R.lexical(docs, queries(t), FIELDS))


def ranked(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "text", F.col("lang").alias("section"), F.col("source").alias("title"))
    return R.rerank(hybrid(t).join(d, "doc_id").join(queries(t), "query_id"))


@query("emb_dummy", f"SELECT doc_id, list_transform({VECTOR.format('text')}, lambda x: round(x, 6)) AS vec FROM documents")
def emb_dummy(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.transform(R.dummy_vector(F.col("text")), lambda x: F.round(x, 6)).alias("vec"))


@query("emb_cache", "SELECT user_id % 3 AS tenant, sha256(lower(trim(event_type || ' ' || user_id))) AS key, 'dummy:16' AS identity, count(*) - 1 AS hits, max(ts) AS saved_at, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS AS fresh FROM events GROUP BY 1, 2")
def emb_cache(t: Tables) -> DataFrame:
    """Events as questions: a tenant's cached vectors of one model, how often each was used again, and whether it's too old."""
    key = F.sha2(F.lower(F.trim(F.concat_ws(" ", "event_type", "user_id"))), 256)
    g = t("events").groupBy((F.col("user_id") % 3).alias("tenant"), key.alias("key"), F.lit("dummy:16").alias("identity")).agg((F.count("*") - 1).alias("hits"), F.max("ts").alias("saved_at"))
    since = t("events").agg(F.max("ts") - F.expr("INTERVAL 30 DAYS")).scalar()
    return g.withColumn("fresh", F.col("saved_at") >= since)


@query("vec_score", f"{HYBRID} SELECT query_id, doc_id, greatest(0.0::DOUBLE, round(1.0 - distance, 6)) AS score FROM dense")
def vec_score(t: Tables) -> DataFrame:
    docs = t("documents").where("text IS NOT NULL").select("doc_id", R.dummy_vector(F.col("text")).alias("vec"))
    dense = R.nearest(docs, queries(t).select("query_id", R.dummy_vector(F.col("q")).alias("vec")), R.LIMIT)
    return dense.select("query_id", "doc_id", R.distance_score(F.col("distance")).alias("score"))


@query("vec_metadata", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions, label, 'ready' AS publish_state FROM embeddings")
def vec_metadata(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", F.size("embedding").alias("dimensions"), "label", F.lit("ready").alias("publish_state"))


@query("vec_list_count", "SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY label")
def vec_list_count(t: Tables) -> DataFrame:
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("vec_parity", "SELECT doc_id AS id, 'missing_vector' AS problem FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'missing_document' FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels WHERE quality = 1)")
def vec_parity(t: Tables) -> DataFrame:
    a, b = t("labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct(), t("embeddings").select(F.col("vec_id").cast("long").alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("problem", F.lit("missing_vector")).unionByName(b.join(a, "id", "left_anti").withColumn("problem", F.lit("missing_document")))


_NORM_Q = r"trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g'))"


@query("q_normalize", f"SELECT conv_id, turn, {_NORM_Q} AS q, substr({_NORM_Q}, 1, 80) AS title FROM conversations WHERE role = 'user'")
def q_normalize(t: Tables) -> DataFrame:
    q = F.trim(F.regexp_replace(F.regexp_replace("text", "\\x00", " "), "\\s+", " "))
    return t("conversations").where("role = 'user'").select("conv_id", "turn", q.alias("q"), F.substring(q, 1, 80).alias("title"))


@query("q_terms", f"SELECT item_id, {TERMS.format('text')} AS terms FROM benchmark")
def q_terms(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", R.terms(F.col("text")).alias("terms"))


_DISTINCT = "list_transform(list_filter(list_transform(range(1, len(terms) + 1), lambda i: {'t': terms[i], 'f': list_position(terms, terms[i]) = i}), lambda s: s.f), lambda s: s.t)"


@query("q_pattern", f"WITH {_Q} SELECT query_id, CASE WHEN len(terms) = 0 THEN 'empty-query' ELSE array_to_string(({_DISTINCT})[1:12], '|') END AS pattern FROM q")
def q_pattern(t: Tables) -> DataFrame:
    p = F.array_join(F.slice(F.array_distinct(R.terms(F.col("q"))), 1, 12), "|")
    return queries(t).select("query_id", F.when(p == "", "empty-query").otherwise(p).alias("pattern"))


#: Question types by what the lower-case question holds or starts with; the first that fits wins.
TYPES = (
    ("visual_lookup", ("image", "visual", "diagram", "figure", "illustration", "scanned", "scan"), ()),
    ("definition", (), ("what is", "who is", "define")),
    ("source_lookup", (), ("where ", "when ")),
    ("procedure", ("how do", "how can"), ("how ",)),
    ("comparison", ("difference", "versus", "advantages", "limitations"), ("compare",)),
    ("explanation", ("explain",), ("why ",)),
)
_CLASS = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(x, '{p}')" for p in has] + [f"starts_with(x, '{p}')" for p in starts]) + f" THEN '{name}'" for name, has, starts in TYPES) + " ELSE 'fact' END"


def question_type(c):
    out = F.lit("fact")
    for name, has, starts in reversed(TYPES):
        test = F.lit(False)
        for p in has:
            test = test | F.contains(c, F.lit(p))
        for p in starts:
            test = test | F.startswith(c, F.lit(p))
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


@query("q_classify", f"SELECT conv_id, turn, {_CLASS} AS question_type FROM (SELECT *, lower(text) AS x FROM conversations WHERE role = 'user')")
def q_classify(t: Tables) -> DataFrame:
    return t("conversations").where("role = 'user'").select("conv_id", "turn", question_type(F.lower("text")).alias("question_type"))


TOP_K = {"definition": 6, "fact": 8, "source_lookup": 7, "procedure": 10, "comparison": 10, "explanation": 9, "visual_lookup": 6}
_TOPK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOP_K.items()) + " ELSE 8 END"


def _typed(t: Tables) -> DataFrame:
    return t("conversations").where("role = 'user'").select("conv_id", "turn", "text", question_type(F.lower("text")).alias("kind"))


_TYPED = f"ty AS (SELECT conv_id, turn, text, {_CLASS} AS kind FROM (SELECT *, lower(text) AS x FROM conversations WHERE role = 'user'))"


def _top_k():
    out = F.lit(8)
    for k, v in TOP_K.items():
        out = F.when(F.col("kind") == k, F.lit(v)).otherwise(out)
    return out


_ROUTED = "conv_id % 11 <> 0 AS enabled, CASE WHEN conv_id % 7 = 0 THEN 'local' ELSE 'remote' END AS provider, conv_id % 5 <> 0 AS has_key, turn % 6 = 4 AS failed, CASE WHEN conv_id % 2 = 0 THEN 'comparison' END AS router_kind, (conv_id * 7) % 20 - 3 AS router_top_k, ((conv_id * 17 + turn) % 100) / 100.0 AS confidence"


@query("q_route", f"""WITH {_TYPED}, r AS (SELECT *, {_ROUTED} FROM ty), w AS (SELECT *, CASE WHEN NOT enabled THEN 'fallback:disabled' WHEN provider <> 'remote' THEN 'fallback:provider_disabled' WHEN NOT has_key THEN 'fallback:no_api_key' WHEN failed THEN 'fallback:error' WHEN confidence < 0.55 THEN 'fallback:low_confidence' ELSE 'router' END AS source FROM r)
SELECT conv_id, turn, source, CASE WHEN source = 'router' THEN coalesce(router_kind, kind) ELSE kind END AS question_type, CAST(CASE WHEN source = 'router' THEN greatest(1, least(12, router_top_k)) ELSE {_TOPK} END AS INTEGER) AS top_k FROM w""")
def q_route(t: Tables) -> DataFrame:
    """What a router said comes from the ids of conversations and turns, since the tables hold no router's answers."""
    return A.route(_typed(t).select("*", *map(F.expr, _ROUTED.split(", "))), _top_k()).select("conv_id", "turn", "source", "question_type", "top_k")


_ROUTES = f"""ev AS (SELECT event_id, ts AS moment, user_id % 3 AS tenant, event_type || ':' || (user_id % 11) AS pattern, event_id % 4 = 0 AS saved, 1 + user_id % 10 AS keywords, CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'router-1' END AS identity,
  CASE WHEN event_id % 17 = 0 THEN 'nonsense' ELSE (['{"', '".join(n for n, *_ in TYPES)}'])[CAST(event_id % {len(TYPES)} AS INTEGER) + 1] END AS question_type, CASE WHEN event_id % 19 = 0 THEN 'many' ELSE CAST(event_id % 15 AS VARCHAR) END AS top_k, CASE WHEN event_id % 23 = 0 THEN 'sure' ELSE CAST(event_id % 10 AS VARCHAR) END AS confidence, event_id % 5 AS approved, event_id % 7 AS rejected FROM events)"""


@query(
    "q_route_cache",
    f"""WITH {_ROUTES}, en AS (SELECT * FROM ev WHERE saved QUALIFY row_number() OVER (PARTITION BY tenant, pattern, moment ORDER BY event_id DESC) = 1),
m AS (SELECT q.event_id, q.keywords, q.moment, e.* EXCLUDE (event_id, keywords, moment), e.moment AS since FROM (SELECT * FROM ev WHERE NOT saved) q ASOF LEFT JOIN en e ON q.tenant = e.tenant AND q.pattern = e.pattern AND q.moment >= e.moment),
r AS (SELECT *, CASE WHEN keywords < 2 THEN 'router:few_keywords' WHEN since IS NULL THEN 'router:miss' WHEN epoch_us(moment) - epoch_us(since) > 86400000000 THEN 'router:expired' WHEN identity <> 'router-1' THEN 'router:other_identity' WHEN rejected > approved THEN 'router:rejected' WHEN question_type = 'nonsense' OR TRY_CAST(top_k AS INTEGER) IS NULL OR TRY_CAST(confidence AS DOUBLE) IS NULL THEN 'router:invalid' ELSE 'router_cache' END AS source FROM m)
SELECT event_id, source, CASE WHEN source = 'router_cache' THEN question_type END AS question_type, CASE WHEN source = 'router_cache' THEN greatest(1, least({A.MOST_RESULTS}, CAST(top_k AS INTEGER))) END AS top_k, CASE WHEN source = 'router_cache' THEN least(1.0, CAST(confidence AS DOUBLE)) END AS confidence FROM r""",
)
def q_route_cache(t: Tables) -> DataFrame:
    """Every fourth event saves a route, the others ask; the last route saved before is used or refused, and the reason told."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*(F.lit(name) for name, *_ in TYPES)), (n % len(TYPES) + 1).cast("int"))
    e = t("events").select("event_id", F.col("ts").alias("at"), (F.col("user_id") % 3).alias("tenant"), F.concat_ws(":", "event_type", F.col("user_id") % 11).alias("pattern"), (F.col("user_id") % 10 + 1).alias("keywords"))
    odd = lambda every, value, usual: F.when(n % every == 0, value).otherwise(usual)
    saved = e.where(n % 4 == 0).select("tenant", "pattern", "at", n.alias("order"), odd(13, "other", "router-1").alias("identity"), odd(17, "nonsense", kind).alias("question_type"), odd(19, "many", (n % 15).cast("string")).alias("top_k"), odd(23, "sure", (n % 10).cast("string")).alias("confidence"), (n % 5).alias("approved"), (n % 7).alias("rejected"))
    found = Z.cached_routes(e.where(n % 4 != 0), saved, F.lit("router-1"), tuple(name for name, *_ in TYPES), 86_400, A.MOST_RESULTS)
    return found.select("event_id", "source", "question_type", "top_k", "confidence")


@query("q_topk", f"WITH {_TYPED} SELECT conv_id, turn, CAST(least(12, {_TOPK}) AS INTEGER) AS top_k FROM ty")
def q_topk(t: Tables) -> DataFrame:
    return _typed(t).select("conv_id", "turn", F.least(F.lit(12), _top_k()).alias("top_k"))


def _plan_sql(kind: str, k: str, visual: str, spread: str) -> str:
    """SQL columns of R.plan."""
    seen, lookup, wide = f"({visual} OR {kind} = 'visual_lookup')", f"{kind} IN ('definition', 'fact', 'source_lookup')", f"{kind} IN ('procedure', 'explanation')"
    told = f"CASE WHEN lower(trim({spread})) IN ('single', 'few', 'broad') THEN lower(trim({spread})) WHEN {kind} IN ('comparison', 'fact', 'explanation', 'procedure') THEN 'few' ELSE 'single' END"
    return f"""CASE WHEN {kind} = 'visual_lookup' THEN 'multimodal_focus' WHEN {lookup} THEN CASE WHEN {seen} THEN 'hybrid_visual_support' ELSE 'hybrid_kg_support' END WHEN {kind} = 'comparison' THEN 'hybrid_compare' WHEN {seen} THEN 'neighbor_visual_expansion' ELSE 'neighbor_expansion' END AS mode,
CAST(least({R.LIMIT}, CASE WHEN {seen} AND ({lookup} OR {wide}) THEN greatest(3 * {k}, {k} + 6) WHEN {wide} THEN greatest(2 * {k}, {k} + 3) ELSE greatest(2 * {k}, {k} + 4) END) AS INTEGER) AS search_k,
CAST(least({R.MOST_CONTEXT}, greatest({k}, CASE {kind} WHEN 'visual_lookup' THEN 3 WHEN 'comparison' THEN 5 ELSE 4 END)) AS INTEGER) AS select_k, {kind} IN ('comparison', 'procedure', 'explanation') AS expand, {kind} <> 'visual_lookup' AS kg, {kind} IN ('comparison', 'explanation', 'procedure') AS graph, {seen} AS assets,
CASE WHEN {kind} IN ('visual_lookup', 'comparison') AND {told} = 'single' THEN 'few' ELSE {told} END AS spread"""


_HINT = "CASE turn % 7 WHEN 0 THEN ' Broad' WHEN 2 THEN 'single' WHEN 4 THEN 'odd' END"


@query("q_plan", f"WITH {_TYPED}, tk AS (SELECT *, {_TOPK} AS k, {_HINT} AS hint FROM ty) SELECT conv_id, turn, {_plan_sql('kind', 'k', 'conv_id % 3 = 0', 'hint')} FROM tk")
def q_plan(t: Tables) -> DataFrame:
    """The plan of every user turn; that pictures are needed, and the router's spread, come from the ids."""
    a = _typed(t).withColumns({"k": _top_k(), "hint": F.expr(_HINT)})
    return a.select("conv_id", "turn", *(c.alias(n) for n, c in R.plan(F.col("kind"), F.col("k"), F.col("conv_id") % 3 == 0, F.col("hint")).items()))


#: Questions have a kind by their number, so that all are met; every thirteenth one's vector fails.
_KINDS = tuple(name for name, *_ in TYPES) + ("fact",)
_PLANNED = f"""pk AS (SELECT query_id, (['{"', '".join(_KINDS)}'])[CAST(query_id % {len(_KINDS)} AS INTEGER) + 1] AS kind FROM q), pl AS (SELECT query_id, kind, {_plan_sql('kind', f"({_TOPK})", 'query_id % 4 = 0', "CASE WHEN query_id % 6 = 0 THEN 'broad' END")} FROM pk),
lexp AS (SELECT lex.* FROM lex JOIN pl USING (query_id) WHERE lexical_rank <= search_k), densep AS (SELECT dense.* FROM dense JOIN pl USING (query_id) WHERE dense_rank <= search_k AND query_id % 13 <> 5)"""
#: The search and its ranking within each question's plan, ending in `ranked` as RERANK does.
PLANNED = RERANK.replace(DENSE + ",", f"{DENSE}, {_PLANNED},", 1).replace("FROM dense FULL OUTER JOIN lex USING", "FROM densep AS dense FULL OUTER JOIN lexp AS lex USING", 1)


def plans(t: Tables) -> DataFrame:
    """(query_id, kind, ...): the plan of every question."""
    a = queries(t).select("query_id", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("query_id") % len(_KINDS) + 1).cast("int")).alias("kind"))
    made = R.plan(F.col("kind"), _top_k(), F.col("query_id") % 4 == 0, F.when(F.col("query_id") % 6 == 0, "broad"))
    return a.select("query_id", "kind", *(c.alias(n) for n, c in made.items()))


def planned(t: Tables) -> DataFrame:
    """ranked() within each question's plan."""
    docs = t("documents").where("text IS NOT NULL")
    asked = queries(t)
    sound = asked.where("query_id % 13 <> 5").select("query_id", R.dummy_vector(F.col("q")).alias("vec"))
    dense = R.nearest(docs.select("doc_id", R.dummy_vector(F.col("text")).alias("vec")), sound, R.LIMIT)
    both = R.within_plan(dense, R.lexical(docs, asked, FIELDS), plans(t))
    d = t("documents").select("doc_id", "text", F.col("lang").alias("section"), F.col("source").alias("title"))
    return R.rerank(both.join(d, "doc_id").join(asked, "query_id"))


@query("lex_chunks", f"WITH {_Q}, {lex_sql('lex', FIELDS)} SELECT query_id, doc_id, lexical_score, lexical_rank FROM lex")
def lex_chunks(t: Tables) -> DataFrame:
    return R.lexical(t("documents"), queries(t), FIELDS)


def _lex(name: str, table: str, key: str, fields: dict, limit: int = 10) -> None:
    @query(name, f"WITH {_Q}, {lex_sql('lex', fields, table, key, limit)} SELECT query_id, doc_id, lexical_score, lexical_rank FROM lex")
    def run(t: Tables) -> DataFrame:
        return R.lexical(t(table).withColumn("doc_id", F.expr(key)), queries(t), fields, limit)


_lex("lex_assets", "pages", "page_id", {"url": ("contains", 24.0), "html": ("contains", 10.0)})
_lex("lex_doc_syn", "documents", "doc_id", {"source": ("prefix", 24.0), "text": ("contains", 9.0)})
_lex("lex_sec_syn", "conversations", "(conv_id * 100000 + turn)", {"role": ("prefix", 24.0), "text": ("contains", 9.0)})


@query("hyb_merge", f"{HYBRID} SELECT query_id, doc_id, round(distance, 6) AS distance, rank, lexical_score, match_source FROM hybrid")
def hyb_merge(t: Tables) -> DataFrame:
    return hybrid(t).withColumn("distance", F.round("distance", 6))


@query("lex_overlap", f"{HYBRID} SELECT h.query_id, h.doc_id, round({_overlap('q.terms', TERMS.format('d.text'))}, 6) AS overlap FROM hybrid h JOIN q USING (query_id) JOIN documents d USING (doc_id)")
def lex_overlap(t: Tables) -> DataFrame:
    m = hybrid(t).join(t("documents").select("doc_id", "text"), "doc_id").join(queries(t), "query_id")
    return m.select("query_id", "doc_id", F.round(R.overlap(R.terms(F.col("q")), R.terms(F.col("text"))), 6).alias("overlap"))


@query("jaccard", f"{HYBRID} SELECT query_id, doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE CAST(len(list_distinct(list_intersect(a, b))) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (SELECT h.query_id, h.doc_id, q.terms AS a, {TERMS.format('d.text')} AS b FROM hybrid h JOIN q USING (query_id) JOIN documents d USING (doc_id))")
def jaccard(t: Tables) -> DataFrame:
    m = hybrid(t).join(t("documents").select("doc_id", "text"), "doc_id").join(queries(t), "query_id")
    return m.select("query_id", "doc_id", F.round(R.jaccard(R.terms(F.col("q")), R.terms(F.col("text"))), 6).alias("jaccard"))


@query("rerank_chunks", f"{RERANK} SELECT query_id, doc_id, rerank_score, rank, new_rank FROM ranked")
def rerank_chunks(t: Tables) -> DataFrame:
    return ranked(t).select("query_id", "doc_id", "rerank_score", "rank", "new_rank")


@query("retrieve", f"{PLANNED} SELECT query_id, doc_id, match_source, rerank_score, new_rank FROM ranked JOIN pl USING (query_id) WHERE new_rank <= select_k")
def retrieve(t: Tables) -> DataFrame:
    """Search and ranking by plan: how deep each question searches and how much it keeps; one whose vector fails has its words."""
    most = plans(t).select("query_id", "select_k")
    return planned(t).join(most, "query_id").where(F.col("new_rank") <= F.col("select_k")).select("query_id", "doc_id", "match_source", "rerank_score", "new_rank")


@query("mmr_chunks")
def mmr_chunks(t: Tables) -> DataFrame:
    return R.diversify(ranked(t))


@query("mmr_assets")
def mmr_assets(t: Tables) -> DataFrame:
    """Documents stand for assets: the source for their document, the language for their type; there are no pages."""
    return R.diversify(ranked(t), k=6, penalty=0.18, signature=["title", "section"])


def _allowed_sql(source: str, plan: str) -> str:
    """CTE few (query_id, document, total, nth) of R.allowed over source, with plan (query_id, kind, spread)."""
    ahead = "coalesce(s1 >= {0}::DOUBLE * s2, true)"
    return f"""held AS (SELECT query_id, document, round(sum(greatest({R.LEAST_DOCUMENT_SCORE}::DOUBLE, score)), 6) AS total FROM {source} GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total DESC, document) AS INTEGER) AS nth, count(*) OVER (PARTITION BY query_id) AS n FROM held),
led AS (SELECT *, max(total) FILTER (nth = 1) OVER (PARTITION BY query_id) AS s1, max(total) FILTER (nth = 2) OVER (PARTITION BY query_id) AS s2 FROM placed),
few AS (SELECT query_id, document, total, nth FROM led JOIN {plan} AS pq USING (query_id) WHERE nth <= CASE WHEN pq.spread = 'broad' THEN {R.SPREAD['broad']} WHEN pq.kind = 'visual_lookup' THEN CASE WHEN {ahead.format(R.VISUAL_LEAD)} THEN 1 ELSE 2 END WHEN n = 1 THEN 1 WHEN pq.spread = 'single' THEN {R.SPREAD['single']} WHEN pq.spread = 'few' THEN {R.SPREAD['few']}
  WHEN pq.kind IN ('definition', 'source_lookup') THEN CASE WHEN {ahead.format(R.LOOKUP_LEAD)} THEN 1 ELSE 2 END WHEN pq.kind IN ('fact', 'explanation', 'procedure') AND n >= 3 THEN 3 ELSE 2 END)"""


@query("doc_allow", f"{PLANNED}, sc AS (SELECT query_id, title AS document, rerank_score AS score FROM ranked), po AS (SELECT query_id, kind, CASE WHEN query_id % 5 < 2 THEN 'any' ELSE spread END AS spread FROM pl), {_allowed_sql('sc', 'po')} SELECT query_id, document AS title, total AS score, nth AS place FROM few")
def doc_allow(t: Tables) -> DataFrame:
    """The documents (sources) that each question's context may come from; two in five questions have a spread that no rule knows."""
    told = plans(t).select("query_id", "kind", F.when(F.col("query_id") % 5 < 2, "any").otherwise(F.col("spread")).alias("spread"))
    found = R.allowed(planned(t).select("query_id", F.col("title").alias("document"), F.col("rerank_score").alias("score")), told)
    return found.select("query_id", F.col("document").alias("title"), F.col("total").alias("score"), "place")


_FEW_PLAN = "(SELECT DISTINCT query_id, 'fact' AS kind, 'few' AS spread FROM {0})"


def _fold(source: str, k: int, signature: int, plan: str | None = None) -> str:
    """SQL of R.compress over source (query_id, doc_id, document, score, text): candidates by place, one after another."""
    like = "len(list_intersect(words, o)) >= {0}::DOUBLE * greatest(1, len(list_distinct(list_concat(words, o))))".format(R.DIVERSITY)
    return f"""{_allowed_sql(source, plan or _FEW_PLAN.format(source))},
cand AS (SELECT query_id, doc_id, sig, list_distinct({TERMS.format("sig")}) AS words, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n
  FROM (SELECT query_id, doc_id, score, regexp_replace(lower(text), '\\s+', ' ', 'g')[1:{signature}] AS sig FROM {source} JOIN few USING (query_id, document))),
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS sigs, CAST([] AS VARCHAR[][]) AS kept, CAST([] AS BIGINT[]) AS docs FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL SELECT query_id, n, CASE WHEN ok THEN list_append(sigs, sig) ELSE sigs END, CASE WHEN ok THEN list_append(kept, words) ELSE kept END, CASE WHEN ok THEN list_append(docs, doc_id) ELSE docs END
  FROM (SELECT f.query_id, c.n, f.sigs, f.kept, f.docs, c.sig, c.words, c.doc_id, len(f.docs) < {k} AND NOT list_contains(f.sigs, c.sig) AND len(list_filter(f.kept, lambda o: {like.replace("words", "c.words")})) = 0 AS ok FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.n = f.n + 1)),
last AS (SELECT query_id, arg_max(docs, n) AS docs FROM fold GROUP BY 1)
SELECT query_id, unnest(docs) AS doc_id, CAST(generate_subscripts(docs, 1) AS INTEGER) AS place FROM last"""


_BONUS = "least(0.18::DOUBLE, 0.05::DOUBLE * k.n)"
_RECURSIVE = "WITH RECURSIVE" + RERANK.removeprefix("WITH")
_CHUNK_SCORES = f"""{"WITH RECURSIVE" + PLANNED.removeprefix("WITH")}, k AS (SELECT doc_id, quality + 2 * toxic AS n FROM labels),
scored AS (SELECT r.query_id, r.doc_id, r.title AS document, r.text, round(r.rerank_score + {_overlap("r.terms", TERMS.format("r.text"))} * {R.LEXICAL}::DOUBLE + {_overlap("r.terms", TERMS.format("r.section"))} * {R.SECTION}::DOUBLE
  + {_overlap("r.terms", TERMS.format("r.title"))} * {R.TITLE}::DOUBLE + coalesce({_BONUS}, 0.0), 6) AS score
  FROM ranked r LEFT JOIN k USING (doc_id) WHERE length(trim(r.text)) > 0 AND (length(trim(r.text)) >= 45 OR {_overlap("r.terms", TERMS.format("r.text"))} > 0))"""


@query("compress_chunks", f"{_CHUNK_SCORES}, {_fold('scored', 10, 280, 'pl')}")
def compress_chunks(t: Tables) -> DataFrame:
    """The labels' sum stands for a chunk's count of assertions, its source for the document."""
    counts = t("labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("n"))
    q, size = R.terms(F.col("q")), F.length(F.trim("text"))
    lexical = R.overlap(q, R.terms(F.col("text")))
    bonus = F.coalesce(F.least(F.lit(0.18), 0.05 * F.col("n")), F.lit(0.0))
    score = F.col("rerank_score") + lexical * R.LEXICAL + R.overlap(q, R.terms(F.col("section"))) * R.SECTION + R.overlap(q, R.terms(F.col("title"))) * R.TITLE + bonus
    rows = planned(t).where((size >= 45) | (size > 0) & (lexical > 0)).join(counts, "doc_id", "left")
    return R.compress(rows.select("query_id", "doc_id", F.col("title").alias("document"), F.round(score, 6).alias("score"), "text"), 10, 280, plans(t))


_ASSET = "CASE WHEN doc_id % 3 = 0 THEN 'page_image' ELSE 'figure' END"
_either = lambda c, words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
_SHOWN = "(title || ' ' || text)"
_ASSETS = f"""{_RECURSIVE.split(", s AS (SELECT")[0].split(chr(10) + "s AS (SELECT")[0].rstrip().rstrip(",")}, a AS (SELECT *, {_ASSET} AS kind, CAST(doc_id % 500 AS VARCHAR) AS page FROM m),
b AS (SELECT *, round(coalesce(greatest(0.0::DOUBLE, round(1.0 - distance, 6)), 0.0) * {R.DISTANCE} + {_overlap("terms", TERMS.format(_SHOWN))} * {R.LEXICAL}::DOUBLE + {_overlap("terms", TERMS.format("title"))} * {R.TITLE}::DOUBLE
  + CASE WHEN contains(lower({_SHOWN}), lower(q)) THEN {R.PHRASE}::DOUBLE ELSE 0.0::DOUBLE END + {_overlap("terms", "[section]")} * {R.ONTOLOGY}::DOUBLE + CASE WHEN kind = 'page_image' THEN {R.PAGE_IMAGE}::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN list_contains(terms, page) THEN {R.PAGE_NUMBER}::DOUBLE ELSE 0.0::DOUBLE END, 6) AS base FROM a),
assets AS (SELECT *, round(base + CASE WHEN {_either("q", R.VISUAL_QUERY)} THEN CASE WHEN kind = 'page_image' THEN {R.PAGE_IMAGE}::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_either(_SHOWN, R.VISUAL_TEXT)} THEN {R.VISUAL_TEXT_BONUS}::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN length(trim(text)) >= {R.VISUAL_LENGTH} THEN {R.VISUAL_LENGTH_BONUS}::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END, 6) AS rerank_score FROM b)"""


def assets(t: Tables) -> DataFrame:
    """Matches as assets: the source for label and document, every third one a page image, the language for important terms."""
    d = t("documents").select("doc_id", "text", F.col("source").alias("label"), F.when(F.col("doc_id") % 3 == 0, "page_image").otherwise("figure").alias("kind"), (F.col("doc_id") % 500).cast("string").alias("page"), F.array("lang").alias("terms"))
    return R.rerank_assets(hybrid(t).join(d, "doc_id").join(queries(t), "query_id"))


@query("rerank_assets", f"{_ASSETS} SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank DESC, doc_id) AS INTEGER) AS new_rank FROM assets")
def rerank_assets(t: Tables) -> DataFrame:
    return assets(t).select("query_id", "doc_id", "rerank_score", "new_rank")


_SUPPORT = "least(0.28::DOUBLE, 0.1::DOUBLE * (n_chars % 4))"


@query("compress_assets", f"{_ASSETS}, scored AS (SELECT query_id, a.doc_id, title AS document, a.text, round(rerank_score + {_SUPPORT}, 6) AS score FROM assets a JOIN documents USING (doc_id) WHERE length(trim(a.text)) > 0), {_fold('scored', 6, 220)}")
def compress_assets(t: Tables) -> DataFrame:
    """The rerank score holds the asset's own bonuses; link support is made from the texts' lengths."""
    support = t("documents").select("doc_id", F.least(F.lit(0.28), 0.1 * (F.col("n_chars") % 4)).alias("support"))
    rows = assets(t).where(F.length(F.trim("text")) > 0).join(support, "doc_id")
    return R.compress(rows.select("query_id", "doc_id", F.col("label").alias("document"), F.round(F.col("rerank_score") + F.col("support"), 6).alias("score"), "text"), 6, 220)


@query("retrieve_inspect", f"{RERANK} SELECT query_id, count(*) AS candidates, count(*) FILTER (match_source = 'dense') AS dense_only, count(*) FILTER (match_source = 'lexical') AS lexical_only, max(rerank_score) AS best, arg_min(doc_id, new_rank) AS top_doc FROM ranked GROUP BY query_id")
def retrieve_inspect(t: Tables) -> DataFrame:
    m = F.col("match_source")
    return ranked(t).groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(m == "dense").alias("dense_only"), F.count_if(m == "lexical").alias("lexical_only"), F.max("rerank_score").alias("best"), F.min_by("doc_id", "new_rank").alias("top_doc"))


@query("neighbors", f"""{RERANK}, base AS (SELECT query_id, doc_id, new_rank FROM ranked WHERE new_rank <= {R.SELECTED}), l AS (SELECT query_id, doc_id - 1 AS doc_id, 2 * new_rank AS at_ FROM base WHERE new_rank <= 3 UNION ALL SELECT query_id, doc_id + 1, 2 * new_rank + 1 FROM base WHERE new_rank <= 3),
f AS (SELECT query_id, doc_id, min(at_) AS at_ FROM l ANTI JOIN base USING (query_id, doc_id) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY at_) AS INTEGER) AS place FROM f QUALIFY place <= 6""")
def neighbors(t: Tables) -> DataFrame:
    """Documents as chunks, linked to those of the ids before and after."""
    base = ranked(t).where(F.col("new_rank") <= R.SELECTED).select("query_id", F.col("doc_id").alias("chunk_id"), "new_rank")
    links = t("documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") - 1).alias("before"), (F.col("doc_id") + 1).alias("after"))
    return R.neighbours(base, links).join(t("documents").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi").transform(lambda d: R.first_places(d, 6)).select("query_id", F.col("chunk_id").alias("doc_id"), "place")


_FORMS = "CASE query_id % 3 WHEN 0 THEN 'how does it work: ' WHEN 1 THEN 'why is it so: ' ELSE '' END"


@query("syn_expand", f"""{RERANK}, ty AS (SELECT query_id, {_CLASS} AS kind FROM (SELECT query_id, lower({_FORMS} || q) AS x FROM q)), r AS (SELECT * FROM ranked JOIN ty USING (query_id) WHERE kind IN ('explanation', 'procedure', 'comparison') AND lexical_score > 0),
sec AS (SELECT query_id, title, section, max(lexical_score) AS s FROM r GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(lexical_score) DESC, title, section) <= 4),
doc AS (SELECT query_id, title, max(lexical_score) AS s FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(lexical_score) DESC, title) <= 3),
bs AS (SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 3), bd AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2)
SELECT query_id, doc_id, 'section' AS guided, round(least(0.42::DOUBLE, s / 40 + 0.08::DOUBLE), 6) AS boost FROM sec JOIN bs ON title = source AND section = lang
UNION ALL SELECT query_id, doc_id, 'document', round(least(0.28::DOUBLE, s / 48 + 0.04::DOUBLE), 6) FROM (SELECT * FROM doc ANTI JOIN sec USING (query_id, title)) JOIN bd ON title = source""")
def syn_expand(t: Tables) -> DataFrame:
    """Sources as documents, their languages as sections, texts as chunks; two of three queries ask how or why."""
    kind = question_type(F.lower(F.concat(F.expr(_FORMS), "q")))
    hits = ranked(t).where((F.col("lexical_score") > 0) & kind.isin(*R.EXPANDED)).select("query_id", F.col("title").alias("document"), "section", "lexical_score")
    return R.expand_by_synopsis(hits, t("documents").select(F.col("doc_id"), F.col("source").alias("document"), F.col("lang").alias("section")))


@query("asset_pages", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = k AND l_linenumber BETWEEN top - 1 AND top")
def asset_pages(t: Tables) -> DataFrame:
    wanted = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top"))
    places = wanted.select("l_orderkey", F.explode(F.sequence(F.col("top") - 1, F.col("top"))).alias("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber").join(places, ["l_orderkey", "l_linenumber"], "left_semi").distinct()


@query("asset_scope", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def asset_scope(t: Tables) -> DataFrame:
    return t("orders").join(t("lineitem").where("l_quantity >= 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("asset_boost", f"""WITH c AS (SELECT conv_id, turn, (length(text) % 100) / 100.0::DOUBLE AS score, role FROM conversations), b AS (SELECT c.conv_id, c.turn, max(a.score) + 0.1::DOUBLE AS best FROM c JOIN c a ON a.conv_id = c.conv_id AND a.role = 'user' AND a.turn BETWEEN c.turn - 1 AND c.turn + 1 WHERE c.role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn, round(greatest(c.score, coalesce(best, c.score)), 6) AS score FROM c LEFT JOIN b USING (conv_id, turn) WHERE role = 'assistant'""")
def asset_boost(t: Tables) -> DataFrame:
    """Assistant turns as chunks over the pages around them, user turns as assets; scores come from the lengths."""
    c = t("conversations").select("conv_id", "turn", "role", (F.length("text") % 100 / 100.0).cast("double").alias("score"))
    chunks = c.where("role = 'assistant'").select(F.col("conv_id").alias("group"), F.col("turn").alias("chunk_id"), (F.col("turn") - 1).alias("page_start"), (F.col("turn") + 1).alias("page_end"), "score")
    assets_ = c.where("role = 'user'").select(F.col("conv_id").alias("group"), F.col("turn").alias("page"), F.col("score").alias("asset_score"))
    return L.boosted(chunks, assets_).select(F.col("group").alias("conv_id"), F.col("chunk_id").alias("turn"), F.round("score", 6).alias("score"))


@query("link_support", "SELECT l_partkey, max(least(0.32, l_discount * greatest(0.1, l_tax + 0.15))) AS support FROM lineitem GROUP BY l_partkey")
def link_support(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_partkey").agg(F.max(F.least(F.lit(0.32), F.col("l_discount") * F.greatest(F.lit(0.1), F.col("l_tax") + 0.15))).alias("support"))


@query("fetch_by_ids", "WITH i AS (SELECT l_orderkey, l_partkey AS p_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos FROM lineitem) SELECT l_orderkey, pos, p_partkey, p_name FROM i JOIN part USING (p_partkey)")
def fetch_by_ids(t: Tables) -> DataFrame:
    """Orders as requests for the parts of their lines: each request's rows by id, in the order in which it names them."""
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1).alias("pos")
    asked = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), place)
    return asked.join(t("part").select("p_partkey", "p_name"), "p_partkey").select("l_orderkey", "pos", "p_partkey", "p_name")


@query("fetch_links", "SELECT l_orderkey, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 40")
def fetch_links(t: Tables) -> DataFrame:
    return t("lineitem").join(t("part").where("p_size >= 40"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "p_name")


@query("scope_check", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def scope_check(t: Tables) -> DataFrame:
    return t("benchmark").join(t("labels"), F.col("item_id") == F.col("doc_id"), "left_anti").select("item_id")
