"""Registered queries: sources, sinks, merges, publication and replays over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalode.functions import text as T
from stratalode.functions.redaction import redact_json
from stratalode.operators import ingest as I
from stratalode.operators import retrieval as R
from stratalode.plans import quality as QP
from stratalode.plans import text as TP
from stratalode.plans.catalog import Tables, query
from stratalode.plans.retrieval import VECTOR
from stratalode.sources import pages as PG
from stratalode.sources import snapshots as N
from stratalode.session import shared_path
from stratalode.sources import tables as S


@query("src_text", "SELECT doc_id, text, CAST(length(text) AS INTEGER) AS chars FROM documents")
def src_text(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "text", F.length("text").alias("chars"))


@query("src_pdf_range", "SELECT o_orderkey, greatest(1, least(lines, 2)) AS page_start, greatest(1, least(lines, 5)) AS page_end FROM (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)")
def src_pdf_range(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return g.select("o_orderkey", F.greatest(F.lit(1), F.least("lines", F.lit(2))).alias("page_start"), F.greatest(F.lit(1), F.least("lines", F.lit(5))).alias("page_end"))


@query("src_eval_json", "SELECT item_id AS id, text AS query, 5 AS top_k FROM benchmark")
def src_eval_json(t: Tables) -> DataFrame:
    rows = t("benchmark").select(F.to_json(F.struct(F.col("item_id").alias("id"), F.col("text").alias("query"), F.lit(5).alias("top_k"))).alias("j"))
    return rows.select(F.from_json("j", "id long, query string, top_k int").alias("r")).select("r.*")


@query("src_pdf_multimodal")
def src_pdf_multimodal(t: Tables) -> DataFrame:
    return PG.extract(t("pages"))


@query("src_page_text")
def src_page_text(t: Tables) -> DataFrame:
    return PG.extract(t("pages")).select("page_id", "text")


@query("src_pdf")
def src_pdf(t: Tables) -> DataFrame:
    text = PG.extract(t("pages")).select("page_id", "text")
    return text.select("page_id", F.concat(F.lit("[[Page "), F.col("page_id") + 1, F.lit("]]\n\n"), "text").alias("text"))


@query("src_embedded_images")
def src_embedded_images(t: Tables) -> DataFrame:
    return PG.extract(t("pages")).select("page_id", F.explode_outer("assets").alias("asset_id"))


@query("src_page_asset")
def src_page_asset(t: Tables) -> DataFrame:
    return PG.extract(t("pages")).select("page_id", F.when((F.col("images") > 0) | (F.length("text") > 0), F.concat(F.lit("page_image:"), "page_id")).alias("asset_id"))


@query("dedup_pdf_hash", "SELECT page_id, sha256(html || '|page_start=1') AS hash FROM pages")
def dedup_pdf_hash(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.sha2(F.concat(F.col("html"), F.lit("|page_start=1")), 256).alias("hash"))


@query("prep_sanitize_json")
def prep_sanitize_json(t: Tables) -> DataFrame:
    return t("events").select("event_id", S.sanitize_json(F.col("props")).alias("props"))


@query("sink_upsert", "WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, 0 AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, 1 FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey, n)) AS o_orderkey FROM b GROUP BY 1")
def sink_upsert(t: Tables) -> DataFrame:
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    old, new = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus")
    return S.merge(old, new, ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@query("sink_replace_doc", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderpriority = '1-URGENT'")
def sink_replace_doc(t: Tables) -> DataFrame:
    new = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return S.replace_group(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


@query(
    "sink_vector_upsert",
    """WITH fresh AS (SELECT doc_id AS vec_id, lang, source FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 3 = 0)
SELECT vec_id, NULL AS lang, 'old' AS source, 'ready' AS publish_state FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM fresh) UNION ALL SELECT vec_id, lang, source, 'staged' FROM fresh""",
)
def sink_vector_upsert(t: Tables) -> DataFrame:
    """An index of all vectors takes a staged batch of every third document's, with its metadata."""
    old = t("embeddings").select("vec_id", "embedding", F.lit(None).cast("string").alias("lang"), F.lit("old").alias("source"), F.lit("ready").alias("publish_state"))
    batch = t("embeddings").join(t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")
    return S.upsert_vectors(old, batch, "vec_id", "staged", shared_path(t.spark, "vectors")).select("vec_id", "lang", "source", "publish_state")


@query("sink_publish_flip", "SELECT l_orderkey, l_linenumber, 'ready' AS publish_state FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def sink_publish_flip(t: Tables) -> DataFrame:
    """Orders are published line by line; one with a line of fifty or more fails as a whole."""
    staged = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.publish_flip(staged, "l_orderkey", F.col("l_quantity") < 50, shared_path(t.spark, "flip")).select("l_orderkey", "l_linenumber", "publish_state")


@query("sink_eval_json", """SELECT '{"item_id":' || item_id || ',"chars":' || length(text) || '}' AS line FROM benchmark""")
def sink_eval_json(t: Tables) -> DataFrame:
    return t("benchmark").select(F.to_json(F.struct("item_id", F.length("text").alias("chars"))).alias("line"))


@query("sink_delete_cascade", "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def sink_delete_cascade(t: Tables) -> DataFrame:
    gone = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.delete_where(t("lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("id_asset", "SELECT page_id, '0:p' || lpad(CAST(page_id AS VARCHAR), 4, '0') || ':page_image:00:' || substr(sha256(url), 1, 16) AS asset_id FROM pages WHERE length(CAST(page_id AS VARCHAR)) <= 4 UNION ALL SELECT page_id, '0:p' || page_id || ':page_image:00:' || substr(sha256(url), 1, 16) FROM pages WHERE length(CAST(page_id AS VARCHAR)) > 4")
def id_asset(t: Tables) -> DataFrame:
    n = F.col("page_id").cast("string")
    n = F.when(F.length(n) <= 4, F.lpad(n, 4, "0")).otherwise(n)
    return t("pages").select("page_id", F.concat(F.lit("0:p"), n, F.lit(":page_image:00:"), F.substring(F.sha2("url", 256), 1, 16)).alias("asset_id"))


_TURNS = "c AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role, lag(turn) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_PLAIN = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g')"


@query(
    "trace_write",
    f"""WITH {_TURNS} SELECT 'message' AS kind, conv_id, turn, role AS name, NULL::DOUBLE AS score, {_PLAIN} AS body FROM c
UNION ALL SELECT 'run', conv_id, turn, CASE WHEN next_role = 'assistant' THEN 'completed' ELSE 'abstained' END, NULL, CASE WHEN next_role = 'assistant' THEN regexp_replace(coalesce(answer, ''), '[^A-Za-z0-9 ]', '', 'g') ELSE '' END FROM c WHERE role = 'user'
UNION ALL SELECT 'source', conv_id, turn, 'message', round(1.0 / (turn - before + 2), 6), '{{"api_token": "[redacted]", "turn": ' || before || '}}' FROM c WHERE role = 'user' AND before IS NOT NULL""",
)
def trace_write(t: Tables) -> DataFrame:
    """Each user turn is a run with the next turn as its answer and the turn before as its source; three tables are appended."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9 ]", "")
    c = t("conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w), "before": F.lag("turn").over(w)})
    done = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    asked = c.where("role = 'user'")
    messages = c.select("conv_id", "turn", F.col("role").alias("name"), plain(F.col("text")).alias("body"))
    runs = asked.select("conv_id", "turn", F.when(done, "completed").otherwise("abstained").alias("name"), F.when(done, plain(F.col("answer"))).otherwise("").alias("body"))
    payload = F.to_json(F.struct(F.lit("secret").alias("api_token"), F.col("before").alias("turn")))
    sources = asked.where("before IS NOT NULL").select("conv_id", "turn", F.lit("message").alias("name"), (1 / (F.col("turn") - F.col("before") + 2)).alias("score"), redact_json(payload, ("token", "password")).alias("body"))
    tables = S.append_trace(shared_path(t.spark, "trace"), messages, runs, sources)
    rows = lambda kind, name: tables[name].select(F.lit(kind).alias("kind"), "conv_id", "turn", "name", (F.col("score") if name == "sources" else F.lit(None).cast("double")).alias("score"), "body")
    return rows("message", "messages").unionByName(rows("run", "runs")).unionByName(rows("source", "sources"))


@query(
    "route_write",
    """WITH e AS (SELECT event_id, event_type || ':' || (event_id // 4 % 11) AS pattern, event_id % 4 AS part FROM events),
old AS (SELECT pattern, min(event_id) AS example, max(event_id) AS route, count(*) AS hits FROM e WHERE part = 0 AND event_id % 5 < 2 GROUP BY 1), saved AS (SELECT pattern, min(event_id) AS first, max(event_id) AS last FROM e WHERE part = 1 AND event_id % 3 = 0 GROUP BY 1),
touched AS (SELECT pattern, count(*) AS more FROM e WHERE part > 1 GROUP BY 1)
SELECT pattern, coalesce(example, first) AS example, coalesce(last, route) AS route, CAST(coalesce(hits, 0) + coalesce(more, 0) AS BIGINT) AS hits FROM old FULL OUTER JOIN saved USING (pattern) LEFT JOIN touched USING (pattern)""",
)
def route_write(t: Tables) -> DataFrame:
    """Events stand for cached routes, for saves and for touches, by their number."""
    e = t("events").select("event_id", F.concat_ws(":", "event_type", F.expr("event_id div 4 % 11")).alias("pattern"), (F.col("event_id") % 4).alias("part"))
    old = e.where("part = 0 AND event_id % 5 < 2").groupBy("pattern").agg(F.min("event_id").alias("example"), F.max("event_id").alias("route"), F.count("*").alias("hits"))
    saves = e.where("part = 1 AND event_id % 3 = 0").select("pattern", F.col("event_id").alias("example"), F.col("event_id").alias("route"), F.col("event_id").alias("at"))
    return S.save_routes(old, saves, e.where("part > 1"))


_ACCEPTED = f"WITH {QP.VALIDATED_SQL}"


@query("ingest_full", f"{_ACCEPTED} SELECT source, count(*) AS documents, count(*) FILTER (status = 'accepted') AS published, count(DISTINCT sha256(text)) AS distinct_texts FROM validated GROUP BY source")
def ingest_full(t: Tables) -> DataFrame:
    """Register, hash, validate and publish in one plan."""
    v = QP.validated(t)
    return v.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "accepted").alias("published"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))


_KG_FAILED = "(doc_id % 53 = 0 OR doc_id % 59 = 0)"
_UNIT = "concat_ws('/', source, lang)"


def _failed() -> Column:
    """Every so many extractions failed."""
    return (F.col("chunk_id") % 53 == 0) | (F.col("chunk_id") % 59 == 0)


def accepted(t: Tables) -> DataFrame:
    """Accepted chunks; a document is a source in a language."""
    return QP.validated(t).where("status = 'accepted'").select(F.concat_ws("/", "source", "lang").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")


_VISIBLE = f"{_ACCEPTED}, ch AS (SELECT doc_id, {_UNIT} AS document_id, text FROM validated WHERE status = 'accepted')"


@query("publish_stage", f"{_VISIBLE}, g AS (SELECT document_id, count(*) AS n, count(*) FILTER ({_KG_FAILED}) AS failures FROM ch GROUP BY 1) SELECT document_id, CASE WHEN failures = 0 THEN 'completed' ELSE 'review' END AS status, CASE WHEN failures = 0 THEN n ELSE 0 END AS indexed, CASE WHEN failures = 0 THEN 'first' END AS snapshot_id FROM g")
def publish_stage(t: Tables) -> DataFrame:
    """Documents are staged with their vectors and become visible as a whole, but for those with failed extractions."""
    rows = accepted(t).select("document_id", "chunk_id", R.dummy_vector(F.col("text")).alias("vec"), _failed().alias("failed"))
    path = shared_path(t.spark, "corpus")
    report = N.publish(rows, path, "first", "document_id", {"extraction": ~F.col("failed"), "vector": F.size("vec") > 0})
    seen = N.active(t.spark, path, "document_id", "document_id string, chunk_id long, vec array<double>, failed boolean").groupBy("document_id", "snapshot_id").agg(F.count("*").alias("indexed"))
    out = report.select(F.col("unit").alias("document_id"), F.when(F.col("state") == "active", "completed").otherwise("review").alias("status"))
    return out.join(seen, "document_id", "left").select("document_id", "status", F.coalesce("indexed", F.lit(0)).alias("indexed"), "snapshot_id")


_JOB = "CASE {0} % 6 WHEN 0 THEN 'chunks_validated' WHEN 1 THEN 'kg_validated' WHEN 2 THEN 'indexed' WHEN 3 THEN 'completed' WHEN 4 THEN 'parsed' ELSE 'chunks_validated' END"


@query(
    "resume",
    f"""{_VISIBLE}, j AS (SELECT document_id, min(doc_id) AS first, {_JOB.format('min(doc_id)')} AS was FROM ch GROUP BY 1),
c AS (SELECT ch.*, was, was <> 'chunks_validated' OR doc_id % 3 = 0 AS had, was IN ('indexed', 'completed') OR doc_id % 4 = 0 AS held FROM ch JOIN j USING (document_id)),
x AS (SELECT *, was = 'chunks_validated' AND NOT had AS made FROM c), f AS (SELECT DISTINCT document_id FROM x WHERE (had OR made) AND {_KG_FAILED})
SELECT document_id, was, CASE WHEN was NOT IN ('chunks_validated', 'kg_validated', 'indexed') THEN was WHEN f.document_id IS NOT NULL THEN 'review' ELSE 'completed' END AS status,
  count(*) FILTER (made) AS extracted, count(*) FILTER (was IN ('chunks_validated', 'kg_validated') AND f.document_id IS NULL AND NOT held) AS indexed FROM x LEFT JOIN f USING (document_id) GROUP BY document_id, was, f.document_id""",
)
def resume(t: Tables) -> DataFrame:
    """Jobs in all states with part of their work done, taken up where they stopped."""
    path = shared_path(t.spark, "resume")
    accepted(t).write.parquet(f"{path}/chunks")  # validated once, not for each step that reads them
    chunks = t.spark.read.parquet(f"{path}/chunks")
    jobs = chunks.groupBy("document_id").agg(F.min("chunk_id").alias("first")).withColumn("status", F.expr(_JOB.format("first")))
    state = chunks.join(jobs.select("document_id", "status"), "document_id")
    extracted = lambda df: df.select("chunk_id", "document_id", F.when(_failed(), "quarantined").otherwise("validated").alias("status"))
    embedded = lambda df: df.select("chunk_id", "document_id", R.dummy_vector(F.col("text")).alias("vec"))
    extracted(state.where("status <> 'chunks_validated' OR chunk_id % 3 = 0")).write.parquet(f"{path}/extractions")
    embedded(state.where("status IN ('indexed', 'completed') OR chunk_id % 4 = 0")).write.parquet(f"{path}/vectors")
    return I.resume(jobs.select("document_id", "status"), chunks, path, extracted, embedded)


@query("rebuild", rf"SELECT doc_id, sha256({TP.squeeze(TP.strip('text'))}) AS rebuilt_hash FROM documents WHERE source IN ('src1', 'src2')")
def rebuild(t: Tables) -> DataFrame:
    return t("documents").where("source IN ('src1', 'src2')").select("doc_id", F.sha2(T.squeeze(T.strip(F.col("text"))), 256).alias("rebuilt_hash"))


_INDEXED_ROWS = """cu AS (SELECT 'chunk' AS kind, doc_id AS id, status = 'accepted' AS visible, sha256(coalesce(text, '')) AS content, 'v2' AS version FROM validated UNION ALL SELECT 'asset', page_id, length(html) >= 40, sha256(coalesce(html, '')), 'v2' FROM pages),
ix AS (SELECT kind, id, CASE WHEN id % 7 = 0 THEN 'stale' ELSE content END AS content, CASE WHEN id % 11 = 0 THEN 'v1' ELSE 'v2' END AS version FROM cu WHERE id % 5 <> 0 UNION ALL SELECT 'chunk', -1 - n_nationkey, 'gone', 'v2' FROM nation)"""


@query("reindex", f"{_ACCEPTED}, {_INDEXED_ROWS} SELECT kind, id, CASE WHEN coalesce(visible, false) THEN CASE WHEN ix.id IS NULL THEN 'insert' ELSE 'update' END ELSE 'delete' END AS action FROM cu FULL OUTER JOIN ix USING (kind, id) WHERE CASE WHEN coalesce(visible, false) THEN ix.id IS NULL OR ix.content <> cu.content OR ix.version <> cu.version ELSE ix.id IS NOT NULL END")
def reindex(t: Tables) -> DataFrame:
    """What brings an index of chunks and assets in step: made from what is current, with gaps, stale rows, an old model's and rows long gone."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    chunks = QP.validated(t).select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"), (F.col("status") == "accepted").alias("visible"), digest("text").alias("content"), F.lit("v2").alias("version"))
    assets = t("pages").select(F.lit("asset").alias("kind"), F.col("page_id").alias("id"), (F.length("html") >= 40).alias("visible"), digest("html").alias("content"), F.lit("v2").alias("version"))
    current = chunks.unionByName(assets)
    held = current.where("id % 5 <> 0").select("kind", "id", F.when(F.col("id") % 7 == 0, "stale").otherwise(F.col("content")).alias("content"), F.when(F.col("id") % 11 == 0, "v1").otherwise("v2").alias("version"))
    gone = t("nation").select(F.lit("chunk").alias("kind"), (-1 - F.col("n_nationkey")).cast("long").alias("id"), F.lit("gone").alias("content"), F.lit("v2").alias("version"))
    named = lambda df: df.withColumn("key", F.struct("kind", "id"))
    return I.changes(named(current).drop("kind", "id"), named(held.unionByName(gone)).drop("kind", "id"), "key").select("key.kind", "key.id", "action")


@query("del_stage", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def del_stage(t: Tables) -> DataFrame:
    return S.delete_where(t("documents").select("doc_id", "lang"), t("labels").where("quality = 0").select("doc_id"), "doc_id")


@query("emb_remote", f"SELECT doc_id, {VECTOR.format("coalesce(text, '')")} AS vec FROM documents")
def emb_remote(t: Tables) -> DataFrame:
    """The embedder interface: batches of texts go to a function; here the deterministic vectors stand in for a service."""
    from stratalode.operators.embedding import embed

    return embed(t("documents").select("doc_id", "text"), "doc_id", "text")


@query("kg_extract_model")
def kg_extract_model(t: Tables) -> DataFrame:
    """The extractor interface: batches of texts go to a function that returns candidates as JSON."""
    from stratalode.operators.embedding import extract_candidates

    return extract_candidates(t("benchmark").select("item_id", "text"), "item_id", "text")
