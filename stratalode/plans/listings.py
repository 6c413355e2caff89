"""Registered queries: admin aggregates, listings, state machine and catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.plans.catalog import Tables, query
from stratalode.session import shared_path
from stratalode.sources import snapshots as N

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("agg_overview", " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS rows FROM {n}" for n in TABLES))
def agg_overview(t: Tables) -> DataFrame:
    out = None
    for name in TABLES:
        one = t(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("agg_corpus_overview", "SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source")
def agg_corpus_overview(t: Tables) -> DataFrame:
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("agg_doc_counts", "SELECT o_orderkey, count(l_linenumber) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def agg_doc_counts(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("q"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", zero("lines"), zero("parts"), zero("suppliers"), zero("returned"), F.round(F.coalesce("q", F.lit(0.0)), 2).alias("quantity"))


@query("agg_documents", "SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment")
def agg_documents(t: Tables) -> DataFrame:
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    joined = t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_mktsegment", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "finished", "open")))


@query("agg_agent_metrics", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS above, round(avg(value), 4) AS mean, max(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS top_k FROM events GROUP BY event_type")
def agg_agent_metrics(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("above"), F.round(F.avg("value"), 4).alias("mean"), F.max(k).alias("top_k"))


@query("agg_entities", "SELECT s_suppkey AS entity_id, s_name AS name, count(DISTINCT l_orderkey) AS documents, count(l_orderkey) AS assertions FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2")
def agg_entities(t: Tables) -> DataFrame:
    per = t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("documents"), F.count("*").alias("assertions"))
    joined = t("supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("assertions", F.lit(0)).alias("assertions"))


@query("agg_sessions", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS queries, arg_max(text, turn) AS latest, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def agg_sessions(t: Tables) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("queries"), F.max_by("text", "turn").alias("latest"), F.max("turn").alias("last_turn"))


@query("agg_latest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders) WHERE o_orderdate = newest GROUP BY o_custkey")
def agg_latest(t: Tables) -> DataFrame:
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return t("orders").groupBy("o_custkey").agg(newest.alias("o_orderkey"))


@query("agg_attempt", "SELECT user_id, event_type, coalesce(max(event_id % 7), 0) + 1 AS attempt FROM events GROUP BY 1, 2")
def agg_attempt(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id", "event_type").agg((F.coalesce(F.max(F.col("event_id") % 7), F.lit(0)) + 1).alias("attempt"))


@query("agg_feedback", "WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type AS pattern, count(*) FILTER (value >= 60) AS approved, count(*) FILTER (value < 20) AS rejected, count(*) FILTER (value >= 20 AND value < 60) AS needs_review, CAST(sum(n) AS BIGINT) AS total FROM l GROUP BY 1")
def agg_feedback(t: Tables) -> DataFrame:
    last = t("events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("n"))
    v = F.col("value")
    return last.groupBy(F.col("event_type").alias("pattern")).agg(F.count_if(v >= 60).alias("approved"), F.count_if(v < 20).alias("rejected"), F.count_if((v >= 20) & (v < 60)).alias("needs_review"), F.sum("n").alias("total"))


@query("agg_completion", "SELECT source, count(*) AS chunks, count(quality) AS reviewed, count(*) FILTER (quality = 1) AS published, round(count(*) FILTER (quality = 1) * 1.0 / greatest(count(*), 1), 4) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_completion(t: Tables) -> DataFrame:
    good = F.count_if(F.col("quality") == 1)
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("chunks"), F.count("quality").alias("reviewed"), good.alias("published"), F.round(good / F.greatest(F.count("*"), F.lit(1)), 4).alias("share"))


@query("agg_run_totals", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS files, CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_run_totals(t: Tables) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("files"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))


def page(df: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing in the order of its keys."""
    return df.orderBy(*keys).offset(offset).limit(limit)


@query("list_chunks", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY doc_id LIMIT 50 OFFSET 10")
def list_chunks(t: Tables) -> DataFrame:
    return page(t("documents").where("lang = 'en' AND n_chars > 500").select("doc_id", "lang", "source", "n_chars"), ["doc_id"], 50, 10)


@query("list_metadata", "SELECT d.doc_id, lang, source, coalesce(CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' END, 'pending') AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def list_metadata(t: Tables) -> DataFrame:
    status = F.coalesce(F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected"), F.lit("pending"))
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "source", status.alias("status"))


@query("list_misc", "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def list_misc(t: Tables) -> DataFrame:
    return t("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("detail_bundle", "SELECT o_orderkey, c_name, o_totalprice, count(*) AS lines, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def detail_bundle(t: Tables) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])  # lines of one order
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), parts.alias("parts"), F.sum(F.expr("CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))")).cast("double").alias("revenue"))
    joined = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_name", "o_totalprice", "lines", "parts", "revenue")


@query("stage_order", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def stage_order(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.desc("o_orderdate"), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("state_machine", "WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_custkey, o_orderkey, before, status FROM l WHERE before IS NOT NULL AND NOT ((before = 'O' AND status IN ('P', 'F', 'O')) OR (before = 'P' AND status IN ('F', 'P')) OR (before = 'F' AND status = 'O'))")
def state_machine(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("O", "P"), ("O", "F"), ("O", "O"), ("P", "F"), ("P", "P"), ("F", "O")], "before string, status string")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.lag("o_orderstatus").over(w).alias("before"))
    return log.where("before IS NOT NULL").join(F.broadcast(allowed), ["before", "status"], "left_anti").select("o_custkey", "o_orderkey", "before", "status")


@query("lease", "SELECT user_id, count(*) AS claims, count(*) FILTER (ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00') AS live FROM events GROUP BY user_id")
def lease(t: Tables) -> DataFrame:
    live = F.expr("ts + INTERVAL 30 MINUTES > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
    return t("events").groupBy("user_id").agg(F.count("*").alias("claims"), F.count_if(live).alias("live"))


@query("snapshot", """WITH f AS (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 5), v AS (SELECT d.source, CASE WHEN f.source IS NULL THEN 'second' ELSE 'first' END AS snapshot_id, doc_id FROM documents d LEFT JOIN f USING (source) WHERE f.source IS NULL OR doc_id % 2 = 0)
SELECT source, snapshot_id, count(*) AS documents, max(doc_id) AS head FROM v GROUP BY 1, 2""")
def snapshot(t: Tables) -> DataFrame:
    """Two snapshots by source, half of the documents and then all; a source with a document that fails the check keeps the first."""
    path, rows = shared_path(t.spark, "snapshots"), t("documents").select("source", "doc_id")
    N.publish(rows.where("doc_id % 2 = 0"), path, "first", "source", {"id": F.col("doc_id").isNotNull()})
    N.publish(rows, path, "second", "source", {"id": F.col("doc_id").isNotNull(), "sound": F.col("doc_id") % 97 != 5})
    now = N.active(t.spark, path, "source", "source string, doc_id long")
    return now.groupBy("source", "snapshot_id").agg(F.count("*").alias("documents"), F.max("doc_id").alias("head"))


@query("bundle_backfill", "SELECT d.doc_id, n_chars, length(text) AS chars FROM documents d WHERE n_chars IS DISTINCT FROM length(text)")
def bundle_backfill(t: Tables) -> DataFrame:
    size = F.length("text").cast("long")
    return t("documents").where(~F.col("n_chars").eqNullSafe(size)).select("doc_id", "n_chars", size.alias("chars"))


@query("src_admin_sql", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def src_admin_sql(t: Tables) -> DataFrame:
    from stratalode.sources.admin import run_sql

    return run_sql(t, "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", row_limit=250)


@query("src_catalog", "SELECT table_name AS relation, column_name AS name, CAST(column_index AS INTEGER) AS position FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{n}'" for n in TABLES) + ")")
def src_catalog(t: Tables) -> DataFrame:
    rows = [(name, c, k) for name in TABLES for k, c in enumerate(t(name).columns, 1)]
    return t.spark.createDataFrame(rows, "relation string, name string, position int")


@query("point_get", "SELECT doc_id, lang, source, n_chars, text FROM documents WHERE doc_id = (SELECT max(doc_id) FROM labels)")
def point_get(t: Tables) -> DataFrame:
    key = t("labels").agg(F.max("doc_id").alias("doc_id"))
    return t("documents").join(F.broadcast(key), "doc_id").select("doc_id", "lang", "source", "n_chars", "text")


@query("count_filtered", "SELECT lang, count(*) AS all_rows, count(*) FILTER (n_chars > 1000) AS long_rows, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def count_filtered(t: Tables) -> DataFrame:
    return t("documents").groupBy("lang").agg(F.count("*").alias("all_rows"), F.count_if(F.col("n_chars") > 1000).alias("long_rows"), F.countDistinct("source").alias("sources"))


@query("place_list", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def place_list(t: Tables) -> DataFrame:
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("job_create", "SELECT o_custkey, count(*) AS active, max(o_orderkey) AS newest FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1")
def job_create(t: Tables) -> DataFrame:
    return t("orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("active"), F.max("o_orderkey").alias("newest")).where("active > 1")


@query("redact")
def redact(t: Tables) -> DataFrame:
    from stratalode.functions.redaction import redact_json

    return t("events").select("event_id", redact_json(F.col("props"), ("token", "secret", "password", "k")).alias("props"))
