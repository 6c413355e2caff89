"""Registered queries: search in the published vector index and among the graph's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.operators import entities as E
from stratalode.operators import vector_index as V
from stratalode.plans.catalog import Tables, query
from stratalode.session import shared_path

_INDEXED = "ix AS (SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS vec, source AS document_id, lang AS tenant_id, CASE WHEN vec_id % 7 = 3 THEN 'staged' ELSE 'ready' END AS publish_state FROM embeddings JOIN documents ON doc_id = vec_id)"


def indexed(t: Tables) -> DataFrame:
    """Vectors with their document's source as the document and its language as the tenant; every seventh is staged, not published."""
    d = t("documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("document_id"), F.col("lang").alias("tenant_id"))
    state = F.when(F.col("vec_id") % 7 == 3, "staged").otherwise(V.READY).alias("publish_state")
    return t("embeddings").select("vec_id", F.col("embedding").alias("vec"), state).join(d, "vec_id")


def vector_queries(t: Tables) -> DataFrame:
    """Every 50th vector asks within its tenant, each second of them in three documents only."""
    some = F.when(F.col("vec_id") % 100 == 0, F.array("document_id", F.lit("src1"), F.lit("src2")))
    return indexed(t).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec", "tenant_id", some.alias("document_ids"))


@query(
    "vec_knn",
    f"""WITH {_INDEXED}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_distance(a.vec, b.vec) ** 2 AS distance FROM ix a JOIN ix b ON a.tenant_id = b.tenant_id AND b.publish_state = 'ready' AND (a.vec_id % 100 <> 0 OR b.document_id IN (a.document_id, 'src1', 'src2')) WHERE a.vec_id % 50 = 0)
SELECT query_id, doc_id, round(distance, 5) AS distance, dense_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS INTEGER) AS dense_rank FROM d) WHERE dense_rank <= 10""",
)
def vec_knn(t: Tables) -> DataFrame:
    """The ten nearest published vectors that a query may see, from an index in folders by state and tenant."""
    index = V.write_index(indexed(t), shared_path(t.spark, "vector-index"))
    found = V.search(index, vector_queries(t), 10)
    return found.select("query_id", F.col("vec_id").alias("doc_id"), F.round("distance", 5).alias("distance"), F.col("rank").alias("dense_rank"))


_LINES = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_GRAPH = f"""en AS (SELECT 'part' || p_partkey AS entity_id, p_name AS canonical_name, p_type AS entity_type FROM part UNION ALL SELECT 'supplier' || s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
asr AS (SELECT DISTINCT {_LINES} AS assertion_id, l_orderkey AS document_id, 'part' || l_partkey AS s, 'supplier' || l_suppkey AS o, CASE WHEN l_linenumber = 1 THEN o_orderpriority END AS lit FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
evd AS (SELECT DISTINCT {_LINES} AS assertion_id, c_mktsegment AS excerpt FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 40)"""


def graph_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts and suppliers as entities, orders' lines as assertions between them, customers' segments as evidence of larger lines."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id")
    parts = t("part").select(F.concat(F.lit("part"), "p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("entity_type"))
    makers = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("supplier"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.col("n_name").alias("entity_type"))
    placed = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority")
    path = shared_path(t.spark, "graph-lines")  # read by all that follows
    held = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(placed, "l_orderkey")
    held.where("o_orderstatus <> 'P' OR l_quantity >= 40").distinct().write.parquet(path)
    lines = t.spark.read.parquet(path)
    assertions = lines.where("o_orderstatus <> 'P'").select(
        line, F.col("l_orderkey").alias("document_id"), F.concat(F.lit("part"), "l_partkey").alias("subject_entity_id"), F.concat(F.lit("supplier"), "l_suppkey").alias("object_entity_id"), F.when(F.col("l_linenumber") == 1, F.col("o_orderpriority")).alias("object_literal")
    )
    buyers = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("excerpt"))
    evidence = lines.where("l_quantity >= 40").join(buyers, "o_custkey").select(line, "excerpt")
    return parts.unionByName(makers), assertions, evidence


_HAS = "contains(lower(coalesce({}, '')), term)"


@query(
    "lex_entities",
    f"""WITH {_GRAPH}, q AS (SELECT p_partkey AS query_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, o_orderpriority, c_mktsegment)), '[^a-z0-9]+'), lambda x: length(x) >= 3)[1:{E.MOST_TERMS}] AS terms FROM part LEFT JOIN orders ON o_orderkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey WHERE p_partkey % 50 = 0),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY 1, 2),
fan AS (SELECT DISTINCT e.entity_id, e.canonical_name, e.entity_type, a.assertion_id, a.document_id, a.lit, v.excerpt FROM en e JOIN (SELECT s AS entity_id, * FROM asr UNION ALL SELECT o, * FROM asr) a USING (entity_id) LEFT JOIN evd v USING (assertion_id)),
m AS (SELECT query_id, term, times, entity_id, canonical_name, assertion_id, document_id, starts_with(lower(canonical_name), term) AS p, {_HAS.format('canonical_name')} AS n, {_HAS.format('entity_type')} AS t, {_HAS.format('entity_id')} AS i, {_HAS.format('lit')} AS l, {_HAS.format('excerpt')} AS x FROM fan, qt),
h AS (SELECT * FROM m WHERE n OR t OR i OR l OR x),
w AS (SELECT query_id, term, times, entity_id, max(CASE WHEN p THEN {E.PREFIX} ELSE 0 END) + max(CASE WHEN n THEN {E.NAME} ELSE 0 END) + max(CASE WHEN t THEN {E.TYPE} ELSE 0 END) + max(CASE WHEN i THEN {E.ID} ELSE 0 END) + max(CASE WHEN l THEN {E.LITERAL} ELSE 0 END) + max(CASE WHEN x THEN {E.EXCERPT} ELSE 0 END) AS worth FROM h GROUP BY 1, 2, 3, 4),
s AS (SELECT query_id, entity_id, sum(worth * times) AS relevance FROM w GROUP BY 1, 2),
c AS (SELECT query_id, entity_id, canonical_name, count(DISTINCT assertion_id) AS assertions, count(DISTINCT document_id) AS documents FROM h GROUP BY 1, 2, 3)
SELECT query_id, entity_id, CAST(relevance AS BIGINT) AS relevance, assertions, documents, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, assertions DESC, documents DESC, canonical_name, entity_id) AS INTEGER) AS place FROM s JOIN c USING (query_id, entity_id) QUALIFY place <= {E.LIMIT}""",
)
def lex_entities(t: Tables) -> DataFrame:
    """Every 50th part's name with an order's priority and a customer's segment asks for entities in orders that aren't pending."""
    text = F.concat_ws(" ", "p_name", "o_orderpriority", "c_mktsegment")
    asked = t("part").where("p_partkey % 50 = 0").join(t("orders"), F.col("o_orderkey") == F.col("p_partkey"), "left").join(t("customer"), F.col("c_custkey") == F.col("p_partkey"), "left")
    return E.search_entities(*graph_tables(t), asked.select(F.col("p_partkey").alias("query_id"), text.alias("q")))
