"""Registered queries: context rows rendered and kept within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.operators import budget as B
from stratalode.plans import retrieval as P
from stratalode.plans.catalog import Tables, query


def chunk_rows(t: Tables) -> DataFrame:
    """A conversation's turns as the chunks of a prompt."""
    none = lambda kind: F.lit(None).cast(kind)
    return t("conversations").select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), none("int").alias("page_start"), none("int").alias("page_end"), F.array("role").alias("section_path"),
        none("string").alias("section_title"), F.col("role").alias("chunk_role"), "text", *(none("string").alias(c) for c in B.KINDS["chunk"].optional),
    )


def assertion_rows(t: Tables) -> DataFrame:
    """An order's lines as assertions of what was supplied by whom."""
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("assertion_id"), F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("part:"), "l_partkey").alias("subject_entity_id"), F.lit("supplied_by").alias("predicate"),
        F.lit(None).cast("string").alias("object_entity_id"), F.concat(F.lit("supplier "), "l_suppkey", F.lit(" with flag "), "l_returnflag", F.lit(" and status "), "l_linestatus").alias("object_literal"), F.col("l_discount").alias("confidence"),
    )


def entity_rows(t: Tables) -> DataFrame:
    """The parts of an order's lines as entities; parts of even size have an alias."""
    p = t("part").select("p_partkey", F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("entity_type"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("aliases"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").drop("p_partkey")


def evidence_rows(t: Tables) -> DataFrame:
    """The documents found for a question as evidence."""
    return P.ranked(t).select("query_id", "new_rank", F.col("doc_id").alias("evidence_id"), F.col("query_id").alias("assertion_id"), F.coalesce("text", F.lit("")).alias("excerpt"))


#: Per kind: its rows, the column of their group, their order, SQL for rows (g, k, x.*) and for what is shown, with the room left
#: as {room}: the text that may be cut, whether it was, and the JSON's size with that text.
_CHUNK_T, _EVIDENCE_T = "greatest(200, {room} - 700)", "greatest(120, {room} - 180)"
_ASSERTED = "length(json_object('assertion_id', x.assertion_id, 'chunk_id', x.chunk_id, 'subject_entity_id', x.subject, 'predicate', 'supplied_by', 'object_entity_id', NULL, 'object_literal', {text}, 'confidence', x.confidence)::VARCHAR) + 13"
_ENTITY = "'entity_id', x.entity_id, 'canonical_name', x.p_name, 'entity_type', x.p_type"
_FORMS = {
    "chunk": (
        chunk_rows, "conv_id", "turn", "SELECT conv_id AS g, turn AS place, 0 AS tie, conv_id || ':' || turn AS chunk_id, role, text FROM conversations",
        f"substr(coalesce(x.text, ''), 1, {_CHUNK_T})", f"length(coalesce(x.text, '')) > {_CHUNK_T}",
        "length(json_object('chunk_id', x.chunk_id, 'document_id', CAST(x.g AS VARCHAR), 'chunk_index', x.place, 'page_start', NULL, 'page_end', NULL, 'section_path', [x.role], 'section_title', NULL, 'chunk_role', x.role, 'text', {text})::VARCHAR) + 17",
    ),
    "assertion": (
        assertion_rows, "l_orderkey", "l_linenumber",
        "SELECT l_orderkey AS g, l_linenumber AS place, ('part:' || l_partkey, 'supplier ' || l_suppkey || ' with flag ' || l_returnflag || ' and status ' || l_linestatus, l_discount) AS tie, l_orderkey || '-' || l_linenumber AS assertion_id, CAST(l_orderkey AS VARCHAR) AS chunk_id, 'part:' || l_partkey AS subject, 'supplier ' || l_suppkey || ' with flag ' || l_returnflag || ' and status ' || l_linestatus AS literal, l_discount AS confidence FROM lineitem",
        f"CASE WHEN {{room}} > 0 AND {_ASSERTED.format(text='x.literal')} > {{room}} THEN substr(x.literal, 1, greatest(0, {{room}} - 200)) ELSE x.literal END", f"({{room}} > 0 AND {_ASSERTED.format(text='x.literal')} > {{room}})", _ASSERTED,
    ),
    "entity": (
        entity_rows, "l_orderkey", "l_linenumber", "SELECT l_orderkey AS g, l_linenumber AS place, CAST(p_partkey AS VARCHAR) AS tie, CAST(p_partkey AS VARCHAR) AS entity_id, p_name, p_type, p_brand, p_size % 2 = 0 AS known FROM lineitem JOIN part ON l_partkey = p_partkey", "''", "false",
        f"CASE WHEN x.known AND {{room}} > 220 THEN length(json_object({_ENTITY}, 'aliases', [x.p_brand])::VARCHAR) + 7 ELSE length(json_object({_ENTITY})::VARCHAR) + 5 END",
    ),
    "evidence": (
        evidence_rows, "query_id", "new_rank", "SELECT query_id AS g, new_rank AS place, 0 AS tie, doc_id, coalesce(text, '') AS text FROM ranked", f"substr(x.text, 1, {_EVIDENCE_T})", f"length(x.text) > {_EVIDENCE_T}",
        "length(json_object('evidence_id', x.doc_id, 'assertion_id', x.g, 'excerpt', {text})::VARCHAR) + 5",
    ),
}
_LIMITS = {"chunk": 340, "assertion": 420, "entity": 300, "evidence": 700}


def budget_sql(kind: str, limit: int) -> str:
    """CTEs ending in {kind}_kept (g, place, t, size, short): the fold over a group's rows as a recursion, one row a step."""
    _, _, _, rows, text, short, size = _FORMS[kind]
    whole = str(max(B.LEAST_ROOM, limit))
    at = lambda sql, room, said="t": sql.replace("{room}", room).replace("{text}", said)
    return f"""{kind}_x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY place, tie) AS k FROM ({rows})),
{kind}_h AS (SELECT x.*, 0 AS step, {at(text, whole)} AS t FROM {kind}_x x WHERE k = 1 UNION ALL
  SELECT x.* REPLACE (step + 1 AS step, regexp_replace(substr(t, 1, greatest(24, length(t) // 2)), '\\s+$', '') || '...' AS t) FROM {kind}_h x WHERE {at(size, whole)} + 19 > {limit} AND length(t) > 27),
{kind}_c AS (SELECT g, t, {at(size, whole)} + 19 AS size FROM {kind}_h x QUALIFY row_number() OVER (PARTITION BY g ORDER BY step DESC) = 1),
{kind}_f AS (SELECT DISTINCT g, 0::BIGINT AS k, 0::BIGINT AS place, 0::BIGINT AS used, 0::BIGINT AS n, false AS done, false AS kept, '' AS t, 0::BIGINT AS size, false AS short FROM {kind}_x UNION ALL
  SELECT y.g, y.k, y.place, CASE WHEN n = 0 AND y.size > {limit} THEN used WHEN used + y.size <= {limit} THEN used + y.size ELSE used END, CASE WHEN used + y.size <= {limit} OR n = 0 THEN n + 1 ELSE n END, n = 0 AND y.size > {limit}, used + y.size <= {limit} OR n = 0,
    CASE WHEN n = 0 AND y.size > {limit} THEN c.t ELSE y.t END, CASE WHEN n = 0 AND y.size > {limit} THEN c.size ELSE y.size END, y.short OR (n = 0 AND y.size > {limit})
  FROM (SELECT x.g, x.k, x.place, x.used, x.n, x.t, x.short, {at(size, 'x.room')} + CASE WHEN x.short THEN 19 ELSE 0 END AS size
    FROM (SELECT x.*, {at(text, 'x.room')} AS t, {at(short, 'x.room')} AS short FROM (SELECT x.*, f.used, f.n, greatest(0, {limit} - f.used) AS room FROM {kind}_f f JOIN {kind}_x x ON x.g = f.g AND x.k = f.k + 1 WHERE NOT f.done) x) x) y JOIN {kind}_c c ON c.g = y.g),
{kind}_kept AS (SELECT g, place, t, size, short FROM {kind}_f WHERE kept)"""


def kept(t: Tables, kind: str) -> DataFrame:
    rows, group, order, *_ = _FORMS[kind]
    return B.budget(rows(t), group, [order], _LIMITS[kind], B.KINDS[kind])


@query("bud_rows", f"WITH RECURSIVE {budget_sql('chunk', _LIMITS['chunk'])} SELECT g AS conv_id, place AS turn, t AS text, size, short AS truncated FROM chunk_kept")
def bud_rows(t: Tables) -> DataFrame:
    """Turns as chunks within a budget: what doesn't fit is skipped, a first turn over it is halved and ends the list."""
    return kept(t, "chunk").select("conv_id", F.col("chunk_index").alias("turn"), "text", "size", "truncated")


_RECURSIVE = P.RERANK.replace("WITH ", "WITH RECURSIVE ", 1)


@query("bud_wrappers", f"{_RECURSIVE}, " + ", ".join(budget_sql(k, n) for k, n in _LIMITS.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, g AS id, count(*) AS rows, CAST(sum(size) AS BIGINT) AS chars, count(*) FILTER (short) AS cut FROM {k}_kept GROUP BY g" for k in _LIMITS))
def bud_wrappers(t: Tables) -> DataFrame:
    """Four kinds of rows, each within a budget of its own: how many are kept, with how many characters, and how many were cut."""
    out = None
    for kind, (_, group, *_) in _FORMS.items():
        one = kept(t, kind).groupBy(F.lit(kind).alias("kind"), F.col(group).alias("id")).agg(F.count("*").alias("rows"), F.sum("size").alias("chars"), F.count_if("truncated").alias("cut"))
        out = one if out is None else out.unionByName(one)
    return out


_ROOMS = {"chunk": 1000, "assertion": 240, "entity": 221, "evidence": 400}


def _render_sql(kind: str, room: int) -> str:
    _, _, _, rows, text, short, size = _FORMS[kind]
    at = lambda sql: sql.replace("{room}", str(room)).replace("{text}", "t")
    return f"SELECT '{kind}' AS kind, g AS id, CAST(place AS BIGINT) AS place, t AS text, {at(size)} AS size, short AS truncated FROM (SELECT x.*, {at(text)} AS t, {at(short)} AS short FROM ({rows}) x) x"


@query("bud_render", f"{P.RERANK} " + " UNION ALL ".join(_render_sql(k, n) for k, n in _ROOMS.items()))
def bud_render(t: Tables) -> DataFrame:
    """Rows of four kinds as they are shown in a given room: the text that is left, the size without the mark of a cut, and the cut."""
    out, texts = None, {"chunk": "text", "assertion": "object_literal", "evidence": "excerpt"}
    for kind, (rows, group, order, *_) in _FORMS.items():
        shown = rows(t).select(F.col(group).alias("id"), F.col(order).cast("long").alias("place"), F.struct("*").alias("r"))
        text = F.col(f"s.row.{texts[kind]}") if kind in texts else F.lit("")
        one = shown.withColumn("s", B.shown(F.col("r"), _ROOMS[kind], B.KINDS[kind])).select(F.lit(kind).alias("kind"), "id", "place", text.alias("text"), F.col("s.size").alias("size"), F.col("s.row.truncated").alias("truncated"))
        out = one if out is None else out.unionByName(one)
    return out
