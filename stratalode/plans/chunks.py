"""Registered queries: parsed blocks, units, chunks and synopses over the documents' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalode.functions import text as T
from stratalode.operators import chunks as C
from stratalode.plans import text as P
from stratalode.plans.catalog import Tables, query

_B = P.BLOCKS_SQL
_S = P.strip("line")
_CLASS = P.CLASS_SQL
PARSED = f"""WITH {_B}, b0 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start, length(line) AS size FROM blocks),
b1 AS (SELECT doc_id, pos, page, {_S} AS line, char_start, char_start + size AS char_end FROM b0 WHERE length({_S}) > 0),
b2 AS (SELECT *, {_CLASS} AS block_type FROM b1),
b3 AS (SELECT *, CASE WHEN block_type = 'heading' THEN {P._LEVEL} WHEN {P._SECTION} IS NOT NULL THEN 2 END AS lvl, CASE WHEN block_type = 'heading' THEN {P._CLEAN} ELSE {P._SECTION} END AS name FROM b2),
b4 AS (SELECT *, """ + ", ".join(f"last_value(CASE WHEN lvl = {k} THEN {{'pos': pos, 'name': name}} END IGNORE NULLS) OVER w AS h{k}, max(CASE WHEN lvl < {k} THEN pos END) OVER w AS r{k}" for k in (1, 2, 3)) + f""" FROM b3 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
parsed AS (SELECT doc_id, pos, page, block_type, CASE WHEN block_type = 'heading' THEN {P._CLEAN} ELSE line END AS text, list_filter([""" + ", ".join(f"CASE WHEN h{k}.pos > coalesce(r{k}, -1) THEN h{k}.name END" for k in (1, 2, 3)) + """], lambda x: x IS NOT NULL) AS section_path, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM b4)"""


def parsed(t: Tables) -> DataFrame:
    return C.parsed(P.blocks(t))


def chunks(t: Tables) -> DataFrame:
    return C.chunked(C.units(parsed(t)))


@query("parse_blocks", f"{PARSED} SELECT * FROM parsed")
def parse_blocks(t: Tables) -> DataFrame:
    return parsed(t)


_U = f"""{PARSED}, u0 AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN {{'pos': pos, 'text': text, 'path': section_path, 'at': char_start}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM parsed),
u1 AS (SELECT *, h IS NOT NULL AND h.path = section_path AS fits FROM u0 WHERE block_type <> 'heading'),
u2 AS (SELECT *, fits AND row_number() OVER (PARTITION BY doc_id, h.pos ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, pos) = 1 AS takes FROM u1),
units AS (SELECT doc_id, pos, page, block_type, CASE WHEN takes THEN h.text || chr(10) || chr(10) || text ELSE text END AS text, CASE WHEN takes THEN h.at ELSE char_start END AS char_start, char_end FROM u2
  UNION ALL SELECT p.doc_id, p.pos, p.page, p.block_type, p.text, p.char_start, p.char_end FROM parsed p WHERE block_type = 'heading' AND NOT EXISTS (SELECT 1 FROM u2 WHERE takes AND u2.doc_id = p.doc_id AND u2.h.pos = p.pos))"""


@query("atomic_units", f"{_U} SELECT * FROM units")
def atomic_units(t: Tables) -> DataFrame:
    return C.units(parsed(t)).select("doc_id", "pos", "page", "block_type", "text", "char_start", "char_end")


@query("build_chunks")
def build_chunks(t: Tables) -> DataFrame:
    return chunks(t)


@query("force_flush")
def force_flush(t: Tables) -> DataFrame:
    return chunks(t).where("page_end > page_start AND length(text) >= 500").select("doc_id", "chunk_index", "page_start", "page_end")


@query("semantic_boundary", f"{PARSED}, x AS (SELECT *, lag(section_path) OVER w AS p, lag(block_type) OVER w AS k FROM parsed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos FROM x WHERE k IS NOT NULL AND ((len(p) > 0 AND len(section_path) > 0 AND p <> section_path) OR (k IN ('front_matter', 'contents', 'back_matter')) <> (block_type IN ('front_matter', 'contents', 'back_matter')))")
def semantic_boundary(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = parsed(t).withColumns({"p": F.lag("section_path").over(w), "k": F.lag("block_type").over(w)})
    flips = F.col("k").isin(*T.NON_BODY) != F.col("block_type").isin(*T.NON_BODY)
    apart = (F.size("p") > 0) & (F.size("section_path") > 0) & (F.col("p") != F.col("section_path"))
    return x.where(F.col("k").isNotNull() & (apart | flips)).select("doc_id", "pos")


@query("chunk_role", f"SELECT doc_id, CASE WHEN contains(lower(text), 'copyright') THEN 'front_matter' WHEN {P._CONTENTS.replace('(line', '(text').replace('line,', 'text,')} THEN 'contents' WHEN {P._INDEX.replace('(line', '(text').replace('line,', 'text,')} THEN 'back_matter' ELSE 'body' END AS role FROM (SELECT *, text AS line FROM documents WHERE text IS NOT NULL)")
def chunk_role(t: Tables) -> DataFrame:
    c = F.col("text")
    return t("documents").where("text IS NOT NULL").select("doc_id", F.when(F.contains(F.lower(c), F.lit("copyright")), "front_matter").when(T.looks_contents(c), "contents").when(T.looks_index(c), "back_matter").otherwise("body").alias("role"))


@query("chunk_id", f"WITH {_B} SELECT doc_id, pos, doc_id || ':c' || CASE WHEN pos < 10000 THEN lpad(CAST(pos AS VARCHAR), 4, '0') ELSE CAST(pos AS VARCHAR) END || ':' || substr(sha256(doc_id || '|' || pos || '|' || line), 1, 16) AS chunk_id FROM blocks")
def chunk_id(t: Tables) -> DataFrame:
    key = F.substring(F.sha2(F.concat_ws("|", "doc_id", "pos", "line"), 256), 1, 16)
    return P.blocks(t).select("doc_id", "pos", F.concat(F.col("doc_id").cast("string"), F.lit(":c"), F.when(F.col("pos") < 10000, F.lpad(F.col("pos").cast("string"), 4, "0")).otherwise(F.col("pos").cast("string")), F.lit(":"), key).alias("chunk_id"))


@query("chunk_links", f"WITH {_B} SELECT doc_id, pos, lag(line) OVER w AS before, lead(line) OVER w AS after FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def chunk_links(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return P.blocks(t).select("doc_id", "pos", F.lag("line").over(w).alias("before"), F.lead("line").over(w).alias("after"))


@query("section_title", f"{PARSED} SELECT doc_id, pos, CASE WHEN len(section_path) > 0 THEN section_path[-1] ELSE '' END AS section_title FROM parsed")
def section_title(t: Tables) -> DataFrame:
    return parsed(t).select("doc_id", "pos", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit("")).alias("section_title"))


@query("norm_page")
def norm_page(t: Tables) -> DataFrame:
    """Lines joined to paragraphs: a blank line or a heading ends one, a trailing hyphen joins words. What follows a line is told by it and the next."""
    lines = F.transform(F.split("text", "\n"), T.normalize_line)
    d = t("documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines")).withColumn("plain", F.transform("lines", lambda x: (x != "") & ~T.is_heading(x)))

    def shown(x: Column, i: Column) -> Column:
        goes_on = F.get("plain", i) & F.coalesce(F.get("plain", i + 1), F.lit(False))
        joined = F.when(F.endswith(x, F.lit("-")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" ")))
        return F.when(x == "", "").when(goes_on, joined).otherwise(F.concat(x, F.lit("\n\n")))

    return d.select("doc_id", F.rtrim(F.array_join(F.transform("lines", shown), ""), F.lit("\n")).alias("text"))


@query("syn_section", f"{PARSED} SELECT doc_id, array_to_string(section_path, '/') AS section, count(*) AS blocks, min(page) AS page_start, max(page) AS page_end, min(char_start) AS char_start, max(char_end) AS char_end, arg_min(text, pos) AS first_text, substr(sha256(doc_id || ':' || array_to_string(section_path[1:len(section_path) - 1], '/')), 1, 16) AS parent_id FROM parsed GROUP BY doc_id, section_path")
def syn_section(t: Tables) -> DataFrame:
    path = F.array_join("section_path", "/")
    parent = F.array_join(F.slice("section_path", F.lit(1), F.greatest(F.size("section_path") - 1, F.lit(0))), "/")
    g = parsed(t).groupBy("doc_id", path.alias("section"), parent.alias("parent")).agg(F.count("*").alias("blocks"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min_by("text", "pos").alias("first_text"))
    return g.withColumn("parent_id", F.substring(F.sha2(F.concat_ws(":", "doc_id", "parent"), 256), 1, 16)).drop("parent")


def _section_texts(t: Tables) -> DataFrame:
    """doc_id, section, texts: a section's texts in order."""
    b = parsed(t).select("doc_id", F.array_join("section_path", "/").alias("section"), "pos", "text")
    texts = F.sort_array(F.collect_list(F.struct("pos", "text")))  # part of one document
    return b.groupBy("doc_id", "section").agg(F.transform(texts, lambda x: x["text"]).alias("texts"))


@query("syn_text")
def syn_text(t: Tables) -> DataFrame:
    return C.synopses(_section_texts(t), ["doc_id", "section"], "texts")


@query("syn_document")
def syn_document(t: Tables) -> DataFrame:
    """The synopsis of a document's section synopses, in the order of the sections' names."""
    sections = F.sort_array(F.collect_list(F.struct("section", "texts")))
    g = _section_texts(t).groupBy("doc_id").agg(F.transform(sections, lambda x: x["texts"]).alias("sections"))
    return C.synopses(g, ["doc_id"], "sections", parts=4, budget=960)


@query("syn_for_chunks", f"{PARSED}, s AS (SELECT doc_id, section_path, min(pos) AS first_pos FROM parsed GROUP BY 1, 2) SELECT p.doc_id, p.pos, s.first_pos FROM parsed p JOIN s ON p.doc_id = s.doc_id AND p.section_path = s.section_path")
def syn_for_chunks(t: Tables) -> DataFrame:
    b = parsed(t).select("doc_id", "pos", "section_path")
    s = b.groupBy("doc_id", "section_path").agg(F.min("pos").alias("first_pos"))
    return b.join(s, ["doc_id", "section_path"]).select("doc_id", "pos", "first_pos")
