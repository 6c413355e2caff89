"""Registered queries: source preparation, normalisation and block classification over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.functions import text as T
from stratalode.plans.catalog import Tables, query

#: Lines of a document that stand for one page.
PAGE_LINES = 4


def n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def w(c: str) -> str:
    return n(c, r"[\p{L}\p{N}_]+")


def strip(c: str) -> str:
    return f"trim({c}, E' \\t\\n\\x0b\\f\\r')"


def squeeze(c: str) -> str:
    return rf"regexp_replace({c}, '\s+', ' ', 'g')"


def starts(c: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in parts) + ")"


def has(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


BLOCKS_SQL = f"""blocks AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, CAST(1 + (k - 1) // {PAGE_LINES} AS INTEGER) AS page, lines[k] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS t(k))"""


def blocks(t: Tables) -> DataFrame:
    """doc_id, pos, page, line: the documents' lines as parsed blocks."""
    split = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("doc_id", "pos", (F.floor(F.col("pos") / PAGE_LINES) + 1).cast("int").alias("page"), "line")


_CONTENTS = rf"""({starts(strip('lower(line)'), T.CONTENTS_STARTS)} OR (NOT ({w('line')} >= 60 AND regexp_matches(line, '[.!?]')) AND (
  {n('line', r'\b[0-9]+\.\s+[A-Za-z]')} >= 5 OR {n('line', r'\.{2,}\s*[0-9]{1,4}\b')} >= 3 OR {n('lower(line)', r'\b[ivxlcdm]+\.\s+[a-z]')} >= 5
  OR (({n('line', r'\b[0-9]+\.\s+[A-Za-z]')} >= 3 OR {n('lower(line)', r'\b[ivxlcdm]+\.\s+[a-z]')} >= 3)
      AND len(list_filter(regexp_split_to_array(line, '\n+'), lambda x: length({strip('x')}) > 0 AND {n('x', r'\S+')} <= 12)) >= 4 AND {w('line')} <= 120))))"""
_INDEX = rf"(starts_with({strip('lower(line)')}, 'index') OR ({n('line', r'\b[0-9]{1,4}\b')} >= 5 AND {n('line', ',')} >= 3 AND {n('line', r'\S+')} <= 120))"
_CAPITAL = r"""len(list_filter(regexp_extract_all(line, '[A-Za-z][A-Za-z''\-]*'), lambda x: regexp_matches(x, '^[A-Z]')))"""
_PARTS = r"""len(regexp_extract_all(line, '[A-Za-z][A-Za-z''\-]*'))"""
_HEADING = rf"""(length(line) <= 120 AND NOT (regexp_matches(line, '[.!?]\s*$') AND {n('line', r'\S+')} > 4) AND {n('line', '[A-Za-z]')} >= 4
  AND (10 * {n('line', '[A-Z]')} > 8 * {n('line', '[A-Za-z]')} OR ({_PARTS} > 0 AND {_PARTS} <= 10 AND NOT regexp_matches(line, '[0-9]')
       AND 10 * {_CAPITAL} >= 8 * {_PARTS} AND NOT regexp_matches(line, '[,;:]'))))"""
CLASS_SQL = rf"""CASE WHEN {has('lower(line)', T.FRONT_MARKERS)} THEN 'front_matter'
  WHEN {has('lower(line)', T.BACK_MARKERS)} OR (page > 200 AND contains(lower(line), 'catalogue')) THEN 'back_matter'
  WHEN {_CONTENTS} THEN 'contents' WHEN {_INDEX} THEN 'back_matter' WHEN {_HEADING} THEN 'heading'
  WHEN regexp_matches(line, '^\s*[-*]\s+') THEN 'list' ELSE 'paragraph' END"""
_RAW = f"trim({squeeze('line')}, ' .:-')"
_CLEAN = f"(CASE WHEN {_RAW} = upper({_RAW}) AND regexp_matches({_RAW}, '[A-Za-z]') THEN array_to_string(list_transform(string_split(lower({_RAW}), ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE {_RAW} END)"


@query("prep_sanitize", "SELECT doc_id, replace(text, chr(0), '') AS text FROM documents")
def prep_sanitize(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.sanitize(F.col("text")).alias("text"))


@query("dedup_content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def dedup_content_hash(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"))


@query("dedup_find_existing", "SELECT d.doc_id, m.existing FROM documents d LEFT JOIN (SELECT source, text, max(doc_id) AS existing FROM documents GROUP BY source, text) m ON d.source = m.source AND d.text = m.text")
def dedup_find_existing(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    newest = d.groupBy("source", "hash").agg(F.max("doc_id").alias("existing"))
    return d.join(newest, ["source", "hash"], "left").select("doc_id", "existing")


@query("dedup_supersede", "SELECT max(doc_id) AS doc_id, count(*) AS versions FROM documents GROUP BY sha256(text)")
def dedup_supersede(t: Tables) -> DataFrame:
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("versions")).drop("h")


@query("prep_source", r"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN NULL ELSE regexp_replace(trim(text, E' \t\n\x0b\f\r'), '\s+', ' ', 'g') END AS normalized, CAST(length(text) AS INTEGER) AS raw_chars FROM documents")
def prep_source(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.squeeze(T.strip(F.nullif(F.col("text"), F.lit("")))).alias("normalized"), F.length("text").alias("raw_chars"))


@query("id_register", "SELECT substr(sha256(source || '|' || text), 1, 32) AS document_id, min(doc_id) AS doc_id, 'registered' AS status, count(*) AS sources FROM documents GROUP BY source, text")
def id_register(t: Tables) -> DataFrame:
    key = F.substring(F.sha2(F.concat_ws("|", "source", "text"), 256), 1, 32)
    return t("documents").groupBy(key.alias("document_id")).agg(F.min("doc_id").alias("doc_id"), F.lit("registered").alias("status"), F.count("*").alias("sources"))


@query("ver_input", "SELECT doc_id, concat_ws('|', 'v1', lang, source, sha256(text)) AS input_version FROM documents")
def ver_input(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.concat_ws("|", F.lit("v1"), "lang", "source", F.sha2("text", 256)).alias("input_version"))


@query("class_infer", "SELECT page_id, CASE WHEN contains(lower(url), '.pdf') THEN 'book' WHEN contains(lower(url), 'manual') THEN 'manual' WHEN contains(lower(url), 'article') THEN 'article' WHEN contains(lower(url), 'research') OR contains(lower(url), 'paper') THEN 'research_paper' WHEN contains(lower(url), 'experience') THEN 'experience' ELSE 'note' END AS document_class FROM pages")
def class_infer(t: Tables) -> DataFrame:
    u = F.lower("url")
    has_ = lambda x: F.contains(u, F.lit(x))
    return t("pages").select("page_id", F.when(has_(".pdf"), "book").when(has_("manual"), "manual").when(has_("article"), "article").when(has_("research") | has_("paper"), "research_paper").when(has_("experience"), "experience").otherwise("note").alias("document_class"))


_FRONT_HITS = " + ".join(f"(length(low) - length(replace(low, '{m}', ''))) // {len(m)}" for m in T.FRONT_MARKERS)


@query("metrics_extraction", rf"""WITH d AS (SELECT doc_id, text, lower(text) AS low, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, CAST(len(p) AS INTEGER) AS pages, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(p, lambda x: length({strip('x')}) = 0)) AS INTEGER) AS empty_pages,
  CAST(len(list_filter(p, lambda x: length({strip('x')}) > 0 AND {w('x')} <= 10)) AS INTEGER) AS suspicious_pages, CAST({_FRONT_HITS} AS INTEGER) AS front_hits,
  round(CAST(list_sum(list_transform(p, lambda x: length({strip('x')}))) AS DOUBLE) / greatest(len(p), 1), 2) AS avg_chars FROM d WHERE text IS NOT NULL""")
def metrics_extraction(t: Tables) -> DataFrame:
    d = t("documents").where("text IS NOT NULL").select("doc_id", "text", F.lower("text").alias("low"), F.split("text", "\n").alias("p"))
    hits = sum((F.floor((F.length("low") - F.length(F.replace("low", F.lit(m), F.lit("")))) / len(m)) for m in T.FRONT_MARKERS), F.lit(0))
    size = F.aggregate(F.transform("p", lambda x: F.length(T.strip(x))), F.lit(0), lambda s, x: s + x)
    return d.select(
        "doc_id", F.size("p").alias("pages"), F.length("text").alias("chars"), F.size(F.filter("p", lambda x: F.length(T.strip(x)) == 0)).alias("empty_pages"),
        F.size(F.filter("p", lambda x: (F.length(T.strip(x)) > 0) & (T.words(x) <= 10))).alias("suspicious_pages"), hits.cast("int").alias("front_hits"),
        F.round(size / F.greatest(F.size("p"), F.lit(1)), 2).alias("avg_chars"),
    )


@query("norm_text", rf"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(12)), lambda x: {strip(squeeze('x'))}), lambda x: x <> ''), chr(12)) AS text FROM documents WHERE text IS NOT NULL")
def norm_text(t: Tables) -> DataFrame:
    pages = F.filter(F.transform(F.split("text", "\f"), lambda x: T.strip(T.squeeze(x))), lambda x: x != "")
    return t("documents").where("text IS NOT NULL").select("doc_id", F.array_join(pages, "\f").alias("text"))


@query("norm_line", rf"""WITH {BLOCKS_SQL}, a AS (SELECT doc_id, pos, replace(replace(replace({strip("replace(line, chr(0), '')")}, chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl') AS x FROM blocks),
b AS (SELECT doc_id, pos, regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g') AS x FROM a),
c AS (SELECT doc_id, pos, regexp_replace(regexp_replace(x, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') AS x FROM b),
d AS (SELECT doc_id, pos, regexp_replace(regexp_replace(x, '([0-9])([A-Za-z])', '\1 \2', 'g'), '([.,;:!?])([A-Za-z])', '\1 \2', 'g') AS x FROM c),
e AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(x, '([A-Za-z])([(\[])', '\1 \2', 'g'), '([)\]])([A-Za-z])', '\1 \2', 'g'), '(")([A-Za-z])', '\1 \2', 'g') AS x FROM d)
SELECT doc_id, pos, {squeeze('x')} AS line FROM e""")
def norm_line(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", "pos", T.normalize_line(F.col("line")).alias("line"))


@query("is_heading", f"WITH {BLOCKS_SQL} SELECT doc_id, pos, {_HEADING} AS heading FROM blocks")
def is_heading(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", "pos", T.is_heading(F.col("line")).alias("heading"))


@query("looks_contents", f"WITH b AS (SELECT doc_id, text AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_CONTENTS} AS contents FROM b")
def looks_contents(t: Tables) -> DataFrame:
    return t("documents").where("text IS NOT NULL").select("doc_id", T.looks_contents(F.col("text")).alias("contents"))


@query("looks_index", f"WITH b AS (SELECT doc_id, text AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_INDEX} AS index_like FROM b")
def looks_index(t: Tables) -> DataFrame:
    return t("documents").where("text IS NOT NULL").select("doc_id", T.looks_index(F.col("text")).alias("index_like"))


@query("classify_block", f"WITH {BLOCKS_SQL} SELECT doc_id, pos, {CLASS_SQL} AS block_type FROM blocks")
def classify_block(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", "pos", T.classify_block(F.col("line"), F.col("page")).alias("block_type"))


_LEVEL = rf"""(CASE WHEN {_RAW} = upper({_RAW}) AND regexp_matches({_RAW}, '[A-Za-z]') AND {w(_CLEAN)} <= 5 THEN CASE WHEN page <= 20 THEN 1 ELSE 2 END
  WHEN {n(_CLEAN, '[A-Za-z]+')} > 0 AND len(list_filter(regexp_extract_all({_CLEAN}, '[A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]*'))) = {n(_CLEAN, '[A-Za-z]+')} AND {w(_CLEAN)} <= 6 THEN 2 ELSE 3 END)"""


@query("heading_level", f"WITH {BLOCKS_SQL} SELECT doc_id, pos, CAST({_LEVEL} AS INTEGER) AS level FROM blocks WHERE {_HEADING}")
def heading_level(t: Tables) -> DataFrame:
    return blocks(t).where(T.is_heading(F.col("line"))).select("doc_id", "pos", T.heading_level(F.col("line"), F.col("page")).alias("level"))


@query("normalize_heading", f"WITH {BLOCKS_SQL} SELECT doc_id, pos, {_CLEAN} AS heading FROM blocks WHERE {_HEADING}")
def normalize_heading(t: Tables) -> DataFrame:
    return blocks(t).where(T.is_heading(F.col("line"))).select("doc_id", "pos", T.normalize_heading(F.col("line")).alias("heading"))


@query("page_role", rf"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, page, pos, line, {CLASS_SQL} AS kind, {_HEADING} AS heading, ({_CONTENTS} OR {_INDEX}) AS listed, {n('line', r'\S+')} AS tokens, {w('line')} AS words,
  {has('lower(line)', T.FRONT_MARKERS)} AS front, {has('lower(line)', T.BACK_MARKERS)} AS back FROM blocks WHERE length({strip('line')}) > 0),
g AS (SELECT doc_id, page, bool_or(front) AS front, bool_or(back) AS back, count(*) AS n, count(*) FILTER (tokens <= 12) AS short, count(*) FILTER (heading) AS headings, count(*) FILTER (listed) AS listed,
  count(*) FILTER (tokens >= 35 AND NOT listed) AS long, sum(words) AS words, {starts("lower(arg_min(line, pos))", T.CONTENTS_STARTS)} AS starts FROM b GROUP BY doc_id, page)
SELECT doc_id, page, CASE WHEN front THEN 'front_matter' WHEN back THEN 'back_matter' WHEN starts AND listed >= 1 AND page <= 40 THEN 'contents'
  WHEN page <= 40 AND listed >= 3 AND long = 0 AND words <= 220 THEN 'contents' WHEN page <= 30 AND n >= 7 AND short >= greatest(5, (n * 2) // 3) AND headings >= 4 AND long = 0 AND words <= 180 THEN 'contents' ELSE 'body' END AS role FROM g""")
def page_role(t: Tables) -> DataFrame:
    c = F.col("line")
    b = blocks(t).where(F.length(T.strip(c)) > 0)
    listed = T.looks_contents(c) | T.looks_index(c)
    g = b.groupBy("doc_id", "page").agg(
        F.bool_or(T.any_of(F.lower(c), T.FRONT_MARKERS)).alias("front"), F.bool_or(T.any_of(F.lower(c), T.BACK_MARKERS)).alias("back"), F.count("*").alias("n"),
        F.count_if(T.tokens(c) <= 12).alias("short"), F.count_if(T.is_heading(c)).alias("headings"), F.count_if(listed).alias("listed"),
        F.count_if((T.tokens(c) >= 35) & ~listed).alias("long"), F.sum(T.words(c)).alias("words"), T.starts_any(F.lower(F.min_by("line", "pos")), T.CONTENTS_STARTS).alias("starts"),
    )
    role = (
        F.when(F.col("front"), "front_matter").when(F.col("back"), "back_matter").when(F.expr("starts AND listed >= 1 AND page <= 40"), "contents")
        .when(F.expr("page <= 40 AND listed >= 3 AND long = 0 AND words <= 220"), "contents")
        .when(F.expr("page <= 30 AND n >= 7 AND short >= greatest(5, (n * 2) div 3) AND headings >= 4 AND long = 0 AND words <= 180"), "contents").otherwise("body")
    )
    return g.select("doc_id", "page", role.alias("role"))


_SECTION = "CASE " + " ".join(f"WHEN starts_with(lower(line), '{m}') THEN '{m.title()}'" for m in T.LEADING_SECTIONS) + " END"


@query("leading_section", f"WITH {BLOCKS_SQL} SELECT doc_id, pos, {_SECTION} AS section FROM blocks")
def leading_section(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", "pos", T.leading_section(F.col("line")).alias("section"))


@query("merge_page_text", "SELECT doc_id, pos, page, CASE WHEN nxt IS NULL OR nxt = '' THEN line WHEN contains(line, nxt) THEN line WHEN contains(nxt, line) THEN nxt ELSE line || chr(10) || chr(10) || nxt END AS merged FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM (WITH " + BLOCKS_SQL + " SELECT * FROM blocks))")
def merge_page_text(t: Tables) -> DataFrame:
    b = blocks(t).withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos")))
    line, nxt = F.col("line"), F.col("nxt")
    merged = F.when(nxt.isNull() | (nxt == ""), line).when(F.contains(line, nxt), line).when(F.contains(nxt, line), nxt).otherwise(F.concat(line, F.lit("\n\n"), nxt))
    return b.select("doc_id", "pos", "page", merged.alias("merged"))


@query("asset_search_text", "SELECT page_id, CASE WHEN length(concat_ws(chr(10), url, 'page ' || page_id, substr(html, 1, 60))) < 24 THEN 'untitled' ELSE concat_ws(chr(10), url, 'page ' || page_id, substr(html, 1, 60)) END AS search_text FROM pages")
def asset_search_text(t: Tables) -> DataFrame:
    joined = F.concat_ws("\n", "url", F.concat(F.lit("page "), "page_id"), F.substring("html", 1, 60))
    return t("pages").select("page_id", F.when(F.length(joined) < 24, "untitled").otherwise(joined).alias("search_text"))


@query("reference_keys", r"SELECT doc_id, list_transform(regexp_extract_all(lower(text), '(?:version|page|fig|table|by)[ .]+[0-9]+'), lambda x: regexp_replace(x, '[ .]+', ':')) AS keys FROM documents")
def reference_keys(t: Tables) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("((?:version|page|fig|table|by)[ .]+[0-9]+)"), 1)
    return t("documents").select("doc_id", F.transform(found, lambda x: F.regexp_replace(x, "[ .]+", ":")).alias("keys"))


@query("should_enrich_page", "SELECT page_id, length(html) < 700 OR contains(lower(html), 'figure') OR (length(html) - length(replace(html, '<img', ''))) // 4 >= 1 AS enrich FROM pages")
def should_enrich_page(t: Tables) -> DataFrame:
    images = F.floor((F.length("html") - F.length(F.replace("html", F.lit("<img"), F.lit("")))) / 4)
    return t("pages").select("page_id", ((F.length("html") < 700) | F.contains(F.lower("html"), F.lit("figure")) | (images >= 1)).alias("enrich"))


@query("token_count", f"SELECT doc_id, CAST({w('text')} AS INTEGER) AS token_count FROM documents")
def token_count(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.words(F.col("text")).alias("token_count"))


_TERMS = r"list_distinct(list_concat([source], regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)*')[1:6]))"


@query("surface_terms", f"SELECT doc_id, list_sort({_TERMS}) AS terms FROM documents")
def surface_terms(t: Tables) -> DataFrame:
    found = F.slice(F.regexp_extract_all("text", F.lit("(\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1), 1, 6)
    return t("documents").select("doc_id", F.array_sort(F.array_distinct(F.concat(F.array("source"), found))).alias("terms"))


@query("canonical_terms", f"SELECT doc_id, list_sort(list_distinct(list_transform({_TERMS}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_')))) AS terms FROM documents")
def canonical_terms(t: Tables) -> DataFrame:
    found = F.slice(F.regexp_extract_all("text", F.lit("(\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1), 1, 6)
    slug = F.transform(F.concat(F.array("source"), found), lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_")))
    return t("documents").select("doc_id", F.array_sort(F.array_distinct(slug)).alias("terms"))


@query("doc_title", f"WITH {BLOCKS_SQL}, h AS (SELECT doc_id, arg_min(line, pos) AS title FROM blocks WHERE pos < 10 AND {_HEADING} GROUP BY doc_id) SELECT d.doc_id, coalesce(title, source) AS title FROM documents d LEFT JOIN h USING (doc_id)")
def doc_title(t: Tables) -> DataFrame:
    first = blocks(t).where((F.col("pos") < 10) & T.is_heading(F.col("line"))).groupBy("doc_id").agg(F.min_by("line", "pos").alias("title"))
    return t("documents").join(first, "doc_id", "left").select("doc_id", F.coalesce("title", "source").alias("title"))
