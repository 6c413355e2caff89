"""Registered queries: ontology closure, tagging, extraction, canonical names, validation and pruning over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.operators import extraction as X
from stratalode.operators import knowledge as K
from stratalode.plans.catalog import Chosen, Tables, query
from stratalode.session import shared_path

_CLASSES = "classes(name, parent) AS (VALUES " + ", ".join(f"('{c}', {f"'{p}'" if p else 'NULL'})" for c, p, _ in K.CLASSES) + ")"
_ROWS = sorted({(c, a) for c, _, ws in K.CLASSES for a in (*ws, c.lower())} | {("NearPointer", "near pointer")})
_ALIASES = "aliases(name, alias) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in _ROWS) + ")"
_UP = f"{_CLASSES}, up(name, ancestor) AS (SELECT name, parent FROM classes WHERE parent IS NOT NULL UNION SELECT up.name, c.parent FROM up JOIN classes c ON c.name = up.ancestor WHERE c.parent IS NOT NULL)"
_NORMAL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
TAGS = f"""{_ALIASES}, w AS (SELECT doc_id, list_position(ws, alias) - 1 AS place, alias FROM (SELECT doc_id, ws, unnest(list_distinct(ws)) AS alias FROM (SELECT doc_id, string_split({_NORMAL}, ' ') AS ws FROM documents)
  UNION ALL SELECT doc_id, ws, unnest(list_distinct(ws)) FROM (SELECT doc_id, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS ws FROM (SELECT doc_id, string_split({_NORMAL}, ' ') AS ws FROM documents)))),
tags AS (SELECT doc_id, name, alias, CAST(place AS INTEGER) AS place FROM w JOIN aliases USING (alias))"""
ENTITIES = f"""{TAGS}, e AS (SELECT doc_id, name, arg_min(alias, place) AS alias, min(place) AS place FROM tags GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, name) AS INTEGER) AS rn FROM e)"""
_PREDICATES = "predicates(predicate, dom, ran, phrase) AS (VALUES " + ", ".join(f"('{p}', '{d}', '{r}', '{x}')" for p, d, r, x in K.PREDICATES) + ")"
RELATIONS = f"""WITH RECURSIVE {_UP}, {ENTITIES}, {_PREDICATES}, words AS (SELECT doc_id, string_split({_NORMAL}, ' ') AS ws FROM documents),
rel AS (SELECT a.doc_id, predicate, a.name AS subject, b.name AS object, {K.RELATION_CONFIDENCE}::DOUBLE AS confidence, dom, ran FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2 JOIN words w ON w.doc_id = a.doc_id JOIN predicates ON list_contains(ws, phrase)),
ok AS (SELECT name, ancestor FROM up UNION SELECT name, name FROM classes),
checked AS (SELECT rel.*, EXISTS (SELECT 1 FROM ok WHERE ok.name = subject AND ok.ancestor = dom) AS subject_ok, EXISTS (SELECT 1 FROM ok WHERE ok.name = object AND ok.ancestor = ran) AS object_ok FROM rel)"""


def entities(t: Tables) -> DataFrame:
    e = K.tag(t("documents"), t.spark).groupBy("doc_id", "name").agg(F.min_by("alias", "place").alias("alias"), F.min("place").alias("place"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "name")))


def closure(t: Tables) -> DataFrame:
    c = K.classes(t.spark)
    return K.ancestors(c).unionByName(c.select("name", F.col("name").alias("ancestor")))


def relations(t: Tables) -> DataFrame:
    """The first two entities of a document, linked by every predicate whose phrase the text holds, with type checks."""
    e = entities(t)
    pair = e.where("rn = 1").select("doc_id", F.col("name").alias("subject")).join(e.where("rn = 2").select("doc_id", F.col("name").alias("object")), "doc_id")
    rules = t.spark.createDataFrame(list(K.PREDICATES), "predicate string, dom string, ran string, phrase string")
    held = t("documents").select("doc_id", F.explode(F.array_distinct(F.split(K.normal(F.col("text")), " "))).alias("phrase")).join(F.broadcast(rules), "phrase")
    ok = closure(t).select(F.struct("name", "ancestor").alias("p"))
    known = ok.agg(F.collect_set("p").alias("known"))  # the ontology's closure
    out = pair.join(held, "doc_id").crossJoin(F.broadcast(known))
    test = lambda a, b: F.array_contains("known", F.struct(F.col(a).alias("name"), F.col(b).alias("ancestor")))
    return out.select("doc_id", "predicate", "subject", "object", F.lit(K.RELATION_CONFIDENCE).alias("confidence"), test("subject", "dom").alias("subject_ok"), test("object", "ran").alias("object_ok"))


@query("onto_ancestors", f"WITH RECURSIVE {_UP} SELECT name, ancestor FROM up")
def onto_ancestors(t: Tables) -> DataFrame:
    return K.ancestors(K.classes(t.spark))


@query("onto_compatible", f"WITH RECURSIVE {_UP}, ok AS (SELECT name, ancestor FROM up UNION SELECT name, name FROM classes) SELECT a.name AS actual, b.name AS expected, EXISTS (SELECT 1 FROM ok WHERE ok.name = a.name AND ok.ancestor = b.name) AS compatible FROM classes a, classes b")
def onto_compatible(t: Tables) -> DataFrame:
    c = K.classes(t.spark).select("name")
    pairs = c.withColumnRenamed("name", "actual").crossJoin(c.withColumnRenamed("name", "expected"))  # the ontology against itself
    ok = closure(t).select(F.col("name").alias("actual"), F.col("ancestor").alias("expected"), F.lit(True).alias("c"))
    return pairs.join(ok, ["actual", "expected"], "left").select("actual", "expected", F.coalesce("c", F.lit(False)).alias("compatible"))


@query("onto_aliases", f"WITH {_ALIASES} SELECT name, alias FROM aliases")
def onto_aliases(t: Tables) -> DataFrame:
    return K.aliases(t.spark)


@query("onto_tag", f"WITH {TAGS} SELECT doc_id, list_sort(list_distinct(list(name))) AS classes FROM tags GROUP BY doc_id")
def onto_tag(t: Tables) -> DataFrame:
    return K.tag(t("documents"), t.spark).groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("classes"))


_SURFACED = """(CASE p_partkey % 5 WHEN 0 THEN '"The ' || p_name || 's"' WHEN 1 THEN p_name || ' (no. ' || p_size || ')' WHEN 2 THEN 'An ' || p_name || '-berries' WHEN 3 THEN p_name || '/bus' ELSE p_name || ' Glass' END)"""
_PLAIN = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(replace(lower({_SURFACED}), chr(0), ''), '\(([^)]*)\)', ' \1 ', 'g'), '/-', '  '), '^["''`]+|["''`]+$', '', 'g'), '\b(the|a|an)\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
_SURFACE = "CASE WHEN ends_with(x, 'ies') AND length(x) > 4 THEN x[1:length(x) - 3] || 'y' WHEN ends_with(x, 'us') OR ends_with(x, 'is') THEN x WHEN ends_with(x, 's') AND length(x) > 3 AND NOT ends_with(x, 'ss') THEN x[1:length(x) - 1] ELSE x END"


@query("norm_entity", f"SELECT p_partkey, {_SURFACE} AS name FROM (SELECT p_partkey, {_PLAIN} AS x FROM part)")
def norm_entity(t: Tables) -> DataFrame:
    """Part names with articles, quotes, parentheses and plurals around them."""
    return t("part").select("p_partkey", K.surface(F.expr(_SURFACED)).alias("name"))


_SINGULAR = "CASE WHEN length(x) > 4 AND ends_with(x, 'ies') THEN x[1:length(x) - 3] || 'y' WHEN length(x) > 3 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN x[1:length(x) - 1] ELSE x END"


@query("norm_tokens", f"SELECT item_id, list_transform(string_split({_NORMAL}, ' '), lambda x: {_SINGULAR}) AS tokens FROM benchmark")
def norm_tokens(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.transform(F.split(K.normal(F.col("text")), " "), K.singular).alias("tokens"))


_TAILED = "(CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || p_size WHEN 1 THEN 'all ' || p_name WHEN 2 THEN p_name || ' of wood' WHEN 3 THEN p_name || ' items ' || p_size WHEN 4 THEN 'big ' || p_name ELSE p_name END)"
_GENERIC = "(" + ", ".join(f"'{w}'" for w in K.GENERIC_TAIL) + ")"


def _name_tokens(c: str) -> str:
    """SQL of K.name_tokens for names of letters, digits and spaces."""
    return f"list_transform(list_filter(string_split((SELECT {_SURFACE} FROM (SELECT trim(regexp_replace(regexp_replace(lower({c}), '\\b(the|a|an)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS x)), ' '), lambda x: x <> ''), lambda x: {_SINGULAR})"


_ONLY = f"len(list_filter({{0}}, lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN {_GENERIC})) = 0 AND len({{0}}) > 0"


@query("alias_generic_tail", f"WITH a AS (SELECT p_partkey, {_name_tokens(_TAILED)} AS n, {_name_tokens('p_name')} AS a FROM part) SELECT p_partkey, len(a) > 0 AND len(n) > len(a) AND ((n[1:len(a)] = a AND {_ONLY.format('n[len(a) + 1:]')}) OR (n[len(n) - len(a) + 1:] = a AND {_ONLY.format('n[1:len(n) - len(a)]')})) AS generic FROM a")
def alias_generic_tail(t: Tables) -> DataFrame:
    """Part names with words and numbers beside them, against the bare names as aliases."""
    return t("part").select("p_partkey", K.has_generic_tail(K.name_tokens(F.expr(_TAILED)), K.name_tokens(F.col("p_name"))).alias("generic"))


@query("canonicalize", f"WITH {ENTITIES} SELECT doc_id, name AS entity_type, alias AS surface, lower(name) || '_' || trim(regexp_replace(lower(alias), '[^a-z0-9]+', '_', 'g'), '_') AS canonical_key FROM o")
def canonicalize(t: Tables) -> DataFrame:
    return entities(t).select("doc_id", F.col("name").alias("entity_type"), F.col("alias").alias("surface"), K.entity_key(F.col("name"), F.col("alias")).alias("canonical_key"))


_SPACED = {c: "".join(f" {x}" if x.isupper() and k else x for k, x in enumerate(c)).lower() for c in K.LABELS}
_TOKEN = "CASE name " + " ".join(f"WHEN '{c}' THEN CASE WHEN contains(low, '{label.lower()}') THEN '{label.lower()}' WHEN contains(low, '{_SPACED[c]}') THEN '{_SPACED[c]}' END" for c, label in K.LABELS.items()) + " END"
_LABEL = "CASE name " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in K.LABELS.items()) + " END"


@query(
    "kg_extract_heuristic",
    f"""WITH {TAGS}, dl AS (SELECT doc_id, text, lower(text) AS low FROM documents), tk AS (SELECT doc_id, name, {_LABEL} AS label, {_TOKEN} AS token, low FROM (SELECT DISTINCT doc_id, name FROM tags) JOIN dl USING (doc_id)),
fe AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS n, strpos(low, token) - 1 AS start FROM tk WHERE token IS NOT NULL), ph(k, predicate, phrase) AS (VALUES {", ".join(f"({k}, '{p}', '{x}')" for k, (p, _, _, x) in enumerate(K.PREDICATES))}),
fr AS (SELECT doc_id, predicate, text, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM dl JOIN ph ON contains(low, phrase) WHERE doc_id IN (SELECT doc_id FROM fe WHERE n = 2))
SELECT doc_id, 'entity' AS kind, 'e' || n AS id, label AS a, name AS b, CAST(start AS INTEGER) AS first, CAST(start + length(token) AS INTEGER) AS last FROM fe UNION ALL SELECT doc_id, 'relation', 'r' || n, predicate, 'e1>e2', 0, length(substr(text, 1, {K.EXCERPT})) FROM fr""",
)
def kg_extract_heuristic(t: Tables) -> DataFrame:
    """What every document says without a model: entities by label, the first two linked by each phrase, with an excerpt."""
    found = K.heuristic(t("documents"), t.spark)
    e = found.select("doc_id", F.explode("entities").alias("x")).select("doc_id", F.lit("entity").alias("kind"), "x.id", F.col("x.name").alias("a"), F.col("x.type").alias("b"), F.col("x.start").alias("first"), F.col("x.end").alias("last"))
    r = found.select("doc_id", "excerpt", F.explode("relations").alias("x")).select("doc_id", F.lit("relation").alias("kind"), "x.id", F.col("x.predicate").alias("a"), F.concat_ws(">", "x.subject", "x.object").alias("b"), F.lit(0).alias("first"), F.length("excerpt").alias("last"))
    return e.unionByName(r)


@query("kg_input_augment", "SELECT o_orderkey, concat_ws(chr(10), o_orderpriority, array_to_string(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))[1:3], chr(10))) AS text FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority")
def kg_input_augment(t: Tables) -> DataFrame:
    parts = F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p")))), 1, 3)  # lines of one order
    per = t("lineitem").groupBy("l_orderkey").agg(parts.alias("parts"))
    return t("orders").join(per, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.concat_ws("\n", "o_orderpriority", F.array_join(F.transform("parts", lambda x: x["p"]), "\n")).alias("text"))


_RULES = (*((p, "object", d, r) for p, d, r, _ in K.PREDICATES), ("length", "datatype", "Word", "xsd:decimal"))
_RULES_SQL = "rules(predicate, kind, dom, ran) AS (VALUES " + ", ".join(str(r) for r in _RULES) + ")"
_MADE = f"""{RELATIONS.replace("WITH RECURSIVE", "WITH RECURSIVE " + _RULES_SQL + ",", 1)},
men AS (SELECT doc_id, 'm' || rn AS mention_id, CASE WHEN doc_id % 23 = 0 THEN '' ELSE alias END AS text FROM o WHERE rn <= 3),
ent AS (SELECT doc_id, 'e' || rn AS id, CASE WHEN doc_id % 10 = 0 AND rn = 1 THEN 'Thing' ELSE name END AS type, CASE WHEN doc_id % 7 = 0 AND rn = 2 THEN '' ELSE alias END AS name,
  CASE WHEN doc_id % 11 = 0 AND rn = 1 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 29 = 0 THEN ['m' || rn, 'm77'] ELSE ['m' || rn] END AS ms, CASE WHEN doc_id % 13 = 0 AND rn = 2 THEN 0.5 ELSE 0.82 END AS confidence FROM o WHERE rn <= 3),
rls AS (SELECT doc_id, 'r:' || predicate AS id, 'e1' AS subject, predicate, CASE WHEN doc_id % 9 = 0 THEN 'e9' ELSE 'e2' END AS object, CAST(NULL AS VARCHAR) AS literal, CASE WHEN doc_id % 17 = 0 THEN 0.3 ELSE 0.75 END AS confidence FROM rel
  UNION ALL SELECT doc_id, 'r:data', 'e1', CASE WHEN doc_id % 19 = 0 THEN 'weight' WHEN doc_id % 31 = 0 THEN 'names' ELSE 'length' END, CASE WHEN doc_id % 37 = 0 THEN 'e2' END, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'long' ELSE '12.5' END, 0.9 FROM documents),
evi AS (SELECT doc_id, 'v' || doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['r:data', 'r:names', 'r:joins'] END AS supports, CASE WHEN doc_id % 41 = 0 THEN '' ELSE 'shown' END AS excerpt FROM documents),
okay AS (SELECT name, ancestor FROM up UNION SELECT name, name FROM classes)"""


def _facts(entity: str, shows: str = "true") -> str:
    """SQL: the relations with all that their rules ask, over a table of entities; shows: what evidence must hold to count."""
    return f"""SELECT r.*, k.kind, k.dom, k.ran, s.type AS st, b.type AS ot, EXISTS (SELECT 1 FROM okay WHERE name = s.type AND ancestor = k.dom) AS sok, EXISTS (SELECT 1 FROM okay WHERE name = b.type AND ancestor = k.ran) AS ook,
  k.ran IN (SELECT name FROM classes) AS rc, EXISTS (SELECT 1 FROM evi v WHERE v.doc_id = r.doc_id AND list_contains(v.supports, r.id) AND {shows}) AS shown
  FROM rls r LEFT JOIN rules k USING (predicate) LEFT JOIN {entity} s ON s.doc_id = r.doc_id AND s.id = r.subject LEFT JOIN {entity} b ON b.doc_id = r.doc_id AND b.id = r.object"""


_BROKEN = """list_filter([CASE WHEN kind IS NULL THEN 'invalid_predicate:' || predicate END, CASE WHEN st IS NULL THEN 'missing_subject:' || id END, CASE WHEN object IS NOT NULL AND ot IS NULL THEN 'missing_object:' || id END,
  CASE WHEN object IS NULL AND literal IS NULL THEN 'missing_relation_object:' || id END, CASE WHEN confidence < 0.7 THEN 'low_relation_confidence:' || id END, CASE WHEN NOT shown THEN 'missing_evidence:' || id END,
  CASE WHEN st IS NOT NULL AND dom IS NOT NULL AND NOT sok THEN 'invalid_subject_type:' || id || ':' || st || '->' || dom END, CASE WHEN object IS NOT NULL AND kind = 'datatype' THEN 'invalid_object_candidate_for_datatype:' || id END,
  CASE WHEN object IS NOT NULL AND kind = 'object' AND ot IS NOT NULL AND rc AND NOT ook THEN 'invalid_object_type:' || id || ':' || ot || '->' || ran END, CASE WHEN object IS NULL AND literal IS NOT NULL AND kind = 'object' THEN 'invalid_literal_for_object_property:' || id END,
  CASE WHEN object IS NULL AND literal IS NOT NULL AND ran = 'xsd:decimal' AND TRY_CAST(literal AS DOUBLE) IS NULL THEN 'invalid_decimal_literal:' || id END], lambda x: x IS NOT NULL)"""


ONTOLOGY = X.Ontology({c: p for c, p, _ in K.CLASSES}, {p: rest for p, *rest in _RULES})


def extractions(t: Tables) -> DataFrame:
    """A row a document: mentions, entities, relations and evidence made from its tags, with breaches of the rules by number.

    Its text is read once, for aliases and phrases alike, and nothing is shuffled or joined.
    """
    every = lambda n: F.col("chunk_id") % n == 0
    rows = [tuple(r) for r in K.aliases(t.spark).collect()]  # the ontology
    asked = sorted({a for _, a in rows} | {x for *_, x in K.PREDICATES})
    a = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), K.heard(F.col("text"), asked).alias("heard"))
    phrases = F.transform("heard", lambda h: h["phrase"])
    said = F.array_compact(F.array(*(F.when(F.array_contains(phrases, x), F.lit(p)) for p, _, _, x in K.PREDICATES)))
    a = a.select("chunk_id", "document_id", said.alias("said"), K.tags(F.col("heard"), rows).alias("tags"))
    first = F.when(F.col("chunk_id").isNotNull(), F.slice(K.firsts(F.col("tags")), 1, 3))
    a = a.select("chunk_id", "document_id", "said", F.coalesce(first, F.array().cast("array<struct<rn:int,name:string,alias:string>>")).alias("es"))
    none, texts = F.lit(None).cast("string"), lambda *x: F.array(*x).cast("array<string>")
    own = lambda e: F.concat(F.lit("m"), e["rn"])
    ms = lambda e: F.when(every(11) & (e["rn"] == 1), texts()).when(every(29), texts(own(e), F.lit("m77"))).otherwise(texts(own(e)))
    mentions = F.transform("es", lambda e: F.struct(own(e).alias("mention_id"), F.when(every(23), "").otherwise(e["alias"]).alias("text")))
    ents = F.transform("es", lambda e: F.struct(F.concat(F.lit("e"), e["rn"]).alias("candidate_id"), F.when(every(10) & (e["rn"] == 1), "Thing").otherwise(e["name"]).alias("type"), F.when(every(7) & (e["rn"] == 2), "").otherwise(e["alias"]).alias("name"), ms(e).alias("mention_ids"), F.when(every(13) & (e["rn"] == 2), 0.5).otherwise(0.82).alias("confidence")))
    relation = lambda id_, predicate, object_, literal, sure: F.struct(id_.alias("relation_id"), F.lit("e1").alias("subject"), predicate.alias("predicate"), object_.alias("object"), literal.alias("literal"), sure.alias("confidence"))
    linked = F.transform("said", lambda p: relation(F.concat(F.lit("r:"), p), p, F.when(every(9), "e9").otherwise("e2"), none, F.when(every(17), 0.3).otherwise(0.75)))
    value = F.when(F.col("chunk_id") % 4 == 0, none).when(F.col("chunk_id") % 4 == 1, "long").otherwise("12.5")
    data = relation(F.lit("r:data"), F.when(every(19), "weight").when(every(31), "names").otherwise("length"), F.when(every(37), "e2"), value, F.lit(0.9))
    supports = F.when(every(6), texts()).otherwise(texts(F.lit("r:data"), F.lit("r:names"), F.lit("r:joins")))
    evidence = F.array(F.struct(F.concat(F.lit("v"), "chunk_id").alias("evidence_id"), supports.alias("supports"), F.when(every(41), "").otherwise("shown").alias("excerpt")))
    relations_ = F.concat(F.when(F.size("es") >= 2, linked).otherwise(F.filter(linked, lambda _: F.lit(False))), F.array(data))
    return a.select("chunk_id", "document_id", mentions.alias("mentions"), ents.alias("entities"), relations_.alias("relations"), evidence.alias("evidence"))


def raw_payloads(t: Tables) -> DataFrame:
    """The extractions as a model returns them: JSON, for every 53rd document an error and for every 59th a text cut off."""
    payload = F.to_json(F.struct(*X.PARTS))
    broken = F.when(F.col("chunk_id") % 59 == 0, F.substr(payload, F.lit(1), F.length(payload) - 2)).otherwise(payload)
    return extractions(t).select("chunk_id", "document_id", F.when(F.col("chunk_id") % 53 != 0, broken).alias("payload"), F.when(F.col("chunk_id") % 53 == 0, "timeout").alias("error"))


def judged(t: Tables) -> DataFrame:
    """Statuses and pruned extractions, written once for all that is derived from them."""
    path = shared_path(t.spark, "judged-extractions")
    X.judge(X.read_payloads(raw_payloads(t)), ONTOLOGY).write.parquet(path)
    return t.spark.read.parquet(path)


_GOOD = """heard AS (SELECT doc_id, list(mention_id) AS hs FROM men WHERE text <> '' GROUP BY 1),
good AS (SELECT e.doc_id, id, type, name, list_intersect(ms, hs) AS ms FROM ent e JOIN heard USING (doc_id) WHERE type IN (SELECT name FROM classes) AND e.name <> '' AND e.confidence >= 0.7 AND len(list_intersect(ms, hs)) > 0)"""
_PRUNED = f"""{_MADE}, {_GOOD}, f AS ({_facts('good', "v.excerpt <> ''")}), kept AS (SELECT doc_id, id, subject, predicate, object, literal FROM f WHERE len({_BROKEN}) = 0),
kept_e AS (SELECT DISTINCT g.doc_id, g.id, g.type, g.name, g.ms FROM good g JOIN kept k ON k.doc_id = g.doc_id AND g.id IN (k.subject, k.object)),
kept_v AS (SELECT DISTINCT v.doc_id, v.id, v.excerpt FROM evi v JOIN kept k ON k.doc_id = v.doc_id AND list_contains(v.supports, k.id) WHERE v.excerpt <> '')"""


@query("kg_prune", f"{_PRUNED} SELECT doc_id AS chunk_id, 'relation' AS kind, id FROM kept UNION ALL SELECT doc_id, 'entity', id FROM kept_e UNION ALL SELECT doc_id, 'evidence', id FROM kept_v UNION ALL SELECT DISTINCT m.doc_id, 'mention', mention_id FROM men m JOIN kept_e e ON e.doc_id = m.doc_id AND list_contains(e.ms, m.mention_id) WHERE m.text <> ''")
def kg_prune(t: Tables) -> DataFrame:
    """What is left of every extraction, in one pass over its arrays."""
    ids = lambda part, key, kind: F.transform(part, lambda x: F.struct(F.lit(kind).alias("kind"), x[key].alias("id")))
    left = F.concat(ids("relations", "relation_id", "relation"), ids("entities", "candidate_id", "entity"), ids("evidence", "evidence_id", "evidence"), ids("mentions", "mention_id", "mention"))
    return X.prune(extractions(t), ONTOLOGY).select("chunk_id", F.inline(left))


@query(
    "kg_validate",
    f"""{_MADE}, f AS ({_facts('ent')}), known AS (SELECT doc_id, list(mention_id) AS hs FROM men GROUP BY 1)
SELECT doc_id AS chunk_id, 'empty_mention_text:' || mention_id AS error FROM men WHERE text = ''
UNION ALL SELECT doc_id, 'invalid_entity_type:' || type FROM ent WHERE type NOT IN (SELECT name FROM classes) UNION ALL SELECT doc_id, 'empty_entity_name:' || id FROM ent WHERE name = ''
UNION ALL SELECT doc_id, 'missing_mentions:' || id FROM ent WHERE len(ms) = 0 UNION ALL SELECT doc_id, 'low_entity_confidence:' || id FROM ent WHERE confidence < 0.7
UNION ALL SELECT doc_id, 'unknown_mention:' || id || ':' || m FROM (SELECT doc_id, id, unnest(ms) AS m FROM ent) JOIN known USING (doc_id) WHERE NOT list_contains(hs, m)
UNION ALL SELECT doc_id, unnest({_BROKEN}) FROM f
UNION ALL SELECT doc_id, 'orphan_evidence:' || id FROM evi WHERE len(supports) = 0 UNION ALL SELECT doc_id, 'empty_evidence_excerpt:' || id FROM evi WHERE excerpt = ''""",
)
def kg_validate(t: Tables) -> DataFrame:
    # exploding the column itself would bring a filter on its size, which goes below all steps and makes each of them anew for every mention
    return X.violations(extractions(t), ONTOLOGY).select("chunk_id", F.explode(F.array_compact("errors")).alias("error"))


_FAILED = "(doc_id % 53 = 0 OR doc_id % 59 = 0)"
_STATUS = f"st AS (SELECT doc_id, source, CASE WHEN {_FAILED} THEN 'quarantined' WHEN doc_id IN (SELECT doc_id FROM kept) THEN 'validated' ELSE 'skipped' END AS status FROM documents)"


@query("kg_status", f"{_PRUNED}, {_STATUS} SELECT doc_id AS chunk_id, status FROM st")
def kg_status(t: Tables) -> DataFrame:
    """The status of every extraction; what the extractor failed on, or returned in pieces, is quarantined."""
    return X.judge(X.read_payloads(raw_payloads(t)), ONTOLOGY).select("chunk_id", "status")


_KEY = "lower(type) || '_' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_')"


@query(
    "kg_persist",
    f"""{_PRUNED}, {_STATUS}, ke AS (SELECT e.*, {_KEY} AS key, source, CAST(substr(e.id, 2) AS BIGINT) + 10 * e.doc_id AS place FROM kept_e e JOIN st USING (doc_id) WHERE status = 'validated'), kr AS (SELECT k.*, source, k.doc_id || ':' || k.id AS aid FROM kept k JOIN st USING (doc_id) WHERE status = 'validated')
SELECT 'entity' AS kind, key AS id, arg_min(source, place) AS document, arg_max(name, place) AS a, arg_max(type, place) AS b, NULL AS c FROM ke GROUP BY key
UNION ALL SELECT 'assertion', aid, kr.source, s.key, predicate, coalesce(o.key, literal) FROM kr JOIN ke s ON s.doc_id = kr.doc_id AND s.id = kr.subject LEFT JOIN ke o ON o.doc_id = kr.doc_id AND o.id = kr.object
UNION ALL SELECT 'evidence', aid || ':' || v.id, NULL, aid, v.excerpt, NULL FROM kr JOIN evi v ON v.doc_id = kr.doc_id AND list_contains(v.supports, kr.id) AND v.excerpt <> ''""",
)
def kg_persist(t: Tables) -> DataFrame:
    """The graph's three tables from one pass over judged extractions: entities of which the last name wins, assertions, evidence."""
    g = X.graph_tables(judged(t))
    none = F.lit(None).cast("string")
    e = g["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("source").alias("document"), F.col("canonical_name").alias("a"), F.col("entity_type").alias("b"), none.alias("c"))
    a = g["assertions"].select(F.lit("assertion").alias("kind"), F.col("assertion_id").alias("id"), F.col("document_id").alias("document"), F.col("subject_entity_id").alias("a"), F.col("predicate").alias("b"), F.coalesce("object_entity_id", "object_literal").alias("c"))
    v = g["evidence"].select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"), none.alias("document"), F.col("assertion_id").alias("a"), F.col("excerpt").alias("b"), none.alias("c"))
    return e.unionByName(a).unionByName(v)


@query("kg_reprocess", f"{_PRUNED}, {_STATUS}, ag AS (SELECT status AS was, CASE WHEN status <> 'quarantined' THEN status WHEN doc_id % 106 = 0 THEN 'quarantined' WHEN doc_id IN (SELECT doc_id FROM kept) THEN 'validated' ELSE 'skipped' END AS status FROM st) SELECT was, status, count(*) AS chunks FROM ag GROUP BY 1, 2")
def kg_reprocess(t: Tables) -> DataFrame:
    """Quarantined chunks are extracted again, which every other one of those with an error fails again; the rest isn't touched."""
    before = judged(t)
    failed = before.where("status = 'quarantined'").select(F.col("chunk_id").alias("doc_id"))
    again = extractions(Chosen(t, failed)).select("chunk_id", "document_id", F.to_json(F.struct(*X.PARTS)).alias("payload"), F.when(F.col("chunk_id") % 106 == 0, "timeout").alias("error"))
    after = X.replay(before, again, ONTOLOGY)
    return before.select("chunk_id", F.col("status").alias("was")).join(after.select("chunk_id", "status"), "chunk_id").groupBy("was", "status").agg(F.count("*").alias("chunks"))


_UPPER = "translate(w[3], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_CANDIDATES = f"""WITH b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT item_id, text, trim(coalesce({_UPPER}, '')) AS shout, coalesce(w[1], '') AS one, coalesce(w[2], '') AS two FROM b)
SELECT item_id, 'mention' AS kind, 'm1' AS id, shout AS name, 'Word' AS type,
  CASE WHEN shout <> '' AND contains(lower(text), lower(shout)) THEN CAST(strpos(lower(text), lower(shout)) - 1 AS INTEGER) END AS start,
  CASE WHEN shout <> '' AND contains(lower(text), lower(shout)) THEN CAST(strpos(lower(text), lower(shout)) - 1 + length(shout) AS INTEGER) END AS end, '' AS links, NULL::VARCHAR AS literal, CAST(least(1.0, greatest(0.0, item_id / 10.0)) AS DOUBLE) AS confidence FROM c
UNION ALL SELECT item_id, 'mention', 'own', one, 'Unknown', 0, 3, '', NULL, 0.4::DOUBLE FROM c
UNION ALL SELECT item_id, 'mention', 'm3', '', 'Place', 7, NULL, '', NULL, 0.5::DOUBLE FROM c
UNION ALL SELECT item_id, 'entity', 'e1', trim(regexp_replace(one || ' ' || two, '\\s+', ' ', 'g')), 'Word', NULL, NULL, 'm1,own', NULL, 0.0::DOUBLE FROM c
UNION ALL SELECT item_id, 'relation', 'r1', 'is', NULL, NULL, NULL, 'e1', NULL, 1.0::DOUBLE FROM c
UNION ALL SELECT item_id, 'relation', 'r2', 'names', NULL, NULL, NULL, 'e1,e9', 'a b', 0.5::DOUBLE FROM c
UNION ALL SELECT item_id, 'evidence', 'ev1', trim(regexp_replace(one || ' ' || two, '\\s+', ' ', 'g')), NULL, 2, NULL, 'r1', NULL, NULL FROM c"""


@query("src_model_candidates", _CANDIDATES)
def src_model_candidates(t: Tables) -> DataFrame:
    """Payloads such as a model returns, made from each text: wrong ranges, odd confidences, ids that don't exist."""
    words = F.split("text", " ")
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    shout = F.translate(word(2), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    listed = lambda *x: F.array(*map(F.lit, x))

    def part(fields: str, **given):
        """An object of these fields; to_json leaves out those not given."""
        kinds = [("array<string>" if f in ("mention_ids", "supports") else "string", f) for f in fields.split()]
        return F.struct(*((given[f] if hasattr(given.get(f), "cast") else F.lit(given.get(f))).cast(kind).alias(f) for kind, f in kinds))

    mention = "mention_id text type_hint proposed_type start end confidence"
    relation = "subject_candidate_id predicate_text object_candidate_id object_literal confidence"
    payload = F.struct(
        F.array(
            part(mention, text=F.concat(F.lit(" "), shout), type_hint="Word", start=-4, end=2, confidence=F.col("item_id") / 10),
            part(mention, mention_id="own", text=word(0), start=0, end=3, confidence=0.4),
            part(mention, text="  ", proposed_type="Place", start=7, confidence="much"),
        ).alias("mentions"),
        F.array(part("mention_ids proposed_type canonical_name confidence", mention_ids=listed("m1", "m8", "own"), proposed_type=" Word ", canonical_name=F.concat(F.lit(" "), word(0), F.lit("  "), word(1)), confidence=-2)).alias("candidate_entities"),
        F.array(part(relation, subject_candidate_id="e1", predicate_text=" is ", object_literal="  ", confidence=7), part(relation, subject_candidate_id="e1", predicate_text="names", object_candidate_id="e9", object_literal=" a   b ")).alias("candidate_relations"),
        F.array(part("supports excerpt start end", supports=listed("r1", "r7"), excerpt=F.concat(word(0), F.lit("   "), word(1)), start=2, end=-1)).alias("evidence"),
    )
    return K.candidates(t("benchmark").where("text IS NOT NULL").select("item_id", "text", F.to_json(payload).alias("payload")), "item_id")


@query("src_ontology_ttl")
def src_ontology_ttl(t: Tables) -> DataFrame:
    lines = ["@prefix ex: <http://example.org/> ."] + [f'ex:{c} a ex:Class ;\n  ex:label "{c}" ;\n  ex:subClassOf ex:{p or "Thing"} .' for c, p, _ in K.CLASSES]
    return K.load_turtle(t.spark, "\n".join(lines))
