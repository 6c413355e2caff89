"""A chunk's extraction as one row of arrays: rules, pruning, status and the graph's tables, each in one pass.

Rows: (chunk_id, document_id, mentions, entities, relations, evidence), arrays of structs:
mentions (mention_id, text), entities (candidate_id, type, name, mention_ids, confidence), relations (relation_id, subject,
predicate, object, literal, confidence), evidence (evidence_id, supports, excerpt). An extraction is what one chunk says, so its
arrays are short, and all rules look within the row: nothing is joined or shuffled until rows meet by entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the least confidence of entities and relations.
LEAST_CONFIDENCE = 0.7
#: What an extraction holds, as a model returns it in JSON.
PAYLOAD = (
    "mentions array<struct<mention_id:string,text:string>>, entities array<struct<candidate_id:string,type:string,name:string,mention_ids:array<string>,confidence:double>>, "
    "relations array<struct<relation_id:string,subject:string,predicate:string,object:string,literal:string,confidence:double>>, evidence array<struct<evidence_id:string,supports:array<string>,excerpt:string>>"
)
PARTS = ("mentions", "entities", "relations", "evidence")


@dataclass(frozen=True)
class Ontology:
    """classes: name -> parent or None; predicates: name -> (object or datatype, domain, range). Small: it becomes literals of the plan."""

    classes: dict[str, str | None]
    predicates: dict[str, tuple[str, str | None, str | None]]

    def lineage(self, name: str) -> list[str]:
        """The class and its ancestors; a cycle ends."""
        out: list[str] = []
        at: str | None = name
        while at is not None and at not in out:
            out.append(at)
            at = self.classes.get(at)
        return out

    def known(self, name: Column) -> Column:
        return F.coalesce(name.isin(*self.classes), F.lit(False)) if self.classes else F.lit(False)

    def fits(self, actual: Column, expected: Column) -> Column:
        """The class is the expected one or below it."""
        rows = F.create_map(*(x for c in self.classes for x in (F.lit(c), F.array(*map(F.lit, self.lineage(c))))))
        return F.coalesce(F.array_contains(F.try_element_at(rows, actual), expected), F.lit(False))

    def rule(self, predicate: Column) -> Column:
        """(kind, dom, ran) of a predicate, or null."""
        text = lambda x: F.lit(x).cast("string")
        rows = F.create_map(*(x for p, (kind, dom, ran) in self.predicates.items() for x in (F.lit(p), F.struct(text(kind).alias("kind"), text(dom).alias("dom"), text(ran).alias("ran")))))
        return F.try_element_at(rows, predicate)


def _said(name: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(name), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _errors(*rules: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(broken, what) for broken, what in rules)))


def _all(array: Column, field: str) -> Column:
    return F.flatten(F.transform(array, lambda x: x[field]))


def _low(x: Column, least: float) -> Column:
    return F.coalesce(x["confidence"], F.lit(0.0)) < least


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _in(x: Column, array: Column) -> Column:
    return F.coalesce(F.array_contains(array, x), F.lit(False))


def _ended(relations: Column, entities: Column, onto: Ontology) -> Column:
    """Relations with the types of their ends among the entities, the last of an id, and their predicate's rule."""
    kind = lambda key: F.try_element_at(F.filter(entities, lambda e: e["candidate_id"] == key), F.lit(-1))["type"]
    fields = ("relation_id", "subject", "predicate", "object", "literal", "confidence")
    return F.transform(relations, lambda r: F.struct(*(r[f].alias(f) for f in fields), kind(r["subject"]).alias("subject_type"), kind(r["object"]).alias("object_type"), onto.rule(r["predicate"]).alias("rule")))


def _relation_rules(r: Column, onto: Ontology, least: float) -> list[tuple[Column, Column]]:
    """What is wrong with a relation, its ends and its object; in the order in which it is told."""
    to_entity, literal, rule = r["object"].isNotNull(), ~_blank(r["literal"]), r["rule"]
    bound = lambda end, limit: (r[f"{end}_type"].isNotNull() & onto.known(rule[limit]) & ~onto.fits(r[f"{end}_type"], rule[limit]), _said(f"invalid_{end}_type", r["relation_id"], F.concat_ws("->", r[f"{end}_type"], rule[limit])))
    broken, what = bound("object", "ran")
    wrong = F.coalesce(rule["kind"] == "datatype", F.lit(False))
    return [
        (rule.isNull(), _said("invalid_predicate", r["predicate"])), (r["subject_type"].isNull(), _said("missing_subject", r["relation_id"])), (to_entity & r["object_type"].isNull(), _said("missing_object", r["relation_id"])),
        (~to_entity & ~literal, _said("missing_relation_object", r["relation_id"])), (_low(r, least), _said("low_relation_confidence", r["relation_id"])), bound("subject", "dom"),
        (to_entity & wrong, _said("invalid_object_candidate_for_datatype", r["relation_id"])), (to_entity & ~wrong & broken, what),
        (~to_entity & literal & (rule["kind"] == "object"), _said("invalid_literal_for_object_property", r["relation_id"])),
        (~to_entity & literal & ~F.coalesce(rule["kind"] == "object", F.lit(False)) & (rule["ran"] == "xsd:decimal") & r["literal"].try_cast("double").isNull(), _said("invalid_decimal_literal", r["relation_id"])),
    ]


def _entity_rules(e: Column, onto: Ontology, least: float) -> list[tuple[Column, Column]]:
    return [(~onto.known(e["type"]), _said("invalid_entity_type", e["type"])), (_blank(e["name"]), _said("empty_entity_name", e["candidate_id"])), (_low(e, least), _said("low_entity_confidence", e["candidate_id"])), (F.size(e["mention_ids"]) == 0, _said("missing_mentions", e["candidate_id"]))]


def violations(extractions: DataFrame, onto: Ontology, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """extractions with `errors`: every rule that is broken, told by what breaks it."""
    heard = F.transform("mentions", lambda m: m["mention_id"])
    unknown = lambda e: F.transform(F.filter(e["mention_ids"], lambda m: ~_in(m, F.col("__heard"))), lambda m: _said("unknown_mention", e["candidate_id"], m))
    a = extractions.withColumns({"__heard": heard, "__shown": _all(F.col("evidence"), "supports"), "__ended": _ended(F.col("relations"), F.col("entities"), onto)})
    each = lambda column, f: F.flatten(F.transform(column, f))
    unshown = lambda r: (~_in(r["relation_id"], F.col("__shown")), _said("missing_evidence", r["relation_id"]))
    errors = F.concat(
        F.transform(F.filter("mentions", lambda m: _blank(m["text"])), lambda m: _said("empty_mention_text", m["mention_id"])),
        each("entities", lambda e: F.concat(_errors(*_entity_rules(e, onto, least)), unknown(e))),
        each("__ended", lambda r: _errors(*_relation_rules(r, onto, least), unshown(r))),
        each("evidence", lambda v: _errors((F.size(v["supports"]) == 0, _said("orphan_evidence", v["evidence_id"])), (_blank(v["excerpt"]), _said("empty_evidence_excerpt", v["evidence_id"])))),
    )
    return a.withColumn("errors", errors).drop("__heard", "__shown", "__ended")


def prune(extractions: DataFrame, onto: Ontology, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """extractions without what breaks a rule and what that leaves alone, with `warnings` in the order in which things went.

    Mentions without text go, then entities, then relations, then evidence without an excerpt or a relation, then relations
    without evidence. Entities and mentions that no relation needs go last; without a relation nothing is left.
    """
    a = extractions.withColumn("__m", F.filter("mentions", lambda m: ~_blank(m["text"])))
    a = a.withColumn("__h", F.transform("__m", lambda m: m["mention_id"]))
    a = a.withColumn("__e", F.transform("entities", lambda e: e.withField("mention_ids", F.filter(e["mention_ids"], lambda m: _in(m, F.col("__h"))))))
    a = a.withColumn("__e", F.transform("__e", lambda e: F.struct(e.alias("x"), _errors(*_entity_rules(e, onto, least)).alias("errors"))))
    fit = lambda c: F.transform(F.filter(c, lambda x: F.size(x["errors"]) == 0), lambda x: x["x"])
    a = a.withColumn("__g", fit("__e")).withColumn("__r", _ended(F.col("relations"), F.col("__g"), onto))
    a = a.withColumn("__r", F.transform("__r", lambda r: F.struct(r.dropFields("subject_type", "object_type", "rule").alias("x"), _errors(*_relation_rules(r, onto, least)).alias("errors"))))
    a = a.withColumn("__p", fit("__r")).withColumn("__i", F.transform("__p", lambda r: r["relation_id"]))
    a = a.withColumn("__v", F.transform("evidence", lambda v: v.withField("supports", F.filter(v["supports"], lambda s: _in(s, F.col("__i"))))))
    lost = lambda v: F.when(_blank(v["excerpt"]), _said("empty_evidence_excerpt", v["evidence_id"])).when(F.size(v["supports"]) == 0, _said("orphan_evidence", v["evidence_id"]))
    a = a.withColumn("__w", F.filter("__v", lambda v: lost(v).isNull())).withColumn("__s", _all(F.col("__w"), "supports"))
    a = a.withColumn("__k", F.filter("__p", lambda r: _in(r["relation_id"], F.col("__s"))))
    alone = F.transform(F.filter("__p", lambda r: ~_in(r["relation_id"], F.col("__s"))), lambda r: _said("missing_evidence", r["relation_id"]))
    warnings = F.concat(_all(F.col("__e"), "errors"), _all(F.col("__r"), "errors"), F.array_compact(F.transform("__v", lost)), alone)
    a = a.withColumns({"warnings": warnings, "__n": F.array_compact(F.flatten(F.transform("__k", lambda r: F.array(r["subject"], r["object"]))))})
    a = a.withColumn("__g", F.filter("__g", lambda e: _in(e["candidate_id"], F.col("__n"))))
    some = F.size("__k") > 0
    kept = {"mentions": F.filter("__m", lambda m: F.exists("__g", lambda e: _in(m["mention_id"], e["mention_ids"]))), "entities": F.col("__g"), "relations": F.col("__k"), "evidence": F.filter("__w", lambda _: some)}
    return a.withColumns(kept).drop(*(c for c in a.columns if c.startswith("__")))


def read_payloads(raw: DataFrame) -> DataFrame:
    """raw (chunk_id, document_id, payload, error) as extractions with `failure`: why there is none, or null.

    An extractor's own error stands first; a payload that isn't JSON, or not an object, fails as well. Such rows have empty arrays.
    """
    parsed = raw.withColumn("__x", F.from_json("payload", PAYLOAD + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    whole = F.col("__x").isNotNull() & F.col("__x._bad").isNull()
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("extractor_error:"), "error")).when(F.col("payload").isNull(), "extractor_error:no_payload").when(~whole, "extractor_error:invalid_json")
    kinds = dict(raw.sparkSession.createDataFrame([], PAYLOAD).dtypes)
    parts = [F.when(F.col("failure").isNull(), F.coalesce(F.col(f"__x.{p}"), F.array().cast(kinds[p]))).otherwise(F.array().cast(kinds[p])).alias(p) for p in PARTS]
    return parsed.withColumn("failure", why).select("chunk_id", "document_id", "failure", *parts)


def judge(extractions: DataFrame, onto: Ontology, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Pruned extractions with status and errors: quarantined (failed), skipped (no relation left), validated or review."""
    pruned = violations(prune(extractions, onto, least), onto, least)
    some = F.size("relations") > 0
    status = F.when(F.col("failure").isNotNull(), "quarantined").when(~some, "skipped").when(F.size("errors") == 0, "validated").otherwise("review")
    told = F.when(F.col("failure").isNotNull(), F.array("failure")).otherwise(F.concat("warnings", F.col("errors"), F.when(~some, F.array(F.lit("empty_relation_set"))).otherwise(F.array().cast("array<string>"))))
    return pruned.select("chunk_id", "document_id", status.alias("status"), told.alias("errors"), *PARTS)


def entity_id(e: Column) -> Column:
    """The key under which chunks' entities are one: type and name as a slug."""
    slug = F.btrim(F.regexp_replace(F.lower(e["name"]), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat_ws("_", F.lower(e["type"]), slug)


def graph_tables(judged: DataFrame) -> dict[str, DataFrame]:
    """raw, entities, assertions and evidence of judged extractions; only validated ones reach the last three.

    Of an entity the last chunk's name and type stay, and the first chunk's document as its source.
    """
    ok = judged.where("status = 'validated'").withColumn("__ids", F.transform("entities", lambda e: F.struct(e["candidate_id"].alias("c"), entity_id(e).alias("id"))))
    said = ok.select("chunk_id", "document_id", F.posexplode("entities").alias("n", "e")).select(F.struct("chunk_id", "n").alias("at"), "document_id", entity_id(F.col("e")).alias("entity_id"), F.col("e.name").alias("name"), F.col("e.type").alias("type"))
    entities = said.groupBy("entity_id").agg(F.max_by("name", "at").alias("canonical_name"), F.max_by("type", "at").alias("entity_type"), F.min_by("document_id", "at").alias("source"))
    of = lambda key: F.try_element_at(F.filter("__ids", lambda x: x["c"] == key), F.lit(-1))["id"]
    assertion = F.concat_ws(":", "chunk_id", "r.relation_id")
    links = ok.select("chunk_id", "document_id", "__ids", "evidence", F.explode("relations").alias("r")).withColumn("assertion_id", assertion)
    assertions = links.select("assertion_id", "document_id", "chunk_id", of(F.col("r.subject")).alias("subject_entity_id"), F.col("r.predicate").alias("predicate"), of(F.col("r.object")).alias("object_entity_id"), F.nullif(F.col("r.literal"), F.lit("")).alias("object_literal"), F.col("r.confidence").alias("confidence"))
    shown = links.select("assertion_id", "r", F.explode("evidence").alias("v")).where("array_contains(v.supports, r.relation_id)")
    evidence = shown.select(F.concat_ws(":", "assertion_id", "v.evidence_id").alias("evidence_id"), "assertion_id", F.col("v.excerpt").alias("excerpt"))
    return {"raw": judged.select("chunk_id", "document_id", "status", "errors"), "entities": entities, "assertions": assertions.dropDuplicates(["assertion_id"]), "evidence": evidence.dropDuplicates(["evidence_id"])}


def replay(judged: DataFrame, again: DataFrame, onto: Ontology, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """judged with its quarantined chunks judged anew from what `again` (raw) brings; all others stay, and so do those it lacks."""
    failed = judged.where("status = 'quarantined'").select("chunk_id")
    new = judge(read_payloads(again.join(failed, "chunk_id", "left_semi")), onto, least)
    return judged.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*new.columns).unionByName(new)
