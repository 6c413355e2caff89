"""Ontology-constrained knowledge extraction: aliases to mentions, phrases to relations, rule-based validation."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MENTION_CONFIDENCE, RELATION_CONFIDENCE = 0.82, 0.75
#: A small ontology of our own for the synthetic texts: class, parent, aliases.
CLASSES = (
    ("Word", None, ()),
    ("Pointer", "Word", ("this", "that", "which")),
    ("NearPointer", "Pointer", ("here", "it")),
    ("Link", "Word", ("with", "from", "by")),
    ("Place", "Link", ("at", "in", "on")),
    ("Limit", "Word", ("only", "not", "but")),
)
#: Predicate, domain, range, phrase that signals it.
PREDICATES = (("pointsTo", "Pointer", "Link", "to"), ("limits", "Limit", "Word", "only"), ("joins", "Link", "Word", "and"), ("names", "Word", "Word", "is"))


#: Labels of the classes, by which an extraction without a model finds them in a text.
LABELS = {"Word": "Word", "Pointer": "That", "NearPointer": "It", "Link": "By", "Place": "In", "Limit": "Not"}
#: Words that may stand beside an alias without making it another thing; the excerpt that shows a relation.
GENERIC_TAIL = ("about", "around", "few", "for", "from", "hundred", "hundreds", "in", "many", "more", "most", "of", "or", "over", "several", "some", "than", "thousand", "thousands", "to", "under", "with")
EXCERPT = 240


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, p) for c, p, _ in CLASSES], "name string, parent string")


def aliases(spark: SparkSession) -> DataFrame:
    rows = {(c, a) for c, _, words in CLASSES for a in (*words, c.lower(), " ".join(re.findall(r"[A-Z][a-z]*", c)).lower())}
    return spark.createDataFrame(sorted(rows), "name string, alias string")


def _pairs(known: DataFrame) -> list[tuple[str, str]]:
    """An ontology's (name, alias), which become literals of a plan."""
    return [(r["name"], r["alias"]) for r in known.select("name", "alias").where("alias IS NOT NULL").collect()]


def ancestors(classes_: DataFrame) -> DataFrame:
    """(name, ancestor): the transitive closure by a recursive query of as many levels as there are classes, so a cycle ends."""
    view = f"ontology_parents_{uuid.uuid4().hex}"
    classes_.where("parent IS NOT NULL").createOrReplaceTempView(view)
    return classes_.sparkSession.sql(
        f"""WITH RECURSIVE up(name, ancestor, depth) AS (SELECT name, parent, 1 FROM {view} UNION ALL
        SELECT up.name, p.parent, up.depth + 1 FROM up JOIN {view} p ON p.name = up.ancestor CROSS JOIN (SELECT count(*) AS classes FROM {view}) WHERE up.depth < classes)
        SELECT DISTINCT name, ancestor FROM up"""
    )


def normal(c: Column) -> Column:
    """Lower-case words of letters and digits, single spaces."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def heard(text: Column, phrases: Sequence[str]) -> Column:
    """Array of (place, phrase): which phrases a text holds as whole words, each at its first place, in the order of places.

    All is found within the row, whatever the text's length: of its words only those asked for go on, and a phrase of several
    words is looked for in the text as it was normalised. A null text has a null array.
    """
    single, several = [p for p in phrases if " " not in p], [p for p in phrases if " " in p]
    hit = lambda place, phrase: F.struct(place.cast("int").alias("place"), phrase.alias("phrase"))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - a value within a lambda is made for each mention

    def within(plain: Column) -> Column:
        asked = F.array(*map(F.lit, single)).cast("array<string>")
        words = once(F.split(plain, " "), lambda w: F.transform(F.array_intersect(w, asked), lambda x: hit(F.array_position(w, x) - 1, x)))
        padded = F.concat(F.lit(" "), plain, F.lit(" "))
        before = lambda p: F.substring_index(padded, f" {p} ", 1)
        spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        found = F.array_compact(F.array(*(F.when(F.contains(padded, F.lit(f" {p} ")), hit(spaces(before(p)), F.lit(p))) for p in several))) if several else None
        return words if found is None else F.concat(words, found)

    return F.array_sort(once(normal(text), within))


def tags(heard_: Column, rows: Iterable[tuple[str, str]]) -> Column:
    """Array of (place, name, alias) from what was heard: every class that has the alias; rows are (name, alias)."""
    of: dict[str, list[str | None]] = {}
    for name, alias in dict.fromkeys(rows):
        of.setdefault(alias, []).append(name)
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    names = F.create_map(*(x for a, ns in (of or {"": []}).items() for x in (F.lit(a), texts(*ns))))
    each = lambda h: F.transform(F.coalesce(F.try_element_at(names, h["phrase"]), texts()), lambda n: F.struct(h["place"].alias("place"), n.alias("name"), h["phrase"].alias("alias")))
    return F.array_sort(F.flatten(F.transform(heard_, each)))


def firsts(tags_: Column) -> Column:
    """Array of (rn, name, alias) from a text's tags: each class with the first of its aliases, numbered in the order of places."""
    named = lambda c: F.transform(c, lambda x: x["name"])
    own = F.filter(tags_, lambda x, i: F.array_position(named(tags_), x["name"]) == i + 1)
    return F.transform(own, lambda x, i: F.struct((i + 1).alias("rn"), x["name"].alias("name"), x["alias"].alias("alias")))


def tag(docs: DataFrame, spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, alias, place): aliases of whole words, of as many as the longest alias has, and their first place.

    A text's words stay in its row; rows of one doc_id meet by what was found. The ontology is a constant of this module, so
    what the plan holds of it doesn't grow with the data.
    """
    rows = _pairs(aliases(spark) if known is None else known)
    said = docs.select("doc_id", heard(F.col("text"), sorted({a for _, a in rows})).alias("heard"))
    found = said.select("doc_id", F.inline(tags(F.col("heard"), rows)))
    return found.groupBy("doc_id", "name", "alias").agg(F.min("place").alias("place"))


@F.pandas_udf(StringType())
def _compatible(c: pd.Series) -> pd.Series:
    """Compatibility forms (NFKC) of texts."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def surface(c: Column) -> Column:
    """A name as it is compared: lower case, without articles, quotes and marks, what stands in parentheses kept, the last word singular."""
    x = F.replace(F.lower(_compatible(F.coalesce(c, F.lit("")))), F.lit("\0"), F.lit(""))
    x = F.translate(F.regexp_replace(x, r"\(([^)]*)\)", " $1 "), "/-", "  ")
    x = F.regexp_replace(F.regexp_replace(x, "^[\"'`]+|[\"'`]+$", ""), r"\b(the|a|an)\b", " ")
    x = F.btrim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", " "), r"\s+", " "), F.lit(" "))
    cut, long = lambda n: F.substr(x, F.lit(1), F.length(x) - n), F.length(x)
    plural = F.endswith(x, F.lit("s")) & (long > 3) & ~(F.endswith(x, F.lit("ss")) | F.endswith(x, F.lit("us")) | F.endswith(x, F.lit("is")))
    return F.when(F.endswith(x, F.lit("ies")) & (long > 4), F.concat(cut(3), F.lit("y"))).when(plural, cut(1)).otherwise(x)


def singular(x: Column) -> Column:
    cut = lambda n: F.substr(x, F.lit(1), F.length(x) - n)
    return F.when((F.length(x) > 4) & F.endswith(x, F.lit("ies")), F.concat(cut(3), F.lit("y"))).when((F.length(x) > 3) & F.endswith(x, F.lit("s")) & ~F.endswith(x, F.lit("ss")), cut(1)).otherwise(x)


def name_tokens(c: Column) -> Column:
    """Singular words of a name."""
    return F.transform(F.filter(F.split(surface(c), " "), lambda x: x != ""), singular)


def has_generic_tail(name: Column, alias: Column) -> Column:
    """Words are an alias's words with only numbers and generic words after or before them."""
    n = F.size(alias)
    plain = lambda rest: (F.size(rest) > 0) & F.forall(rest, lambda x: x.rlike("^[0-9]+$") | x.isin(*GENERIC_TAIL))
    after = (F.slice(name, F.lit(1), n) == alias) & plain(F.slice(name, n + 1, F.greatest(F.size(name) - n, F.lit(0))))
    before = (F.slice(name, F.greatest(F.size(name) - n + 1, F.lit(1)), n) == alias) & plain(F.slice(name, F.lit(1), F.greatest(F.size(name) - n, F.lit(0))))
    return (n > 0) & (F.size(name) > n) & (after | before)


def heuristic(docs: DataFrame, spark: SparkSession, labels: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, entities, relations, excerpt): what is said without a model.

    Tagged classes come in the order of their names; one counts where its label, or its own name as words, stands in the text.
    The first two are linked by every predicate whose phrase the text holds, and its first characters show it.
    entities: (id, name, type, start, end); relations: (id, predicate, subject, object).
    """
    labels = LABELS if labels is None else labels
    rows = _pairs(aliases(spark))
    names = F.array_sort(F.array_distinct(F.transform(tags(heard(F.col("text"), sorted({a for _, a in rows})), rows), lambda x: x["name"])))
    known = F.create_map(*(x for c, label in labels.items() for x in (F.lit(c), F.lit(label))))
    low = F.col("low")
    spaced = lambda n: F.lower(F.regexp_replace(n, "(?<!^)([A-Z])", " $1"))
    label = lambda n: F.coalesce(F.try_element_at(known, n), n)
    said = lambda n: F.when(F.contains(low, F.lower(label(n))), F.lower(label(n))).when(F.contains(low, spaced(n)), spaced(n))
    # a generator drops texts without a class, where a filter would hear each text twice
    a = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.lower("text").alias("low"), F.explode(F.filter(F.array(names), lambda n: F.size(n) > 0)).alias("names"))
    a = a.withColumn("found", F.filter(F.transform("names", lambda n: F.struct(n.alias("type"), label(n).alias("name"), said(n).alias("token"))), lambda x: x["token"].isNotNull()))
    start = lambda x: F.position(x["token"], low, F.lit(1)) - 1
    entities = F.transform("found", lambda x, i: F.struct(F.concat(F.lit("e"), (i + 1).cast("string")).alias("id"), x["name"].alias("name"), x["type"].alias("type"), start(x).alias("start"), (start(x) + F.length(x["token"])).alias("end")))
    fired = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(phrase)), F.lit(p)) for p, _, _, phrase in PREDICATES)))
    relations = F.transform(fired, lambda p, i: F.struct(F.concat(F.lit("r"), (i + 1).cast("string")).alias("id"), p.alias("predicate"), F.lit("e1").alias("subject"), F.lit("e2").alias("object")))
    linked = F.when(F.size("found") >= 2, relations).otherwise(F.filter(relations, lambda _: F.lit(False)))
    return a.select("doc_id", entities.alias("entities"), linked.alias("relations"), F.substring("text", 1, EXCERPT).alias("excerpt"))


def entity_key(kind: Column, name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat_ws("_", F.lower(kind), slug)


def load_turtle(spark: SparkSession, text: str) -> DataFrame:
    """(subject, predicate, object) of a line-oriented Turtle subset: prefixed names, `a`, literals, `;` and `.`."""
    rows, subject = [], None
    strip = lambda x: x.split(":", 1)[-1] if not x.startswith('"') else x.split('"')[1]
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith(("@", "#")):
            continue
        body = line.rstrip(" ;.")
        parts = re.findall(r'"[^"]*"(?:@\w+|\^\^\S+)?|[^\s,]+', body)
        if subject is None and parts:
            subject, parts = strip(parts[0]), parts[1:]
        if len(parts) >= 2:
            rows += [(subject, "type" if parts[0] == "a" else strip(parts[0]), strip(o)) for o in parts[1:]]
        if line.endswith("."):
            subject = None
    return spark.createDataFrame(rows or [], "subject string, predicate string, object string")


#: Model output as it is read: numbers as text, since their types vary.
PAYLOAD = (
    "mentions array<struct<mention_id:string,text:string,type_hint:string,proposed_type:string,start:string,end:string,confidence:string>>, "
    "candidate_entities array<struct<candidate_id:string,mention_ids:array<string>,proposed_type:string,canonical_name:string,confidence:string>>, "
    "candidate_relations array<struct<relation_id:string,subject_candidate_id:string,predicate_text:string,object_candidate_id:string,object_literal:string,confidence:string>>, "
    "evidence array<struct<evidence_id:string,supports:array<string>,excerpt:string,start:string,end:string>>"
)


def candidates(df: DataFrame, key: str, text: str = "text", payload: str = "payload") -> DataFrame:
    """Model output as rows (key, kind, id, name, type, start, end, links, literal, confidence) of one shape.

    Missing ids are numbered by kind. A mention without a sound range gets the first place of its text, whatever the case;
    confidences are clamped to 0..1 and are 0.5 where none can be read; links keep only ids that exist.
    """
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("int"))
    blank = lambda c: F.coalesce(F.btrim(c), F.lit(""))
    spaced = lambda c: F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    sure = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))
    named = lambda given, mark, i: F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit(mark), (i + 1).cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    ids = lambda array, field, mark: F.transform(array, lambda x, i: named(x[field], mark, i))
    existing = lambda links, known: F.concat_ws(",", F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.array_contains(known, x)))

    def row(kind, id_, name, type_, start, end, links, literal, confidence):
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"), type_.alias("type"), start.alias("start"), end.alias("end"), links.alias("links"), literal.alias("literal"), confidence.alias("confidence"))

    def mention(x, i):
        name, start, end = blank(x["text"]), number(x["start"]), number(x["end"])
        found = F.position(F.lower(name), F.lower(F.col(text)), F.lit(1)) - 1
        repair = (name != "") & (start.isNull() | end.isNull() | (end <= start)) & (found >= 0)
        hint = F.coalesce(F.nullif(x["type_hint"], F.lit("")), F.nullif(x["proposed_type"], F.lit("")), F.lit("Unknown"))
        return row("mention", named(x["mention_id"], "m", i), name, hint, F.when(repair, found).otherwise(start), F.when(repair, found + F.length(name)).otherwise(end), F.lit(""), none("string"), sure(x["confidence"]))

    p = F.col("__p")
    parsed = df.withColumn("__p", F.from_json(payload, PAYLOAD))
    known = parsed.withColumns({"__m": ids(p["mentions"], "mention_id", "m"), "__r": ids(p["candidate_relations"], "relation_id", "r")})
    lists = [
        F.transform(p["mentions"], mention),
        F.transform(p["candidate_entities"], lambda x, i: row("entity", named(x["candidate_id"], "e", i), spaced(x["canonical_name"]), blank(x["proposed_type"]), none("int"), none("int"), existing(x["mention_ids"], F.col("__m")), none("string"), sure(x["confidence"]))),
        F.transform(p["candidate_relations"], lambda x, i: row("relation", named(x["relation_id"], "r", i), blank(x["predicate_text"]), none("string"), none("int"), none("int"), F.concat_ws(",", F.coalesce(x["subject_candidate_id"], F.lit("")), F.nullif(x["object_candidate_id"], F.lit(""))), F.nullif(spaced(x["object_literal"]), F.lit("")), sure(x["confidence"]))),
        F.transform(p["evidence"], lambda x, i: row("evidence", named(x["evidence_id"], "ev", i), spaced(x["excerpt"]), none("string"), number(x["start"]), number(x["end"]), existing(x["supports"], F.col("__r")), none("string"), none("double"))),
    ]
    return reduce(DataFrame.unionByName, [known.select(key, F.inline(x)) for x in lists])
