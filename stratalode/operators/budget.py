"""Prompt budgets: rows of seven kinds rendered as JSON and kept in order while they fit.

A group's rows are one array (what was retrieved for a question, so a few dozen), and the budget is a fold over it: what a row
may show depends on the room that is left. Sizes are the characters of JSON text with a space after each comma and colon.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that are cut in a row too large for its whole budget, the first that is long first; the least a cut leaves
#: before its dots; the least room that such a row is rendered for.
CUT_FIELDS = ("text", "summary_text", "excerpt", "object_literal", "content")
CUT_FLOOR, DOTS, LEAST_ROOM = 24, "...", 40
#: Characters that say that a row was cut.
MARK = len(', "truncated": true')
#: No text has more characters than can be halved so often.
HALVINGS = 32

Fields = dict[str, Column]


@dataclass(frozen=True)
class Kind:
    """How rows of a kind are shown: `show` gives the fields in order and whether something was left out.

    Fields named in `optional` are left out where they are null; all others stand with null. Those named in `nested` are arrays
    or structs, all others single values.
    """

    show: Callable[[Column, Column], tuple[Fields, Column]]
    optional: tuple[str, ...] = ()
    nested: tuple[str, ...] = ()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is mentioned: within a fold each mention would make it anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marks(text: Column) -> Column:
    """Commas and colons of JSON text outside of its strings."""
    return F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*+"', ""), "[^,:]", ""))


def json_size(fields: Fields, nested: tuple[str, ...] = ()) -> Column:
    """Characters of an object of these fields as JSON with a space after each comma and colon.

    The object's own marks follow from the number of its fields; only fields named in `nested` (arrays and structs) have further
    ones, which are looked for in their text.
    """
    size = F.length(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})) + (2 * len(fields) - 1)
    for n in nested:
        if n in fields:
            size += F.coalesce(_marks(F.to_json(fields[n], {"ignoreNullFields": "false"})), F.lit(0))
    return size


def _size(row: Column, names: list[str], kind: Kind) -> Column:
    size = json_size({n: row[n] for n in names if n not in kind.optional}, kind.nested)
    for n in kind.optional:
        size += F.when(row[n].isNotNull(), json_size({n: row[n]}, kind.nested)).otherwise(0)  # its braces stand for ", "
    return size + F.when(row["truncated"], MARK).otherwise(0)


def _rendered(kind: Kind, row: Column, room: Column, cut: bool = False) -> tuple[Column, list[str]]:
    fields, short = kind.show(row, room)
    return F.struct(*(c.alias(n) for n, c in fields.items()), (F.lit(True) if cut else short).alias("truncated")), list(fields)


def _shrunk(row: Column, names: list[str], kind: Kind, limit: int) -> Column:
    """The row with its long texts halved one after another until it fits or nothing is left to cut."""
    texts = [n for n in CUT_FIELDS if n in names]
    if not texts:
        return row
    long = lambda r, n: F.coalesce(F.length(r[n]) > CUT_FLOOR + len(DOTS), F.lit(False))

    def halved(r: Column, _: Column) -> Column:
        out = r
        for n in reversed(texts):
            half = F.greatest(F.lit(CUT_FLOOR), F.floor(F.length(r[n]) / 2).cast("int"))
            out = F.when(long(r, n), r.withField(n, F.concat(F.regexp_replace(F.substr(r[n], F.lit(1), half), r"\s+$", ""), F.lit(DOTS)))).otherwise(out)
        return F.when(_size(r, names, kind) > limit, out).otherwise(r)

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS * len(texts))), row, halved)


def shown(row: Column, room: int, kind: Kind) -> Column:
    """(row, size): one struct as it is shown in a room, and its size without the mark of a cut."""
    got, names = _rendered(kind, row, F.lit(room))
    return F.struct(got.alias("row"), (_size(got, names, kind) - F.when(got["truncated"], MARK).otherwise(0)).cast("long").alias("size"))


def budgeted(rows: Column, limit: int, kind: Kind) -> Column:
    """Array of (at, row, size): what is kept of an array of structs, `at` counting from 0.

    A row that doesn't fit what is left is skipped and later ones may still fit. If the first row alone is over the limit it is
    shown cut, and it is the only one.
    """
    place = lambda at, row, size: F.struct(at.cast("int").alias("at"), row.alias("row"), size.cast("long").alias("size"))
    zero = F.lit(0)
    none = F.transform(F.slice(rows, 1, 0), lambda x: place(zero, _rendered(kind, x, F.lit(limit))[0], zero))
    state = lambda used, at, done, kept: F.struct(used.cast("long").alias("used"), at.cast("int").alias("at"), done.alias("done"), kept.alias("kept"))
    start = state(zero, zero, F.lit(False), none)

    def step(s: Column, x: Column) -> Column:
        row, names = _rendered(kind, x, F.greatest(zero, limit - s["used"]))
        first, after = F.size(s["kept"]) == 0, s["at"] + 1
        sized = lambda made, use: once(made, lambda r: once(F.struct(r.alias("row"), _size(r, names, kind).alias("size")), lambda v: use(v["row"], v["size"])))
        whole, passed = _rendered(kind, x, F.lit(max(LEAST_ROOM, limit)), cut=True)[0], state(s["used"], after, s["done"], s["kept"])
        ended = sized(_shrunk(whole, names, kind, limit), lambda cut, size: state(s["used"], after, F.lit(True), F.array_append(s["kept"], place(s["at"], cut, size))))

        def judged(row: Column, size: Column) -> Column:
            taken = state(s["used"] + size, after, F.lit(False), F.array_append(s["kept"], place(s["at"], row, size)))
            return F.when(~first & (s["used"] + size > limit), passed).when(first & (size > limit), ended).otherwise(taken)

        return F.when(s["done"], passed).otherwise(sized(row, judged))

    return F.aggregate(rows, start, step)["kept"]


def budget(rows: DataFrame, group: str, order: list[str], limit: int, kind: Kind) -> DataFrame:
    """(group, at, size, truncated, and the shown fields) of the rows of each group that its budget keeps; order columns first, unique."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *(c for c in rows.columns if c not in (group, *order)))))  # what one question retrieved
    kept = rows.groupBy(group).agg(listed.alias("__rows")).select(group, F.inline(budgeted(F.col("__rows"), limit, kind)))
    return kept.select(group, "at", "size", "row.*")


def _left(text: Column, n: Column | int) -> Column:
    return F.substr(F.coalesce(text, F.lit("")), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def _room(least: int, room: Column, rest: int) -> Column:
    return F.greatest(F.lit(least), room - rest)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _listed(c: Column, n: int) -> Column:
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)


def _chunk(r: Column, room: Column) -> tuple[Fields, Column]:
    most = _room(200, room, 700)
    synopsis = lambda name, least: F.when((F.btrim(_text(r[name])) != "") & (room > least), _left(F.btrim(_text(r[name])), 220))
    title = lambda name, of: F.when(of.isNotNull() & (F.btrim(_text(r[name])) != ""), _left(F.btrim(_text(r[name])), 120))
    section, document = synopsis("section_synopsis", 560), synopsis("document_synopsis", 760)
    shown = {
        "chunk_id": r["chunk_id"], "document_id": r["document_id"].cast("string"), "chunk_index": r["chunk_index"], "page_start": r["page_start"], "page_end": r["page_end"], "section_path": _listed(r["section_path"], 6),
        "section_title": r["section_title"], "chunk_role": r["chunk_role"], "text": _left(r["text"], most),
        "section_synopsis": section, "section_synopsis_title": title("section_synopsis_title", section), "document_synopsis": document, "document_synopsis_title": title("document_synopsis_title", document),
    }
    return shown, F.length(_text(r["text"])) > most


def _assertion(r: Column, room: Column) -> tuple[Fields, Column]:
    shown = {c: r[c] for c in ("assertion_id", "chunk_id", "subject_entity_id", "predicate", "object_entity_id", "object_literal")}
    shown |= {"chunk_id": r["chunk_id"].cast("string"), "confidence": F.coalesce(r["confidence"].cast("double"), F.lit(0.0))}
    short = (json_size(shown) > room) & (room > 0)
    return shown | {"object_literal": F.when(short, _left(r["object_literal"], _room(0, room, 200))).otherwise(r["object_literal"])}, short


def _asset(r: Column, room: Column) -> tuple[Fields, Column]:
    trusted, made, summary = _text(r["trusted_text"]), _text(r["generated_text"]), _text(r["page_summary"])
    text, most, sure = F.when(trusted != "", trusted).otherwise(made), _room(160, room, 480), trusted != ""
    told = F.btrim(summary) != ""
    shown = {
        "asset_id": r["asset_id"], "document_id": r["document_id"].cast("string"), "page_number": r["page_number"], "asset_type": r["asset_type"], "label": _text(r["label"]), "important_terms": _listed(r["important_terms"], 8),
        "linked_chunk_ids": _listed(r["linked_chunk_ids"], 6), "link_types": _listed(r["link_types"], 4), "max_link_confidence": r["max_link_confidence"], "text_trust": F.when(sure, "deterministic").otherwise("generated"), "text": _left(text, most),
        "page_summary": F.when(sure & told, _left(summary, 220)), "generated_page_summary": F.when(~sure & told & (room > 760), _left(summary, 220)),
        "generated_description": F.when(sure & (made != "") & (made != trusted) & (room > 720), _left(made, F.least(most, F.lit(320)))),
    }
    return shown, F.length(text) > most


def _sensor(r: Column, room: Column) -> tuple[Fields, Column]:
    most = _room(140, room, 520)
    names = ("sensor_name", "sensor_type", "place_id", "place_name", "external_place_id", "hive_id", "external_hive_id", "hive_name", "location_label", "metric_name")
    shown = {"sensor_row_id": r["sensor_row_id"], "sensor_id": r["sensor_id"]} | {n: _text(r[n]) for n in names}
    shown |= {n: r[n] for n in ("unit", "latest_value", "latest_observed_at", "window_start_at", "window_end_at", "sample_count", "min_value", "max_value", "avg_value", "delta_value")}
    shown |= {"reading_ids": _listed(r["reading_ids"], 8), "recent_points": F.slice(r["recent_points"], 1, 6), "summary_text": _left(r["summary_text"], most)}
    return shown, F.length(_text(r["summary_text"])) > most


def _entity(r: Column, room: Column) -> tuple[Fields, Column]:
    aliases = _listed(r["aliases"], 4)
    shown = {c: r[c] for c in ("entity_id", "canonical_name", "entity_type")} | {"aliases": F.when((F.size(aliases) > 0) & (room > 220), aliases)}
    return shown, F.lit(False)


_CHAIN_NESTED = ("supporting_assertion_ids", "supporting_evidence_ids", "steps")


def _chain(r: Column, room: Column) -> tuple[Fields, Column]:
    most = F.floor(_room(160, room, 260) / 3).cast("int")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    step = lambda s: F.struct(
        *(_text(s[n]).alias(n) for n in ("assertion_id", "subject_name", "predicate", "object_name")), _left(s["object_literal"], most).alias("object_literal"), number(s["confidence"]).alias("confidence"), _listed(s["evidence_ids"], 2).alias("evidence_ids")
    )
    shown = {n: _text(r[n]) for n in ("chain_id", "shared_entity_id", "shared_entity_name")} | {"chain_score": number(r["chain_score"])}
    shown |= {"supporting_assertion_ids": _listed(r["supporting_assertion_ids"], 4), "supporting_evidence_ids": _listed(r["supporting_evidence_ids"], 6), "steps": F.transform(F.slice(r["steps"], 1, 2), step)}
    short = (json_size(shown, _CHAIN_NESTED) > room) & (F.size(shown["steps"]) > 0)
    return shown | {"steps": F.when(short, F.slice(shown["steps"], 1, 1)).otherwise(shown["steps"])}, short


def _evidence(r: Column, room: Column) -> tuple[Fields, Column]:
    most = _room(120, room, 180)
    return {"evidence_id": r["evidence_id"], "assertion_id": r["assertion_id"], "excerpt": _left(r["excerpt"], most)}, F.length(_text(r["excerpt"])) > most


#: The kinds of context rows by name; their rows are structs with the fields that the renderer reads.
KINDS = {
    "chunk": Kind(_chunk, ("section_synopsis", "section_synopsis_title", "document_synopsis", "document_synopsis_title"), ("section_path",)),
    "assertion": Kind(_assertion),
    "asset": Kind(_asset, ("page_summary", "generated_page_summary", "generated_description"), ("important_terms", "linked_chunk_ids", "link_types")),
    "sensor": Kind(_sensor, nested=("reading_ids", "recent_points")),
    "entity": Kind(_entity, ("aliases",), ("aliases",)),
    "chain": Kind(_chain, nested=_CHAIN_NESTED),
    "evidence": Kind(_evidence),
}
