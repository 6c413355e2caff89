"""Budgets of rows against a plain fold over rendered JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratalode.operators import budget as B


def size(row):
    return len(json.dumps(row, ensure_ascii=False))


def fold(rows, limit, show):
    """Plain version: rows in order, first oversize row cut and final."""
    kept, used = [], 0
    for at, row in enumerate(rows):
        got = show(row, max(0, limit - used))
        if not kept and size(got) > limit:
            got = show(row, max(40, limit)) | {"truncated": True}
            while size(got) > limit:
                name = next((n for n in B.CUT_FIELDS if len(got.get(n) or "") > 27), None)
                if name is None:
                    break
                got[name] = got[name][: max(24, len(got[name]) // 2)].rstrip() + "..."
            return [(at, size(got), got)]
        if used + size(got) <= limit:
            kept.append((at, size(got), got))
            used += size(got)
    return kept


def evidence(row, room):
    most = max(120, room - 180)
    out = {"evidence_id": row[0], "assertion_id": row[1], "excerpt": (row[2] or "")[:most]}
    return out | ({"truncated": True} if len(row[2] or "") > most else {})


def entity(row, room):
    out = {"entity_id": row[0], "canonical_name": row[1], "entity_type": None}
    return out | ({"aliases": row[2][:4]} if row[2] and room > 220 else {})


def assertion(row, room):
    out = {"assertion_id": row[0], "chunk_id": "c", "subject_entity_id": "s", "predicate": row[1], "object_entity_id": None, "object_literal": row[2], "confidence": 0.5}
    if size(out) > room > 0:
        out |= {"object_literal": (row[2] or "")[: max(0, room - 200)], "truncated": True}
    return out


TYPES = {
    "evidence": "g int, at int, evidence_id string, assertion_id string, excerpt string",
    "entity": "g int, at int, entity_id string, canonical_name string, aliases array<string>",
    "assertion": "g int, at int, assertion_id string, predicate string, object_literal string",
}


def run(spark, kind, groups, limit):
    df = spark.createDataFrame([(g, k, *r) for g, rows in groups.items() for k, r in enumerate(rows)], TYPES[kind])
    if kind == "entity":
        df = df.withColumn("entity_type", F.lit(None).cast("string"))
    if kind == "assertion":
        df = df.selectExpr("*", "'c' chunk_id", "'s' subject_entity_id", "cast(null as string) object_entity_id", "0.5D confidence")
    out = {}
    for r in B.budget(df, "g", ["at"], limit, B.KINDS[kind]).orderBy("g", "at").collect():
        row = {k: v for k, v in r.asDict(recursive=True).items() if k not in ("g", "at", "size", "truncated") and not (v is None and k in B.KINDS[kind].optional)}
        out.setdefault(r.g, []).append((r["at"], r["size"], row | ({"truncated": True} if r.truncated else {})))
    return out


def text(rng, n):
    return "".join(rng.choice('ab c"\\é\n,:') for _ in range(n))


@pytest.mark.parametrize("limit", [90, 250, 700, 2000])
@pytest.mark.parametrize("kind,show", [("evidence", evidence), ("entity", entity), ("assertion", assertion)])
def test_matches_the_plain_fold(spark, kind, show, limit):
    rng = random.Random(limit)
    last = (lambda: [text(rng, 9) for _ in range(rng.randint(0, 6))]) if kind == "entity" else lambda: rng.choice([None, text(rng, rng.choice([5, 60, 300, 3000]))])
    groups = {g: [(f"id{k}", text(rng, rng.randint(0, 30)), last()) for k in range(rng.randint(1, 7))] for g in range(25)}
    want = {g: fold(rows, limit, show) for g, rows in groups.items()}
    assert run(spark, kind, groups, limit) == {g: kept for g, kept in want.items() if kept}


def test_first_row_over_the_budget_is_halved_and_final(spark):
    got = run(spark, "evidence", {1: [("e", "a", "word " * 400), ("f", "b", "x")], 2: [("e", "a", "x"), ("f", "b", "y" * 500), ("g", "c", "z")]}, 150)
    (at, size_, row), *rest = got[1]
    assert at == 0 and not rest and size_ <= 150 and row["truncated"] and row["excerpt"].endswith("...")
    assert [at for at, *_ in got[2]] == [0, 2]  # what doesn't fit is skipped, what follows may fit


@pytest.mark.parametrize("kind", ["chunk", "asset", "sensor", "chain"])
def test_wide_kinds_show_their_fields(spark, kind):
    long = "'" + "word " * 300 + "'"
    rows = {
        "chunk": f"'c1' chunk_id, 7 document_id, 0 chunk_index, 1 page_start, 2 page_end, array('a','b','c','d','e','f','g') section_path, 't' section_title, 'body' chunk_role, {long} text, 'syn' section_synopsis, ' ' section_synopsis_title, 'doc' document_synopsis, 'D' document_synopsis_title",
        "asset": f"'a1' asset_id, 7 document_id, 3 page_number, 'figure' asset_type, null label, array('x') important_terms, array('c') linked_chunk_ids, array('l') link_types, 0.5D max_link_confidence, {long} trusted_text, 'made' generated_text, 'sum' page_summary",
        "sensor": f"'r' sensor_row_id, 's' sensor_id, 'n' sensor_name, 't' sensor_type, 1 place_id, 'p' place_name, null external_place_id, 2 hive_id, null external_hive_id, 'h' hive_name, null location_label, 'temp' metric_name, 'C' unit, 1.5D latest_value, '2024' latest_observed_at, null window_start_at, null window_end_at, 3 sample_count, 1D min_value, 2D max_value, 1.5D avg_value, 0D delta_value, array('1') reading_ids, array('9') recent_points, {long} summary_text",
        "chain": f"'k' chain_id, 'e' shared_entity_id, 'E' shared_entity_name, 0.5D chain_score, array('a','b') supporting_assertion_ids, array('v') supporting_evidence_ids, array(named_struct('assertion_id','a','subject_name','s','predicate','p','object_name','o','object_literal',{long},'confidence',0.5D,'evidence_ids',array('v')), named_struct('assertion_id','b','subject_name','s','predicate','p','object_name','o','object_literal','','confidence',0.5D,'evidence_ids',array('w'))) steps",
    }[kind]
    df = spark.sql(f"SELECT 1 g, 0 at, {rows}")
    full = B.budget(df, "g", ["at"], 9000, B.KINDS[kind]).first().asDict(recursive=True)
    tight = B.budget(df, "g", ["at"], 500 if kind == "chain" else 900, B.KINDS[kind]).first().asDict(recursive=True)
    for got, limit in ((full, 9000), (tight, 900)):
        row = {k: v for k, v in got.items() if k not in ("g", "at", "size", "truncated") and not (v is None and k in B.KINDS[kind].optional)}
        assert size(row | ({"truncated": True} if got["truncated"] else {})) == got["size"] <= limit
    assert tight["truncated"] and not full["truncated"]
    if kind == "chunk":
        assert full["section_path"] == list("abcdef") and full["section_synopsis_title"] is None and full["document_synopsis_title"] == "D"
    if kind == "chain":
        assert len(full["steps"]) == 2 and len(tight["steps"]) == 1


def test_an_object_without_arrays_is_sized_by_its_fields(spark):
    """Its commas and colons aren't looked for in its text (F14), whatever the text holds."""
    texts = ['a "b", c: d', "\\\\,:", '\\",', "", None]
    rows = spark.createDataFrame([(k, t, ["x,:", None] if k % 2 else None) for k, t in enumerate(texts)], "k int, t string, a array<string>")
    size = B.json_size({"k": F.col("k"), "t": F.col("t")})
    assert "regexp_replace" not in rows.select(size)._jdf.queryExecution().optimizedPlan().toString()
    got = rows.select("k", "t", "a", size.alias("flat"), B.json_size({"t": F.col("t"), "a": F.col("a")}, ("a",)).alias("deep")).collect()
    for r in got:
        assert r.flat == len(json.dumps({"k": r.k, "t": r.t})) and r.deep == len(json.dumps({"t": r.t, "a": r.a})), r
