"""Entity search over both sides of assertions, and vector search within what a query may see."""

import random

import numpy as np

from stratalode.operators import entities as E
from stratalode.operators import vector_index as V


def plain_entities(entities, assertions, evidence, q, limit):
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in q.lower()).split() if len(w) >= 3][:8]
    out = []
    for e, name, kind in entities:
        rows = [(a, d, (lit or "").lower(), (x or "").lower()) for a, d, s, o, lit in assertions if e in (s, o) for x in [v for k, v in evidence if k == a] or [None]]
        fields = [name.lower(), (kind or "").lower(), e.lower()]
        hit = [(a, d) for a, d, lit, x in rows if any(w in f for w in words for f in [*fields, lit, x])]
        if not hit:
            continue
        best = sum(40 * name.lower().startswith(w) + 24 * (w in fields[0]) + 10 * (w in fields[1]) + 6 * (w in fields[2]) + 5 * any(w in r[2] for r in rows) + 3 * any(w in r[3] for r in rows) for w in words)
        out.append((-best, -len({a for a, _ in hit}), -len({d for _, d in hit}), name, e))
    return [(e, -s, -a, -d, k + 1) for k, (s, a, d, _, e) in enumerate(sorted(out)[:limit])]


def test_entities_match_the_plain_version(spark, monkeypatch):
    rng = random.Random(3)
    words = ["bee", "Bees", "honey", "wax", "queen", "hive x", "Éclat", "mite"]
    entities = [(f"e{k}_{rng.choice(words)}", f"{rng.choice(words)} {rng.choice(words)}", rng.choice([*words, None])) for k in range(25)]
    ids = [e for e, *_ in entities]
    assertions = [(f"a{k}", rng.randrange(9), rng.choice(ids), rng.choice([*ids, None]), rng.choice([*words, None])) for k in range(60)]
    assertions.append(("self", 1, ids[0], ids[0], "honey"))
    evidence = [(f"a{rng.randrange(60)}", rng.choice(words)) for _ in range(40)]
    queries = [(1, "Bee honey bee wax"), (2, "mite"), (3, "no such"), (4, ""), (5, "queen hive eclat e1 bees wax mite honey zzz bee")]
    tables = [spark.createDataFrame(r, s) for r, s in ((entities, "entity_id string, canonical_name string, entity_type string"), (assertions, "assertion_id string, document_id int, subject_entity_id string, object_entity_id string, object_literal string"), (evidence, "assertion_id string, excerpt string"), (queries, "query_id int, q string"))]
    want = {(q, *r) for q, text in queries for r in plain_entities(entities, assertions, evidence, text, 6)}
    assert {tuple(r) for r in E.search_entities(*tables).collect()} == want and want
    monkeypatch.setattr(E, "TERM_BLOCK", 3)
    assert {tuple(r) for r in E.search_entities(*tables).collect()} == want


def test_vectors_within_scope(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).tolist(), f"d{k % 9}", f"t{k % 3}", "staged" if k % 5 == 4 else "ready") for k in range(200)]
    rows += [(1000 + k, rows[0][1], "d0", "t0", "ready") for k in range(3)]
    index = V.write_index(spark.createDataFrame(rows, "vec_id long, vec array<double>, document_id string, tenant_id string, publish_state string"), str(tmp_path / "index"))
    asked = [(1, rows[0][1], "t0", None), (2, rows[4][1], "t1", ["d1", "d4", "none"]), (3, rows[5][1], "t2", []), (4, rows[6][1], "nobody", None), (5, rows[7][1], "t1", ["d7"])]
    queries = spark.createDataFrame(asked, "query_id long, vec array<double>, tenant_id string, document_ids array<string>")

    def want():
        for q, v, t, ds in asked:
            near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, r[1], strict=True)), 9), r[0]) for r in rows if r[3] == t and r[4] == "ready" and (ds is None or r[2] in ds))[:5]
            yield from ((q, i, k + 1) for k, (_, i) in enumerate(near))

    for block in (2048, 2):
        assert {(r.query_id, r.vec_id, r["rank"]) for r in V.search(index, queries, 5, block=block).collect()} == set(want())
    queries.write.parquet(str(tmp_path / "queries"))
    stored = spark.read.parquet(str(tmp_path / "queries")).where("query_id < 5")
    plan = V.visible(index, stored)._jdf.queryExecution().executedPlan().toString()
    assert "publish_state" in plan and "dynamicpruning" in plan.lower()
    assert V.search(index, queries.limit(0), 5).count() == 0


def test_many_entities_are_met_as_classes(spark):
    """Entities of few kinds, many times more than are asked for: right results, and asks never meet the assertions one by one."""
    rng = random.Random(5)
    kinds = [f"{a} {b}" for a in ("red", "blue", "old") for b in ("rod", "bolt", "gear")]
    entities = [(f"e{k}", rng.choice(kinds), rng.choice(["red", "plain"])) for k in range(240)]
    assertions = [(f"a{k}", rng.randrange(40), f"e{rng.randrange(240)}", f"e{rng.randrange(240)}", rng.choice(["urgent", "high", None, ""])) for k in range(700)]
    evidence = [(f"a{rng.randrange(700)}", rng.choice(["steel", "wood"])) for _ in range(300)]
    asks = ["red rod urgent steel", "steel red urgent rod", "old gear gear high wood", "urgent wood", "blue steel", "bolt", "zzz steel high"]
    queries = [(k, asks[k % len(asks)]) for k in range(20)]
    tables = [spark.createDataFrame(r, s) for r, s in ((entities, "entity_id string, canonical_name string, entity_type string"), (assertions, "assertion_id string, document_id int, subject_entity_id string, object_entity_id string, object_literal string"), (evidence, "assertion_id string, excerpt string"), (queries, "query_id int, q string"))]
    found = E.search_entities(*tables)
    want = {(q, *r) for q, text in queries for r in plain_entities(entities, assertions, evidence, text, 6)}
    assert {tuple(r) for r in found.collect()} == want and want
    grouped = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert grouped and not any("query_id" in x and ("entity_id" in x or "assertion_id" in x) for x in grouped)


def test_texts_are_searched_once(spark):
    """What literals and excerpts tell is stored once; each later step reads that and not the tables."""
    tables = [spark.createDataFrame(r, s) for r, s in (([("e1", "red rod", "red"), ("e2", "old gear", None)], "entity_id string, canonical_name string, entity_type string"), ([("a1", 1, "e1", "e2", "urgent"), ("a1", 1, "e1", "e2", "urgent"), ("a2", 1, "e1", "e1", None), ("a3", 2, "e2", None, "low"), ("a3", 3, "e2", "e1", "low")], "assertion_id string, document_id int, subject_entity_id string, object_entity_id string, object_literal string"), ([("a1", "steel"), ("a2", "steel")], "assertion_id string, excerpt string"), ([(1, "steel low"), (2, "red urgent"), (3, "low steel"), (None, "steel")], "query_id int, q string"))]
    found = E.search_entities(*tables)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
    got = {tuple(r) for r in found.collect()}
    assert got == {(1, "e1", 8, 3, 2, 1), (1, "e2", 8, 2, 3, 2), (3, "e1", 8, 3, 2, 1), (3, "e2", 8, 2, 3, 2), (2, "e1", 79, 3, 2, 1), (2, "e2", 5, 1, 1, 2), (None, "e1", 3, 2, 1, 1), (None, "e2", 3, 1, 1, 2)}
