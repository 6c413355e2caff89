"""Rules, pruning, statuses and tables of extractions: golden cases, and pruning against a plain version."""

import json
import random

import pytest

from pyspark.sql import functions as F

from stratalode.operators import extraction as X
from stratalode.operators import knowledge as K

ONTO = X.Ontology({"Animal": None, "Cat": "Animal", "Food": None, "Loop": "Loop"}, {"eats": ("object", "Animal", "Food"), "weighs": ("datatype", "Animal", "xsd:decimal"), "near": ("object", None, "Elsewhere")})


def frame(spark, rows):
    raw = spark.createDataFrame([(c, f"d{c}", json.dumps(e), None) for c, e in rows], "chunk_id string, document_id string, payload string, error string")
    return X.read_payloads(raw)


def mention(i, text="x"):
    return {"mention_id": i, "text": text}


def entity(i, kind, name, mentions, confidence=0.9):
    return {"candidate_id": i, "type": kind, "name": name, "mention_ids": mentions, "confidence": confidence}


def relation(i, subject, predicate, object_=None, literal=None, confidence=0.9):
    return {"relation_id": i, "subject": subject, "predicate": predicate, "object": object_, "literal": literal, "confidence": confidence}


def evidence(i, supports, excerpt="shown"):
    return {"evidence_id": i, "supports": supports, "excerpt": excerpt}


CASE = {
    "mentions": [mention("m1", "Tom"), mention("m2", "fish"), mention("m3", "")],
    "entities": [entity("e1", "Cat", "Tom", ["m1", "m3", "m9"]), entity("e2", "Food", "fish", ["m2"]), entity("e3", "Rock", "", [], 0.5), entity("e4", "Food", "alone", ["m3"])],
    "relations": [
        relation("r1", "e1", "eats", "e2"), relation("r2", "e2", "eats", "e1"), relation("r3", "e1", "weighs", None, "4.5"), relation("r4", "e1", "weighs", None, "heavy", 0.6), relation("r5", "e9", "sings"),
        relation("r6", "e1", "weighs", "e2"), relation("r7", "e1", "eats", None, "fish"), relation("r8", "e1", "eats", "e8"),
    ],
    "evidence": [evidence("v1", ["r1", "r2", "r3", "r4"], "as told"), evidence("v2", ["r6", "r7", "r8"], ""), evidence("v3", [], "x")],
}


def test_every_rule_is_told(spark):
    got = X.violations(frame(spark, [("k", CASE)]), ONTO).first().errors
    assert set(got) == {
        "empty_mention_text:m3", "unknown_mention:e1:m9", "invalid_entity_type:Rock", "empty_entity_name:e3", "missing_mentions:e3", "low_entity_confidence:e3", "invalid_subject_type:r2:Food->Animal", "invalid_object_type:r2:Cat->Food",
        "low_relation_confidence:r4", "invalid_decimal_literal:r4", "invalid_predicate:sings", "missing_subject:r5", "missing_relation_object:r5", "missing_evidence:r5", "invalid_object_candidate_for_datatype:r6",
        "invalid_literal_for_object_property:r7", "missing_object:r8", "orphan_evidence:v3", "empty_evidence_excerpt:v2",
    }
    assert len(got) == len(set(got))


def test_a_relation_of_wrong_types(spark):
    onto = X.Ontology({"Drone": None, "Colony": None, "Egg": None, "HiveProduct": None}, {"produces": ("object", "Colony", "HiveProduct")})
    case = {"mentions": [mention("m1"), mention("m2")], "entities": [entity("a", "Drone", "drone", ["m1"]), entity("b", "Egg", "egg", ["m2"])], "relations": [relation("r1", "a", "produces", "b")], "evidence": [evidence("v", ["r1"])]}
    assert X.violations(frame(spark, [("k", case)]), onto).first().errors == ["invalid_subject_type:r1:Drone->Colony", "invalid_object_type:r1:Egg->HiveProduct"]
    assert X.judge(frame(spark, [("k", case)]), onto).first().status == "skipped"


def plain_prune(e, least=0.7):
    above = {c: X.Ontology.lineage(ONTO, c) for c in ONTO.classes}
    warnings, mentions = [], [m for m in e["mentions"] if m["text"]]
    heard, good = {m["mention_id"] for m in mentions}, []
    for x in e["entities"]:
        ids = [m for m in x["mention_ids"] if m in heard]
        errors = [f"invalid_entity_type:{x['type']}"] * (x["type"] not in above) + [f"empty_entity_name:{x['candidate_id']}"] * (not x["name"]) + [f"low_entity_confidence:{x['candidate_id']}"] * (x["confidence"] < least) + [f"missing_mentions:{x['candidate_id']}"] * (not ids)
        warnings += errors
        if not errors:
            good.append(x | {"mention_ids": ids})
    kinds, held = {x["candidate_id"]: x["type"] for x in good}, []
    for r in e["relations"]:
        i, errors = r["relation_id"], []
        kind, dom, ran = ONTO.predicates.get(r["predicate"], (None, None, None))
        s, o = kinds.get(r["subject"]), kinds.get(r["object"])
        errors += [f"invalid_predicate:{r['predicate']}"] * (kind is None) + [f"missing_subject:{i}"] * (s is None) + [f"missing_object:{i}"] * (r["object"] is not None and o is None)
        errors += [f"missing_relation_object:{i}"] * (r["object"] is None and not r["literal"]) + [f"low_relation_confidence:{i}"] * (r["confidence"] < least) + [f"invalid_subject_type:{i}:{s}->{dom}"] * (s is not None and dom in above and dom not in above[s])
        if r["object"] is not None:
            if kind == "datatype":
                errors.append(f"invalid_object_candidate_for_datatype:{i}")
            elif o is not None and ran in above and ran not in above[o]:
                errors.append(f"invalid_object_type:{i}:{o}->{ran}")
        elif r["literal"]:
            if kind == "object":
                errors.append(f"invalid_literal_for_object_property:{i}")
            elif ran == "xsd:decimal" and r["literal"] == "heavy":
                errors.append(f"invalid_decimal_literal:{i}")
        warnings += errors
        if not errors:
            held.append(r)
    ids, shown = {r["relation_id"] for r in held}, []
    for v in e["evidence"]:
        supports = [s for s in v["supports"] if s in ids]
        if not v["excerpt"]:
            warnings.append(f"empty_evidence_excerpt:{v['evidence_id']}")
        elif not supports:
            warnings.append(f"orphan_evidence:{v['evidence_id']}")
        else:
            shown.append(v | {"supports": supports})
    told = {s for v in shown for s in v["supports"]}
    warnings += [f"missing_evidence:{r['relation_id']}" for r in held if r["relation_id"] not in told]
    held = [r for r in held if r["relation_id"] in told]
    if not held:
        return {p: [] for p in X.PARTS}, warnings
    ends = {x for r in held for x in (r["subject"], r["object"])}
    good = [x for x in good if x["candidate_id"] in ends]
    return {"mentions": [m for m in mentions if any(m["mention_id"] in x["mention_ids"] for x in good)], "entities": good, "relations": held, "evidence": shown}, warnings


def some(rng):
    often = lambda usual, *rare: usual if rng.random() < 0.85 else rng.choice(rare)
    return {
        "mentions": [mention(f"m{k}", often("a", "")) for k in range(rng.randint(2, 4))],
        "entities": [entity(f"e{k}", often(rng.choice(["Cat", "Animal", "Food"]), "Rock", "Loop"), often("n", ""), [f"m{rng.randint(0, 4)}" for _ in range(rng.randint(1, 3))], often(0.9, 0.7, 0.5)) for k in range(rng.randint(1, 4))],
        "relations": [relation(f"r{k}", f"e{rng.randint(0, 3)}", rng.choice(["eats", "weighs", "near", "sings"]), *rng.choice([(None, "4.5"), (f"e{rng.randint(0, 3)}", None), (None, ""), (None, "heavy"), ("e0", "4.5")]), often(0.9, 0.1)) for k in range(rng.randint(0, 6))],
        "evidence": [evidence(f"v{k}", [f"r{rng.randint(0, 5)}" for _ in range(rng.randint(0, 5))], often("shown", "")) for k in range(rng.randint(0, 4))],
    }


def test_pruning_matches_the_plain_version(spark):
    rng = random.Random(11)
    cases = {f"c{k}": some(rng) for k in range(400)} | {"golden": CASE, "unshown": CASE | {"evidence": [evidence("v", ["r1"], "")]}}
    got = {r["chunk_id"]: r for r in (x.asDict(recursive=True) for x in X.prune(frame(spark, cases.items()), ONTO).collect())}
    for c, e in cases.items():
        want, warnings = plain_prune(e)
        assert {p: got[c][p] for p in X.PARTS} == want and got[c]["warnings"] == warnings, c
    assert sum(bool(got[c]["relations"]) for c in cases) > 10 and got["golden"]["relations"] and not any(got["unshown"][p] for p in X.PARTS)
    assert len(X.prune(frame(spark, cases.items()), ONTO).columns) == 8


def test_one_pass_without_a_shuffle(spark):
    plan = X.judge(frame(spark, [("k", CASE)]), ONTO)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def simple(name, kind="Cat"):
    return {"mentions": [mention("m1"), mention("m2")], "entities": [entity("a", kind, name, ["m1"]), entity("b", "Food", "Fish", ["m2"])], "relations": [relation("r1", "a", "eats", "b"), relation("r2", "a", "weighs", None, "4.5")], "evidence": [evidence("v", ["r1", "r2"]), evidence("w", ["r2"], "again")]}


def test_tables_quarantine_and_replay(spark):
    rows = [("1", "d1", json.dumps(simple("Tom C.")), None), ("2", "d2", json.dumps(simple("tom c")), None), ("3", "d3", json.dumps(simple("Bad"))[:-9], None), ("4", "d4", None, "timeout"), ("5", "d5", "[]", None), ("6", "d6", "{}", None), ("7", "d7", json.dumps(simple("Rex", "Animal")), None)]
    schema = "chunk_id string, document_id string, payload string, error string"
    judged = X.judge(X.read_payloads(spark.createDataFrame(rows, schema)), ONTO).cache()
    assert {r.chunk_id: r.status for r in judged.collect()} == {"1": "validated", "2": "validated", "3": "quarantined", "4": "quarantined", "5": "quarantined", "6": "skipped", "7": "validated"}
    assert {r.chunk_id: r.errors for r in judged.collect() if r.chunk_id in "346"} == {"3": ["extractor_error:invalid_json"], "4": ["extractor_error:timeout"], "6": ["empty_relation_set"]}
    g = X.graph_tables(judged)
    assert {tuple(r) for r in g["entities"].collect()} == {("cat_tom_c", "tom c", "Cat", "d1"), ("food_fish", "Fish", "Food", "d1"), ("animal_rex", "Rex", "Animal", "d7")}
    a = {r.assertion_id: (r.subject_entity_id, r.predicate, r.object_entity_id, r.object_literal) for r in g["assertions"].collect()}
    assert a["1:r1"] == ("cat_tom_c", "eats", "food_fish", None) and a["7:r2"] == ("animal_rex", "weighs", None, "4.5") and len(a) == 6
    assert {r.evidence_id for r in g["evidence"].where("assertion_id LIKE '1:%'").collect()} == {"1:r1:v", "1:r2:v", "1:r2:w"}
    assert g["raw"].count() == 7
    again = spark.createDataFrame([("3", "d3", json.dumps(simple("Good")), None), ("4", "d4", None, "timeout"), ("1", "d1", "{}", None)], schema)
    after = X.replay(judged, again, ONTO)
    assert {r.chunk_id: r.status for r in after.collect()} == {"1": "validated", "2": "validated", "3": "validated", "4": "quarantined", "5": "quarantined", "6": "skipped", "7": "validated"}
    assert {r.chunk_id: r.status for r in X.replay(after, again, ONTO).collect()} == {r.chunk_id: r.status for r in after.collect()}


@pytest.mark.parametrize("name,want", [("Cat", ["Cat", "Animal"]), ("Loop", ["Loop"]), ("Gone", ["Gone"])])
def test_lineage_ends(name, want):
    assert ONTO.lineage(name) == want


@pytest.mark.parametrize(
    "name,want",
    [("The Honey Bees", "honey bee"), ('"An Apiary"', "apiary"), ("Smoker (small)", "smoker small"), ("berries", "berry"), ("Propolis", "propolis"), ("Apis / mellifera-sp", "apis mellifera sp"), ("glass", "glass"), ("ﬁeld notes", "field note"), ("gas", "gas"), (None, ""), ("ties", "tie")],
)
def test_surfaces_of_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(K.surface(F.col("n"))).first()[0] == want


def test_generic_tails(spark):
    rows = [("two hundred bees", "bee", False), ("100 bees", "bee", True), ("many thousands of bees", "bee", True), ("bees", "bee", False), ("bees in 12", "bees", True), ("queen bee", "bee", False), ("", "bee", False), ("frame", "", False), ("wooden frame of", "wooden frame", True)]
    df = spark.createDataFrame(rows, "n string, a string, w boolean")
    assert [r[0] for r in df.select(K.has_generic_tail(K.name_tokens(F.col("n")), K.name_tokens(F.col("a")))).collect()] == [r[2] for r in rows]


def test_extraction_without_a_model(spark):
    text = "Come with us: only that way leads in and by here it is. " + "x" * 300
    docs = spark.createDataFrame([(1, text), (2, "by"), (3, "nothing"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in K.heuristic(docs, spark).collect()}
    want = [(f"e{k}", label, kind, text.find(label.lower()), text.find(label.lower()) + len(label)) for k, (label, kind) in enumerate((("By", "Link"), ("It", "NearPointer"), ("In", "Place"), ("That", "Pointer")), 1)]
    assert [(e.id, e.name, e.type, e.start, e.end) for e in got[1].entities] == want
    assert [(r.id, r.predicate, r.subject, r.object) for r in got[1].relations] == [("r1", "limits", "e1", "e2"), ("r2", "joins", "e1", "e2"), ("r3", "names", "e1", "e2")] and len(got[1].excerpt) == 240
    assert [e.name for e in got[2].entities] == ["By"] and got[2].relations == [] and set(got) == {1, 2}


def test_phrases_are_heard_within_the_row(spark):
    texts = ["That near-pointer: here, THAT it near  pointer", "near\npointer", "pointer near", "nearpointer pointers", "", None, "- İt Keep it."]
    asked = ["here", "it", "keep", "near pointer", "pointer", "that", "Here", "near  pointer", "a-b"]
    got = [r.h if r.h is None else [tuple(x) for x in r.h] for r in spark.createDataFrame([(x,) for x in texts], "text string").select(K.heard(F.col("text"), asked).alias("h")).collect()]
    assert got[:6] == [[(0, "that"), (1, "near pointer"), (2, "pointer"), (3, "here"), (5, "it")], [(0, "near pointer"), (1, "pointer")], [(0, "pointer")], [], [], None]
    assert [x for x in got[6] if x[1] in ("keep", "it")] == [(2, "keep"), (3, "it")]


def test_classes_take_the_first_of_their_aliases(spark):
    rows = [("B", "x"), ("A", "x"), ("A", "y z"), ("C", "q"), ("B", "w"), ("A", "x")]
    df = spark.createDataFrame([("w q x, y z",), ("y z w",), ("none",)], "text string").select(K.tags(K.heard(F.col("text"), ["w", "q", "x", "y z"]), rows).alias("tags"))
    got = df.select("tags", K.firsts(F.col("tags")).alias("es")).collect()
    assert [tuple(x) for x in got[0].tags] == [(0, "B", "w"), (1, "C", "q"), (2, "A", "x"), (2, "B", "x"), (3, "A", "y z")]
    assert [[tuple(x) for x in r.es] for r in got] == [[(1, "B", "w"), (2, "C", "q"), (3, "A", "x")], [(1, "A", "y z"), (2, "B", "w")], []]
    none = spark.createDataFrame([], "name string, alias string")
    assert K.tag(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark, none).collect() == []


def test_extractions_read_the_texts_once_and_move_nothing(spark):
    from stratalode.plans import knowledge as KP
    from stratalode.plans.catalog import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    shown = KP.raw_payloads(t)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Scan parquet") == 1 and "hashpartitioning" not in shown and "Join" not in shown and "Generate" not in shown
    shown = K.tag(t("documents"), spark)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Scan parquet") == 1 and "Join" not in shown
    shown = K.heuristic(t("documents"), spark)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Scan parquet") == 1 and "hashpartitioning" not in shown and "Join" not in shown


def test_what_is_broken_is_told_from_one_reading(spark):
    from stratalode.plans import knowledge as KP
    from stratalode.plans.catalog import Tables

    shown = KP.kg_validate(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("regexp_replace(lower(text") == 1
