"""Grounding against a plain version over sets, and golden answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratalode.operators import grounding as G


def plain_terms(text):
    return {w for raw in re.findall(r"[a-z0-9%:/.\-]{3,}", (text or "").lower()) if (w := raw.strip(".,;:()[]{}")) and w not in G.STOPWORDS}


def plain_claims(text):
    text = (text or "").strip()
    parts = [p.strip() for p in re.split(r"(?<=[.!?;])\s+|\n+", text) if p.strip()]
    return ([p[:320] for p in parts if len(plain_terms(p)) >= 2 or re.search("[0-9]", p)] or ([text[:320]] if text else []))[:8]


def plain_support(claim, question, rows):
    words, asked = plain_terms(claim), plain_terms(question)
    novel, numeric = words - asked, {w for w in words if re.search("[0-9]", w)}
    ids, covered, any_ = [], set(), False
    for _, id_, text in sorted(rows):
        met = words & plain_terms(text)
        any_ |= bool(met)
        covered |= met
        if met & (novel | numeric):
            ids.append(id_)
    if not words:
        return False, []
    if numeric - covered:
        ok = False
    elif not novel:
        ok = any_
    else:
        ok = len(novel & covered) / len(novel) >= (1.0 if len(novel) <= 2 else 0.6)
    return ok, list(dict.fromkeys(ids))[:4]


def frames(spark, answers, evidence):
    a = spark.createDataFrame([(g, k, *r) for g, rows in answers.items() for k, r in enumerate(rows)], "g int, k int, question string, answer string, question_type string").repartition(3)
    e = spark.createDataFrame([(g, *r) for g, rows in evidence.items() for r in rows], "g int, at int, id string, text string").repartition(3)
    return a, e


def test_matches_the_plain_version(spark):
    rng = random.Random(4)
    words = ["bees", "honey", "3000", "wax", "the", "with", "queen.", "12:30", "é", "brood", "(hive)", "nectar", "flow"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "; ", "\n", "! "]) for _ in range(n))
    answers = {g: [(say(4), rng.choice([say(rng.randint(0, 40)), None, "", "ab"]), rng.choice(["fact", "explanation", "comparison"])) for _ in range(3)] for g in range(30)}
    evidence = {g: [(k, f"e{k % 5}", rng.choice([say(6), None, ""])) for k in range(rng.randint(0, 9))] for g in range(25)}
    a, e = frames(spark, answers, evidence)
    judged = G.support(a, e, ["g"], ["k"]).cache()
    got = {(r.g, r.k, r.place): (r.claim, r.supported, r.evidence_ids) for r in judged.collect()}
    want, passed = {}, {}
    for g, rows in answers.items():
        for k, (q, text, kind) in enumerate(rows):
            found = [(c, *plain_support(c, q, evidence.get(g, []))) for c in plain_claims(text)]
            want |= {(g, k, p): f for p, f in enumerate(found)}
            missed = [c for c, ok, _ in found if not ok]
            relaxed = kind in G.RELAXED
            ratio = round((len(found) - len(missed)) / max(1, len(found)), 4)
            enough = not any(re.search("[0-9]", c) for c in missed) and len(missed) <= (1 if relaxed and len(found) >= 3 else 0)
            passed[g, k] = (ratio, bool(found) and enough and ratio >= (1.0 if len(found) <= 2 else 0.66 if relaxed else 0.75), missed[:6])
    assert got == want and any(ok for _, ok, _ in want.values()) and any(not ok for _, ok, _ in want.values())
    checked = G.check(a, judged, ["g", "k"])
    assert {(r.g, r.k): (r.supported_ratio, r.passed, r.unsupported_claims) for r in checked.collect()} == passed


HONEY = ["Bees collect nectar from flowers and store it in a honey-stomach before carrying it back to the hive.", "Workers pass nectar between house bees, which gradually reduces moisture and converts it into honey."]
BROOD = ["Queens lay eggs in brood cells.", "Worker bees feed larvae in open brood."]


@pytest.mark.parametrize(
    "kind,question,answer,rows,missed,passed",
    [
        ("explanation", "How do bees produce honey?", "Bees collect nectar from flowers and store it in a honey-stomach. Workers pass nectar between house bees, which reduces moisture and turns it into honey. They then fan the nectar until it ripens.", HONEY, "They then fan the nectar until it ripens.", True),
        ("fact", "How many eggs does a queen lay?", "Queens lay eggs in brood cells. Worker bees feed larvae in open brood. A queen lays 3000 eggs per day.", BROOD, "A queen lays 3000 eggs per day.", False),
    ],
)
def test_relaxed_and_strict_answers(spark, kind, question, answer, rows, missed, passed):
    a, e = frames(spark, {1: [(question, answer, kind)]}, {1: [(k, f"ev-{k + 1}", x) for k, x in enumerate(rows)]})
    got = G.check(a, G.support(a, e, ["g"], ["k"]), ["g", "k"]).first()
    assert abs(got.supported_ratio - 0.6667) < 1e-4 and got.unsupported_claims == [missed] and got.passed is passed


def test_supported_subset(spark):
    claims = [
        (1, 0, "Bees collect nectar from flowers and store it in a honey-stomach.", True, ["ev-1", "ev-2"]), (1, 1, "The bees then fan the nectar until it ripens.", False, []),
        (2, 0, "Queens lay eggs in brood cells.", True, ["ev-1"]), (2, 1, "A queen lays 3000 eggs per day.", False, []),
        (3, 0, "Based on the provided sources: it is so.", True, ["b", "a"]), (3, 1, "Second claim.", True, ["a"]), (4, 0, "A look-up.", True, ["x"]), (5, 0, "None of it.", False, []),
    ]
    judged = spark.createDataFrame(claims, "k int, place int, claim string, supported boolean, evidence_ids array<string>")
    kinds = spark.createDataFrame([(1, "explanation"), (2, "explanation"), (3, "fact"), (4, "visual_lookup"), (5, "fact"), (6, "fact")], "k int, question_type string")
    checked = G.check(kinds, judged, ["k"])
    got = {r.k: (r.answer, r.evidence_ids) for r in G.supported_subset(checked, judged, ["k"]).collect()}
    assert got == {1: (claims[0][2], ["ev-1", "ev-2"]), 3: ("it is so. Second claim.", ["b", "a"])}
    assert {r.k: r.passed for r in checked.collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_model_verdicts_and_review(spark):
    rows = [(1, 0, 0, "A b c d.", True, "evidence", ["1", "9"]), (1, 0, 1, "C d e f.", True, "world_knowledge", []), (2, 0, 0, "Lays 3000 eggs.", True, "world_knowledge", []), (3, 0, 0, "Fine words here.", True, "evidence", ["9"])]
    verdicts = spark.createDataFrame(rows, "g int, k int, place int, claim string, supported boolean, basis string, ids array<string>")
    answers = spark.createDataFrame([(1, 0, "Alpha beta. Gamma delta.", True), (2, 0, "Lays 3000 eggs.", True), (3, 0, "Fine words here.", True), (4, 0, "No verdict came.", None)], "g int, k int, answer string, verdict boolean")
    evidence = spark.createDataFrame([(1, 0, "1", "x"), (2, 0, "9", "x")], "g int, at int, id string, text string")
    got = {r.g: (r.supported, r.world_claims, r.passed) for r in G.judge_verdicts(verdicts, answers, evidence, ["g"], ["k"]).collect()}
    assert got == {1: (2, 1, True), 2: (0, 0, False), 3: (0, 0, False), 4: (0, 0, False)}
    base = {"abstained": False, "abstain_reason": "", "open_world": False, "open_world_fallback": False, "last_resort": False, "method": "claim_verifier", "world_claims": 0, "unsupported": 0, "supported_ratio": 1.0, "confidence": 0.9, "supports": 1}
    cases = [({}, ""), ({"supports": 0}, "chunk_only_answer"), ({"confidence": 0.5, "supports": 0}, "low_answer_confidence"), ({"supported_ratio": 0.7}, "weak_grounding_support"), ({"unsupported": 1, "world_claims": 1}, "world_knowledge_support"), ({"method": "supported_subset", "unsupported": 1}, "supported_subset"), ({"abstained": True, "abstain_reason": "Weak  Grounding!", "open_world": True}, "weak_grounding"), ({"abstained": True, "abstain_reason": "odd"}, "model_abstained")]
    for change, reason in cases:
        status, why = G.review_state({k: F.lit(v) for k, v in (base | change).items()})
        assert tuple(spark.range(1).select(status, why).first()) == ("unreviewed" if reason in ("", "chunk_only_answer") else "needs_review", reason)
