"""The divergence audit against plain integer sums over all terms, and against SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from stratalode.llm import source_divergence as D

COLUMNS = ("lang", "source", "part", "item", "value", "rank")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200, scale=10**9):
    langs, groups = {}, {}
    documents = {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs.setdefault(lang, Counter()).update(terms)
        groups.setdefault((lang, source), Counter()).update(terms)
        documents.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang in langs:
        kept = [t for t, n in documents[lang].items() if n >= least]

        def p(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + scale * (count[t] + 1) // (n + len(kept)) for t in kept}

        q = p(langs[lang])
        own = {s: p(c) for (l, s), c in groups.items() if l == lang}
        for s, ps in own.items():
            pair = [(-sum((ps[t] - r[t]) ** 2 // r[t] for t in kept), o.encode()) for o, r in own.items() if o != s]
            term = [(-((ps[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[lang, s][t] and ps[t] > q[t]]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])) for k, (v, i) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, source string, text string, count int, term string").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def some(n, seed, words=60, sources=5):
    rng = random.Random(seed)
    names = [f"w{'abcdefghij'[k % 10]}{'xyzäöü'[k % 6]}{'Q' * (k // 30)}" for k in range(words)]
    return [(rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(sources)] + [None]), "".join(rng.choice(names[: rng.randint(3, words)]) + rng.choice([" ", "\n", "-", "7", ", "]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 400, 6_000_000])
def test_matches_all_terms(spark, limit):
    """Spilled runs of any size merge to the same frequencies."""
    rows = some(120, limit)
    assert found(D.audit(frame(spark, rows), limit=limit)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [("en", "a", None), ("en", "b", ""), ("en", None, "12 34"), ("xx", "a", "one two"), ("xx", "b", "one two one"), (None, None, "Äb É é\x00É"), ("yy", "only", "x x x")]
    rows += [("zz", f"s{k % 3}", "same same Same same") for k in range(9)] + [("zz", "s9", "long ü " * 3000 + "x" * 5000)] * 3
    monkeypatch.setattr(D, "PIECE", 100)
    want = brute(rows)
    assert any(r[0] == "en" and r[2] == "pair" and r[4] == 0 for r in want)
    assert found(D.audit(frame(spark, rows))) == want
    assert D.audit(frame(spark, rows).limit(0)).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert found(D.audit(frame(spark, rows))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_ranks_and_pairs_at_once(spark, monkeypatch):
    rows = some(200, 9, words=100, sources=12)
    monkeypatch.setattr(D, "PAIRS", 7)
    assert found(D.audit(frame(spark, rows), least=2, top=4, scale=1000)) == brute(rows, 2, 4, 1000)


def test_pieces_cut_no_term():
    text = b"aa bb" * 50 + "ü".encode() * 400 + b" end"
    cut = list(D._pieces(text, 64))
    assert b"".join(cut) == text and len(cut) > 3
    assert [w for c in cut for w in D._TERM.findall(c)] == D._TERM.findall(text)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    want = c.sql(D.ORACLE_SQL)
    assert want.columns == list(COLUMNS)
    got = found(D.op13_source_divergence(spark, f"/root/testdata/{sf}"))
    assert got == sorted(want.fetchall()) and got
