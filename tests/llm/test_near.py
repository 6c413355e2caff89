"""BagMinHash near-dedup against exact multiset Jaccard."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from stratalode.llm import near_dedup
from stratalode.llm._support import buffer_of

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = SPACED.findall(text or "")
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(x, y):
    return 1.0 if x == y else sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(rows):
    bags, root = {r["doc_id"]: bag(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(bags[a], bags[b]) >= 0.8:
                a1, b1 = sorted((find(a), find(b)))
                root[b1] = a1
    return {a: find(a) for a in ids}


def test_classes(stored, rows):
    got = {r.doc_id: r.class_id for r in near_dedup.report(stored).collect()}
    assert got == brute(rows)
    one = near_dedup.keep_one(stored)
    assert one.columns == stored.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(got.values()))
    assert near_dedup.report(stored.limit(0)).count() == 0


def test_rows_without_an_id_and_with_the_same_one(spark):
    """Copies are found whatever their ids; of a class one row stays, with an id where there is one."""
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"{x}{rng.randint(0, 10**6)}" for _ in range(60)) for x in "abcd")
    rows = [(2, a), (None, a + " more"), (3, b), (None, b + " more"), (None, c), (None, c), (7, d), (7, d), (7, a + " other"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, __id int").repartition(3)
    assert sorted(map(tuple, near_dedup.report(docs).collect()), key=str) == sorted([(2, 2), (None, 2), (3, 3), (None, 3), (None, None), (None, None), (7, 7), (7, 7), (7, 2), (8, 8), (None, 8)], key=str)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, a), (3, b), (None, c), (7, d), (8, None)], key=str)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = f"e{rng.randint(0, 10**6)}"
        rows.append({"doc_id": k, "text": " ".join(w)})
    rows += [{"doc_id": 1000 + k, "text": " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100))} for k in range(50)]
    docs = spark.createDataFrame(pa.Table.from_pylist(rows)).repartition(4)
    assert {r.doc_id: r.class_id for r in near_dedup.report(docs).collect()} == brute(rows)


def test_star_of_copies_that_are_near_the_original_only(spark):
    rng = random.Random(8)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for k in range(401):
        w = list(base)
        for at in rng.sample(range(5, 295), 6) if k != 200 else ():
            w[at] = f"e{rng.randint(0, 10**6)}"
        rows.append({"doc_id": k, "text": " ".join(w)})
    bags = [bag(r["text"]) for r in rows]
    assert all(jaccard(bags[200], b) >= 0.8 for b in bags) and jaccard(bags[0], bags[400]) < 0.8
    docs = spark.createDataFrame(pa.Table.from_pylist(rows)).repartition(4)
    assert {r.class_id for r in near_dedup.report(docs).collect()} == {0}


def test_overlaps():
    rng = np.random.default_rng(1)
    shared = np.arange(50, dtype=np.uint32)
    bags = [np.unique(np.concatenate([shared[rng.random(50) < 0.8], rng.integers(50, 3000, k % 40).astype(np.uint32)])) for k in range(300)]
    bags[7] = bags[7][:0]
    left, right = np.arange(0, 120), np.arange(100, 300)
    got = near_dedup.overlaps(bags, left, right)
    assert all(got[x, y - 100] == len(np.intersect1d(bags[x], bags[y])) for x in left for y in right if x != y)


def test_signature_is_unbiased_for_multisets():
    rng = random.Random(2)
    pairs = []
    for _ in range(150):
        base = [rng.choice(["a b c d e", "q r s t u", *(f"w{k} x y z v" for k in range(40))]) for _ in range(60)]
        other = [x if rng.random() < 0.8 else f"n{rng.random()}" for x in base]
        pairs.append((" ".join(base), " ".join(other * rng.choice([1, 2]))))
    texts = [t for p in pairs for t in p]
    buf, off = buffer_of(pa.array(texts))
    owner, shingle, count = near_dedup.multisets(buf, off)
    assert count.max() > 3
    sig = near_dedup.signatures(owner, shingle, count, len(texts))
    errors = [(sig[2 * k] == sig[2 * k + 1]).mean() - jaccard(bag(a), bag(b)) for k, (a, b) in enumerate(pairs)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    assert (sig != 0xFFFFFFFF).mean() > 0.999


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(500 + k, 501 + k) for k in range(60)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rng, written, real = random.Random(2), [], near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name, *a: written.append(name) or real(df, name, *a))
    path = [(k, k + 1) for k in range(1000)] + [(5000 - k, 4999 - k) for k in range(0, 400)] + [(9000, 9000 + k) for k in range(1, 50)] + [(9001 + k, 10_000) for k in range(3)]
    rng.shuffle(path)
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 if k <= 1000 else 4600 if k <= 5000 else 9000 for e in path for k in e}
    assert len(written) < 30, written
