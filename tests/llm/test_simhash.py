"""SimHash fingerprints, the Gray-order index and components against brute force."""

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from stratalode.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, far=4):
    """doc_id -> (fingerprint, least doc_id reachable)"""
    code = [plain(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(code[i] ^ code[j]).count("1") <= far:
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(k)] = min(least.get(find(k), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], code[k], least.get(find(k))) for k, r in enumerate(rows)), key=str)


def got(df):
    return sorted(((r[0], r[1] % (1 << 64), r[2]) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_documents_match_brute_force(stored, rows):
    df = S.classes(stored)
    assert got(df) == brute(rows)


def test_whole_table(spark):
    df = S.op12_simhash(spark, "/root/testdata/sf0.001")
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = df.collect()
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in found), key=str) == brute(rows)
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in found)


def test_nulls_repeats_and_empty(spark):
    rows = [{"doc_id": k, "text": t} for k, t in ((9, "a b c d e"), (None, "A B C D E"), (4, " a  b\tc d\ne "), (4, "a b c d e"), (None, None), (7, ""), (None, "x y"), (3, "x y"))]
    df = spark.createDataFrame([(r["doc_id"], r["text"], 1) for r in rows], "doc_id long, text string, fingerprint int")
    assert got(S.classes(df)) == brute(rows)
    assert S.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 200, 30])
def test_random_and_dense_codes(spark, most):
    """Balls of codes that share most bits go through all divisions and tiles; chains longer than far join."""
    rng = np.random.default_rng(most)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for centre in codes[:3]:
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(1, 12, 250)], np.uint64)
        codes = np.concatenate([codes, centre ^ flips])
    chain = np.array([int(codes[5]) ^ ((1 << k) - 1) for k in range(0, 61, 4)], np.uint64)
    codes = np.unique(np.concatenate([codes, chain]))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    want = np.arange(len(codes))
    while True:
        new = np.where(near, want[None, :], len(codes)).min(1)
        if (new == want).all():
            break
        want = new
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fingerprint long").repartition(4)
    found = S.links(df, most=most).collect()
    at = {int(c): k for k, c in enumerate(codes.view(np.int64))}
    root = np.arange(len(codes))
    for a, b in found:
        assert near[at[a], at[b]] or want[at[a]] == want[at[b]]
    root = S.join_roots(root, np.array([at[a] for a, _ in found]), np.array([at[b] for _, b in found]))
    assert (root == want).all()
    assert len(found) <= 25 * len(codes) * max(1, len(codes) // most)


@pytest.mark.parametrize("fan", [2, 16])
def test_index_finds_every_link(fan):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ U(1) << U(9), base ^ U(0b111) << U(40), base ^ U(0b11111)]))
    group = rng.integers(0, 3, len(codes))
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(k)
    order = np.lexsort((rank, group))
    codes, group = codes[order], group[order]
    index = S.GrayIndex(codes, group, fan)
    found = {(int(x), int(y)) for a, b in index.blocks() for x, y in zip(*index.links(a, b), strict=True)}
    assert found == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and bin(int(codes[i] ^ codes[j])).count("1") <= 4}
    assert sorted(k for a, b in index.blocks() for k in range(a, b)) == list(range(len(codes)))


def U(x):
    return np.uint64(x)
