"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratalode.llm import _sketch, substring_dedup, suffix_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, n):
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = SPACED.findall(r["text"] or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), r["doc_id"])
    out = {}
    for r in rows:
        w = SPACED.findall(r["text"] or "")
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < r["doc_id"] for j in range(k, k + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[r["doc_id"]] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(rows, width):
    count = {}
    for r in rows:
        b = (r["text"] or "").encode()
        for k in range(len(b) - width + 1):
            count[b[k : k + width]] = count.get(b[k : k + width], 0) + 1
    out = {}
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[r["doc_id"]] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(params=[False, True])
def hot(request, monkeypatch):
    """Once as in production, once with every repeated key hot and tiny buffers."""
    if request.param:
        monkeypatch.setattr(_sketch, "HOT", 2)
        monkeypatch.setattr(suffix_dedup, "FLUSH_HOT", 50)
        monkeypatch.setattr(substring_dedup, "FLUSH", 50)


@pytest.mark.parametrize("n", [13, 4])
def test_substring(stored, rows, n):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.report(stored, n).collect()}
    assert got == brute_words(rows, n) and any(v[1] for v in got.values())


def test_substring_removes(spark, stored):
    out = substring_dedup.remove(stored)
    assert out.columns == stored.columns and out.count() == stored.count()
    assert substring_dedup.remove(stored.limit(0)).count() == 0


@pytest.mark.parametrize("width", [200, 50])
def test_suffix(stored, rows, width, hot):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.report(stored, width).collect()}
    assert got == brute_bytes(rows, width) and any(v[1] for v in got.values())


def test_suffix_on_low_entropy(spark, hot):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(700)) for _ in range(20)] + ["a" * 500, "a" * 300 + "b" * 300, "ab" * 300, "é" * 150, None, ""]
    texts += [texts[0][100:400] + texts[1][:350], "z" + texts[0] + "z", texts[2]]
    rows = [{"doc_id": k, "text": t} for k, t in enumerate(texts)]
    docs = spark.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))).repartition(6)
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.report(docs).collect()} == brute_bytes(rows, 200)
    assert suffix_dedup.report(docs.limit(0)).count() == 0
    assert suffix_dedup.remove(docs).count() == len(rows)


def test_levels_find_what_a_dictionary_finds():
    rng = np.random.default_rng(0)
    values, index = rng.integers(0, 300, 2000).astype(np.uint64), suffix_dedup.SuffixLevels(2000)
    cuts = sorted({0, 2000, *rng.integers(0, 2000, 40).tolist()})
    for a, b in zip(cuts, cuts[1:]):
        v = values[a:b]
        index.add(index.order(v % np.uint64(7), v << np.uint64(20)), v, np.arange(a, b))
    counts = np.bincount(values.astype(int))
    assert (index.matched == (counts[values.astype(int)] > 1)).all()
    sizes = [len(x[0]) for x in index.levels]
    assert all(a > b for a, b in zip(sizes, sizes[1:]))
