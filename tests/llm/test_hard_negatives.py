"""Hard negatives by slots against all pairs scored plainly."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import hard_negatives as H

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    """Python integers only; rows of equal id and score are one."""
    usable = {(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, l, [math.floor(scale * float(np.float32(x))) for x in v]) for i, l, v in usable]
    out = []
    for i, l, v in whole:
        if i % 50:
            continue
        met = {(-sum(a * b for a, b in zip(v, w)), j, m == l) for j, m, w in whole if j != i}  # noqa: B905
        first = sorted((s, j) for s, j, same in met if same)[:positives]
        rest = sorted((s, j) for s, j, same in met if not same)
        for ps, pid in first:
            inside = [(s, j) for s, j in rest if low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(i, pid, k + 1, j, -ps, -s) for k, (s, j) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, l, v, "x") for i, l, v in rows], "id long, label int, vector array<float>, slot string").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def some(n, width, seed, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(5)]
    return [(k, rng.randrange(labels), [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = some(400, 8, seed)
    want = brute(rows)
    assert len(want) > 40
    assert found(H.mine(frame(spark, rows), F.col("id") % 50 == 0)) == want


def test_odd_rows(spark):
    rows = some(260, 4, 3, labels=2)
    rows += [(1000, None, [0.1] * 4), (1050, 1, None), (1100, 1, [0.1, None, 0.1, 0.2]), (1150, 0, [float("nan"), 1.0, 1.0, 1.0]), (1200, 0, [math.inf, 0.0, 0.0, 0.0]), (None, 1, [0.5] * 4)]
    rows += [(1300, 1, []), (1350, 0, [0.5, 0.5]), (1351, 1, [0.5] * 9), (1400, 0, [0.0] * 4), (1450, 7, [0.3] * 4)]
    rows += [(2000 + k, k % 2, [0.25, 0.5, 0.25, 0.5]) for k in range(60)]  # ties
    rows += rows[3:6] + rows[100:101] * 3 + [(rows[50][0], 1 - rows[50][1], rows[51][2])]  # repeats, an id with another vector
    assert found(H.mine(frame(spark, rows), F.col("id") % 50 == 0)) == brute(rows)
    assert H.mine(frame(spark, rows).limit(0), F.col("id") % 50 == 0).count() == 0
    assert H.mine(frame(spark, rows[:20]), F.lit(False)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(k, k % 3, [float(np.float32(x * 1e3)) for x in v]) for k, _, v in some(120, 6, 4)]
    assert found(H.mine(frame(spark, rows), F.col("id") % 50 == 0, scale=1 << 16)) == brute(rows, scale=1 << 16)
    huge = H.mine(frame(spark, [(k, 0, [3e38, 1.0]) for k in range(60)] + [(99, 1, [3e38, 2.0])]), F.col("id") % 50 == 0)
    assert huge.count() == 0  # all scores count as the limit, and no window holds it


def test_chunks_and_other_parameters(spark, monkeypatch):
    rows = some(500, 8, 6)
    monkeypatch.setattr(H, "CHUNK_BYTES", 300)
    monkeypatch.setattr(H, "ANCHORS", 3)
    monkeypatch.setattr(H, "ROWS", 50)
    df = H.mine(frame(spark, rows), F.col("id") % 50 == 0, positives=9, negatives=2, low=20, high=80)
    assert found(df) == brute(rows, 9, 2, 20, 80)


def test_slots_are_disjoint_and_cover_the_windows():
    anchor, score = np.array([0, 0, 0, 1, 2]), np.array([1000, 990, 1000, -5, 0])
    upper, lower = H.slots(anchor, score, 4, 50, 95)
    assert upper[0].tolist()[:2] == [950, 940] and lower[0].tolist()[:2] == [941, 495]
    assert (upper[1] < lower[1]).all() and (upper[3] < lower[3]).all() and upper[2, 0] == lower[2, 0] == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    want = c.sql(H.ORACLE_SQL)
    assert want.columns == list(COLUMNS)
    got = found(H.op11_hard_negatives(spark, f"/root/testdata/{sf}"))
    assert got == sorted(want.fetchall()) and got
