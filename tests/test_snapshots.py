"""Snapshots seen whole or not at all, resumed ingestion, and an index kept in step."""

import pytest
from pyspark.sql import functions as F

from stratalode.operators import ingest as I
from stratalode.operators import retrieval as R
from stratalode.sources import snapshots as N

SCHEMA = "doc string, n int"


def seen(spark, path):
    return sorted((r.doc, r.n, r.snapshot_id) for r in N.active(spark, path, "doc", SCHEMA).collect())


def test_readers_see_old_or_new_rows_only(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert N.pointers(spark, path).count() == 0
    sound = {"positive": F.col("n") > 0}
    report = {r.unit: (r.rows, r.failed, r.state) for r in N.publish(rows(("a", 1), ("a", 2), ("b", 3), ("c", -1), ("c", 5)), path, "s1", "doc", sound).collect()}
    assert report == {"a": (2, [], "active"), "b": (1, [], "active"), "c": (2, ["positive"], "review")}
    first = [("a", 1, "s1"), ("a", 2, "s1"), ("b", 3, "s1")]
    assert seen(spark, path) == first
    N.stage(rows(("a", 9), ("b", 9)), path, "s2")  # staged, and then the writer is gone
    assert seen(spark, path) == first and [r[0] for r in N.pending(spark, path).collect()] == ["s2"]
    N.publish(rows(("a", 7), ("b", None), ("b", 8)), path, "s2", "doc", sound)  # tried again with other rows, one of which can't be judged
    assert seen(spark, path) == [("a", 7, "s2"), ("b", 3, "s1")] and N.pending(spark, path).count() == 0
    N.publish(rows(("b", 4), ("c", 6)), path, "s3", "doc", sound)
    assert seen(spark, path) == [("a", 7, "s2"), ("b", 4, "s3"), ("c", 6, "s3")]
    N.publish(rows(), path, "s4", "doc", sound)
    assert seen(spark, path) == [("a", 7, "s2"), ("b", 4, "s3"), ("c", 6, "s3")]


def test_an_interrupted_run_continues_and_a_second_does_nothing(spark, tmp_path):
    path, calls = str(tmp_path / "work"), {"extract": [], "embed": []}
    jobs = spark.createDataFrame([("a", "chunks_validated"), ("b", "kg_validated"), ("c", "indexed"), ("d", "completed"), ("e", "parsed"), ("f", "chunks_validated")], "document_id string, status string")
    chunks = spark.createDataFrame([(10 * k + j, d, f"text {k} {j}") for k, d in enumerate("abcdef") for j in range(3)], "chunk_id long, document_id string, text string")

    def extract(df):
        calls["extract"].append(sorted(r.chunk_id for r in df.collect()))
        return df.select("chunk_id", "document_id", F.when(F.col("chunk_id") == 51, "quarantined").otherwise("validated").alias("status"))

    def embed(df):
        calls["embed"].append(sorted(r.chunk_id for r in df.collect()))
        return df.select("chunk_id", "document_id", R.dummy_vector(F.col("text")).alias("vec"))

    def broken(df):
        raise OSError("the service is gone")

    with pytest.raises(OSError):
        I.resume(jobs, chunks, path, extract, broken)
    assert calls == {"extract": [[0, 1, 2, 50, 51, 52]], "embed": []}
    got = {r.document_id: (r.was, r.status, r.extracted, r.indexed) for r in I.resume(jobs, chunks, path, extract, embed).collect()}
    assert calls["extract"][1] == [] and calls["embed"] == [[0, 1, 2, 10, 11, 12]]
    assert got == {"a": ("chunks_validated", "completed", 0, 3), "b": ("kg_validated", "completed", 0, 3), "c": ("indexed", "completed", 0, 0), "d": ("completed", "completed", 0, 0), "e": ("parsed", "parsed", 0, 0), "f": ("chunks_validated", "review", 0, 0)}
    again = I.resume(jobs, chunks, path, extract, embed)
    assert calls["extract"][2] == [] and calls["embed"][1] == [] and {(r.extracted, r.indexed) for r in again.collect()} == {(0, 0)}


def test_index_follows_what_is_visible(spark):
    kind = "id int, visible boolean, content string, version string"
    now = spark.createDataFrame([(1, True, "a", "v2"), (2, True, "b", "v2"), (3, True, "c", "v2"), (4, False, "d", "v2"), (5, False, "e", "v2"), (6, True, "f", "v2"), (7, None, "g", "v2")], kind)
    index = spark.createDataFrame([(1, "a", "v2"), (2, "old", "v2"), (3, "c", "v1"), (4, "d", "v2"), (8, "gone", "v2"), (7, "g", "v2")], "id int, content string, version string")
    found = I.changes(now, index)
    assert {tuple(r) for r in found.collect()} == {(2, "update"), (3, "update"), (4, "delete"), (6, "insert"), (7, "delete"), (8, "delete")}
    after = I.applied(now, index, found)
    assert {tuple(r) for r in after.collect()} == {(1, "a", "v2"), (2, "b", "v2"), (3, "c", "v2"), (6, "f", "v2")}
    assert I.changes(now, after).count() == 0


def test_plans_and_documents_kept(spark):
    asked = [("visual_lookup", 6, False, "single", "multimodal_focus", 12, 6, False, False, False, True, "few"), ("fact", 8, False, None, "hybrid_kg_support", 16, 8, False, True, False, False, "few"), ("fact", 8, True, "BROAD ", "hybrid_visual_support", 24, 8, False, True, False, True, "broad"),
             ("definition", 1, False, "odd", "hybrid_kg_support", 5, 4, False, True, False, False, "single"), ("comparison", 12, False, "single", "hybrid_compare", 24, 10, True, True, True, False, "few"), ("procedure", 2, False, "single", "neighbor_expansion", 5, 4, True, True, True, False, "single"),
             ("explanation", 3, True, None, "neighbor_visual_expansion", 9, 4, True, True, True, True, "few")]
    df = spark.createDataFrame([a[:4] for a in asked], "kind string, k int, visual boolean, hint string")
    got = df.select(*(c.alias(n) for n, c in R.plan(F.col("kind"), F.col("k"), F.col("visual"), F.col("hint")).items())).collect()
    assert [tuple(r) for r in got] == [a[4:] for a in asked]
    kept = [("fact", "broad", 9, 1.0, 1.0, 4), ("visual_lookup", "few", 9, 1.2, 1.0, 2), ("visual_lookup", "few", 9, 1.25, 1.0, 1), ("fact", "few", 1, 1.0, None, 1), ("fact", "single", 5, 1.0, 1.0, 1), ("fact", "few", 5, 1.0, 1.0, 3), ("definition", "x", 5, 1.2, 1.0, 1), ("source_lookup", "x", 5, 1.1, 1.0, 2), ("explanation", "x", 3, 1.0, 1.0, 3), ("fact", "x", 2, 1.0, 1.0, 2), ("comparison", "x", 5, 1.0, 1.0, 2)]
    df = spark.createDataFrame([k[:5] for k in kept], "kind string, spread string, documents int, first double, second double")
    assert [r[0] for r in df.select(R.documents_kept()).collect()] == [k[5] for k in kept]
