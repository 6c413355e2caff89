"""The classifier's held-out accuracy, and the pipeline stage by stage."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from stratalode.llm import near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup
from stratalode.llm._support import buffer_of
from tests.llm.test_near import brute
from tests.llm.test_repeats import brute_words

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_classifier.score(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    truth = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    right = np.mean([g.predicted == q for g, q in truth])
    good, bad = [g.score for g, q in truth if q], [g.score for g, q in truth if not q]
    auc = np.mean([x > y for x in good for y in bad])
    assert right > 0.9 and auc > 0.9, (right, auc)
    hidden = labels.withColumn("quality", (1 - labels.quality).cast("int")).where(quality_classifier.held_out())
    again = quality_classifier.score(docs, labels.where(~quality_classifier.held_out()).union(hidden))
    assert {r.doc_id: r.score for r in again.collect()} == {d: r.score for d, r in got.items()}


def test_classifier_odd_inputs(spark, stored):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality_classifier.score(stored, labels).collect()} == {0.7}
    assert quality_classifier.score(stored.limit(0), labels).count() == 0
    assert quality_classifier.score(stored, labels.limit(0)).count() == stored.count()


def test_features():
    texts = ["A b. A b. A b.", "", "x | y | z", "one\ntwo\none\none"]
    x = dict(zip(quality_classifier.FEATURES, quality_classifier.features(*buffer_of(pa.array(texts))).T, strict=True))
    assert x["pipes"].tolist() == [0, 0, 2 / 5, 0] and x["duplicate_lines"][3] == 0.5
    assert x["repeated_trigrams"][0] == 2 / 6 and x["distinct_words"][0] == 2 / 6 and x["log_words"][1] == 0


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, docs, sizes = source.columns, source, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "quality_rules":
            assert 0.5 * len(before) < len(after) < len(before) and all(before[r.doc_id] == r for r in after)
        if name == "near_dedup":
            assert {r.doc_id for r in after} == set(brute([r.asDict() for r in before.values()]).values())
        if name == "substring_dedup":
            want = brute_words([r.asDict() for r in before.values()], 13)
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == want[r.doc_id][0] - want[r.doc_id][1] for r in after) and len(after) == len(before)
        sizes.append(len(after))
    tokens = collections.Counter()
    for r in after:
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(before) and all(r.doc_tokens == tokens[r.doc_id] for r in after)
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert run.count() == sizes[-1]


HELPERS = ("row", "key", "spans", "block", "order", "at", "base", "rank", "__id", "__block", "__spans", "__order", "__at", "__rank", "__base", "g0", "x0", "v1", "m0")


def test_tables_with_the_helpers_own_names(spark, stored):
    """Columns named as an operator's helpers are pass through every operator that returns documents."""
    docs = stored.drop("n_words").withColumns({c: F.lit(f"own {c}") for c in HELPERS})
    for f in (near_dedup.keep_one, substring_dedup.remove, suffix_dedup.remove, lambda d: corpus_pipeline.rules(spark, d, ""), lambda d: sharding.shuffle_into_shards(d, shards=3)):
        out = f(docs)
        assert set(docs.columns) <= set(out.columns) and out.count() > 0
        assert tuple(out.select(*HELPERS).distinct().first()) == tuple(f"own {c}" for c in HELPERS)
    assert quality_rules.judge(docs).count() == docs.count() and near_dedup.report(docs).count() == docs.count()


def test_rules_judge_rows_that_share_an_id_apart(spark, stored):
    good = "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(9))
    rows = [(None, good, "en", "s"), (None, "# " * 70, "en", "s"), (5, good + " end", "en", "s"), (5, "$ % " * 60, "en", "s")]
    docs = stored.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = [r.text for r in corpus_pipeline.rules(spark, docs, "").collect()]
    assert good in kept and good + " end" in kept and rows[1][1] not in kept and rows[3][1] not in kept
