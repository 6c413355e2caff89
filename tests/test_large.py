"""What keeps queries from growing faster than their tables: their plans, and golden cases of what was rewritten for that."""

import re

import pytest

from stratalode.operators import budget as B
from stratalode.operators import chunks
from stratalode.operators import grounding as G
from stratalode.plans import budget as BP
from stratalode.plans import chunks as CP
from stratalode.plans import context as XP
from stratalode.plans import quality as QP
from stratalode.plans.catalog import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables_of(spark, path, texts):
    rows = [(k, x, "en", "src1", len(x or "")) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return Tables(spark, str(path))


def test_pages_are_joined_within_their_row(spark, tmp_path):
    assert "FlatMapGroups" not in plan(CP.norm_page(Tables(spark, SF))) and "hashpartitioning" not in plan(CP.norm_page(Tables(spark, SF)))
    texts = ["a-\nb", "one\ntwo\n\nthree-\n\nfour", "THE HEADING\nsome text-\nTHE OTHER\nmore", "-\n-\nx", "", "\n\nend-\n", None]
    got = {r.doc_id: r.text for r in CP.norm_page(tables_of(spark, tmp_path, texts)).collect()}
    assert got == {0: "ab", 1: "one two\n\nthree-\n\nfour", 2: "THE HEADING\n\nsome text-\n\nTHE OTHER\n\nmore", 3: "x", 4: "", 5: "end-"}


@pytest.mark.parametrize("query", [CP.build_chunks, CP.force_flush])
def test_chunks_come_from_one_reading(spark, query):
    assert plan(query(Tables(spark, SF))).count("Scan parquet") == 1 and plan(query(Tables(spark, SF))).count("hashpartitioning(doc_id") == 1


def test_a_heading_that_no_block_takes_stands_alone(spark):
    rows = [(1, 0, 1, "heading", "A", ["A"], 0, 1), (1, 1, 1, "paragraph", "other", ["B"], 2, 7), (1, 2, 1, "heading", "C", ["C"], 8, 9), (1, 3, 1, "paragraph", "x", ["D"], 10, 11), (1, 4, 1, "paragraph", "mine", ["C"], 12, 16), (None, 0, 1, "heading", "N", ["N"], 0, 1), (None, 1, 1, "paragraph", "y", ["N"], 2, 3)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, page int, block_type string, text string, section_path array<string>, char_start long, char_end long")
    got = {(r.doc_id, r.pos, r.block_type): r.text for r in chunks.units(blocks).collect()}
    assert got == {(1, 0, "heading"): "A", (1, 1, "paragraph"): "other", (1, 3, "paragraph"): "x", (1, 4, "paragraph"): "C\n\nmine", (None, 0, "heading"): "N", (None, 1, "paragraph"): "N\n\ny"}


@pytest.mark.parametrize("query", [CP.syn_text, CP.syn_document])
def test_synopses_need_no_group_of_pandas_rows(spark, query):
    assert "FlatMapGroups" not in plan(query(Tables(spark, SF))) and plan(query(Tables(spark, SF))).count("hashpartitioning(doc_id") == 1


def test_synopses_of_synopses(spark):
    a, b, c = (f"This is a {x} sentence that is long enough to count" for x in ("first", "second", "third"))
    rows = spark.createDataFrame([(1, [[f"{a}. {b}", f"{a}. {b}"], [c]])], "doc_id long, said array<array<string>>")
    assert chunks.synopses(rows, ["doc_id"], "said", parts=4, budget=960).first().synopsis == f"{a} {b} {c}"
    assert chunks.synopses(rows.selectExpr("doc_id", "said[1] AS said"), ["doc_id"], "said").first().synopsis == c


def test_a_filter_on_the_verdict_measures_texts_once(spark):
    shown = QP.revalidate_apply(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("array_sort(regexp_extract_all(") == 1 and shown.count("Filter (status") == 1


def test_review_effects_validates_once(spark):
    assert "regexp" not in plan(QP.review_effects(Tables(spark, SF)))


def test_noise_counts_characters_that_clean_text_lacks(spark):
    row = spark.createDataFrame([("a\u00e9 \U0001f600#x.",), ("",), ("{{}}",)], "t string").select(QP.Q.noise(QP.F.col("t")).alias("n")).collect()
    assert [r.n for r in row] == [3 / 7, 1.0, 1.0]


def test_claims_are_judged_once_and_their_texts_not_sent_with_each_term(spark):
    t = Tables(spark, SF)
    assert "posexplode" not in plan(XP.ground_subset(t)) and "posexplode" not in plan(XP.ground_review(t))
    assert not re.search(r"Aggregate \[[^\]]*claim#", XP.judged(t)._jdf.queryExecution().optimizedPlan().toString())
    answers = spark.createDataFrame([(1, 1, "Hives hold 12 frames. Wax is made by bees.", "what of frames?"), (None, 2, "Bees fly far.", "")], "g long, k long, answer string, question string")
    evidence = spark.createDataFrame([(1, 5, 5, "hives hold 12 frames")], "g long, at long, id long, text string")
    got = {(r.k, r.place): (r.claim, r.supported, r.evidence_ids) for r in G.support(answers, evidence, ["g"], ["k"]).collect()}
    assert got == {(1, 0): ("Hives hold 12 frames.", True, ["5"]), (1, 1): ("Wax is made by bees.", False, []), (2, 0): ("Bees fly far.", False, [])}


def test_a_budget_renders_each_row_once(spark):
    shown = BP.kept(Tables(spark, SF), "entity")._jdf.queryExecution().optimizedPlan().toString()
    assert B.once(BP.F.lit(3), lambda v: v + v) is not None and shown.count("to_json") <= 16, shown.count("to_json")


def test_one_block_takes_a_heading_even_if_ids_repeat(spark):
    rows = [(1, 0, 1, "heading", "A", ["A"], 0, 1), (1, 0, 1, "heading", "A", ["A"], 2, 3), (1, 1, 1, "paragraph", "x", ["A"], 4, 5), (1, 1, 1, "paragraph", "x", ["A"], 6, 7)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, page int, block_type string, text string, section_path array<string>, char_start long, char_end long")
    assert sorted((r.text, r.char_end) for r in chunks.units(blocks).collect()) == [("A\n\nx", 5), ("x", 7)]


def test_rows_of_one_id_are_measured_by_all_their_words(spark, tmp_path):
    words = lambda a, b: f"{a} " * 3 + " ".join(f"{b}{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(22)) + "."
    rows = [(1, words("same", "p")), (1, words("same", "q")), (2, words("same", "p")), (3, words("other", "p") + "\x0b" * 30 + "."), (None, "same " * 30)]
    spark.createDataFrame([(k, x, None, "src1", len(x)) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    got = sorted((r.doc_id or 0, "repetitive" in r.reasons) for r in QP.validate_chunk(t).collect())
    assert got == [(0, False), (1, True), (1, True), (2, False), (3, False)]
    assert all(None not in r.quality_flags for r in QP.enrich_chunk(t).collect())
    assert sorted((r.doc_id or 0, r.repetitive) for r in QP.repetitive(t).collect()) == [(0, True), (1, False), (2, False), (3, False)]
    assert {r.doc_id for r in QP.validate_chunk(t).collect() if "ocr_noise" in r.reasons} == {3}


@pytest.mark.parametrize("name", ["g_score", "g_chains"])
def test_neighbours_go_to_their_query_once(spark, name):
    """Lines move to their order once, ends and seeds to their node, what a seed took back to its query; nothing else moves but the orders."""
    from stratalode.plans import graph as GP

    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        shown = plan(getattr(GP, name)(Tables(spark, SF)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", shown)) - shown.count("ReusedExchange") == 5
