"""Golden cases of the folds, the sources and sinks, and the streaming twins."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalode.functions import quality, redaction, sensors
from stratalode.functions import text as T
from stratalode.operators import answers, chunks, context, embedding, evaluation, graph, knowledge, retrieval
from stratalode.plans.catalog import Tables
from stratalode.sources import admin, pages, tables
from stratalode.streaming import sensors as streaming

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("line", "want"),
    [("Chapter.Somewords MaryStone 12Cats", "Chapter. Somewords Mary Stone 12 Cats"), ("so­ft  ﬁne ﬂow", "soft fine flow"), ("ABCde (x)y a(b", "AB Cde (x) y a (b"), ("  a\x00b ", "ab")],
)
def test_normalize_line(spark, line, want):
    assert one(spark, T.normalize_line(F.lit(line))) == want


@pytest.mark.parametrize(("line", "want"), [("INTRODUCTION", True), ("The Life Of Things", True), ("This is a plain sentence that ends here.", False), ("J", False), ("Chapter 12 Of It", False), ("T. Morland, Esq.", False)])
def test_is_heading(spark, line, want):
    assert one(spark, T.is_heading(F.lit(line))) is want


def validate(spark, text, role="body", section="s", kind="book", heading=False, assets=0, confidence=0.0):
    df = spark.createDataFrame([(text,)], "text string")
    return quality.validate(df, "text", *(F.lit(x) for x in (role, section, kind, heading, assets, confidence))).first()


def test_validate(spark):
    prose = "One two three four five six seven. " * 2 + "Words that differ from each other make this text longer, and it reads as prose does; so it should pass."
    assert validate(spark, prose).status == "accepted" and list(validate(spark, prose).reasons) == ['ok']
    assert validate(spark, "Kzpw.").status == "rejected" and "too_few_words" in validate(spark, "Kzpw.").reasons
    assert validate(spark, "[[Page 7]] 3").status == "rejected"
    assert validate(spark, prose, role="front_matter").status == "review"
    assert validate(spark, prose, heading=True).status == "rejected"
    assert validate(spark, "word " * 40).reasons[-1] == "repetitive"
    assert "visual_context" in validate(spark, "A figure that shows a wonderful machinery, assembled.", assets=1, confidence=0.9).reasons
    assert "unknown_document_class" in validate(spark, prose, kind="?").reasons
    assert list(validate(spark, "#### $$$$ %%%% ^^^^ &&&& ****").reasons)[-1:] == ["no_words"] or validate(spark, "#### $$$$ ^^^^ &&&& ****").status == "rejected"


def blocks_of(spark, lines):
    return spark.createDataFrame([(1, k, 1 + k // 4, x) for k, x in enumerate(lines)], "doc_id long, pos int, page int, line string")


def test_section_paths_and_units(spark):
    lines = ["INTRODUCTION", "A first paragraph with some words.", "The Life Of Things", "Another paragraph here.", "", "NEXT PART", "Its text follows."]
    got = {r.pos: r for r in chunks.parsed(blocks_of(spark, lines)).collect()}
    assert got[1].section_path == ["Introduction"] and got[3].section_path == ["Introduction", "The Life Of Things"] and got[6].section_path == ["Next Part"]
    assert got[3].char_start == sum(len(x) + 1 for x in lines[:3]) and 4 not in got
    units = sorted(chunks.units(chunks.parsed(blocks_of(spark, lines))).collect(), key=lambda r: r.pos)
    assert [u.text for u in units] == ["Introduction\n\nA first paragraph with some words.", "The Life Of Things\n\nAnother paragraph here.", "Next Part\n\nIts text follows."]
    made = chunks.linked(chunks.chunked(chunks.units(chunks.parsed(blocks_of(spark, lines))))).orderBy("chunk_index").collect()
    assert len(made) == 3 and made[0].next_chunk_id == made[1].chunk_id and made[2].prev_chunk_id == made[1].chunk_id and made[0].chunk_id.startswith("1:c0000:")


def test_packing_fold():
    rows = [{"doc_id": 1, "pos": k, "page": 1 + k // 3, "block_type": "paragraph", "section_path": [], "text": "x" * 350, "char_start": k, "char_end": k, "types": ["paragraph"]} for k in range(6)]
    out = chunks.fold(rows, 900, 300)
    assert [len(c["text"].split("\n\n")) for c in out] == [2, 2, 2] and [c["page_start"] for c in out] == [1, 1, 2]
    forced = chunks.fold([r | {"text": "x" * 600} for r in rows], 5000, 300)
    assert [len(c["text"].split("\n\n")) for c in forced] == [3, 3]  # a new page ends a chunk of 500 characters or more


def test_synopsis_takes_unused_sentences():
    a, b = "This is the first long sentence of all of them", "Another sentence that is long enough to count"
    assert chunks.synopsis([f"{a}. {b}", f"{a}. {b}", "short"]) == f"{a} {b}"


def test_diversity_may_evict(spark):
    rows = [(1, d, t, s, n) for d, t, s, n in ((1, "aaa bbb ccc", 0.9, 1), (2, "aaa bbb ccc", 0.85, 2), (3, "xxx yyy zzz", 0.8, 3))]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, text string, rerank_score double, new_rank int")
    got = retrieval.diversify(df, k=2).orderBy("place").collect()
    assert [r.doc_id for r in got] == [1, 3]


def test_diversity_caps_a_signature(spark):
    rows = [(1, d, f"word{d} other{d}", 1 - d / 100, d, "a" if d < 6 else "b", "en") for d in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, text string, rerank_score double, new_rank int, title string, section string")
    assert [r.doc_id for r in retrieval.diversify(df, k=6, penalty=0.18, signature=["title", "section"]).orderBy("place").collect()] == [1, 2, 3, 6]


def test_images_that_fill_the_page_are_no_assets(spark):
    html = '<p>x</p><img src="a.png" width="95%" height="90%"><img width="40%" height="100%" src=b.png><img src="c.png" width="900" height="900">'
    got = pages.extract(spark.createDataFrame([(7, html)], "page_id long, html string")).first()
    assert got.images == 3 and list(got.assets) == ["7:image:00", "7:image:01"]


def test_nearest_in_blocks_equals_one_block(spark):
    e = Tables(spark, SF)("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    q = e.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    pick = lambda df: sorted((r.query_id, r.dense_rank, r.doc_id) for r in df.collect())
    assert pick(retrieval.nearest(e, q, 4, block=3)) == pick(retrieval.nearest(e, q, 4))


def test_self_loops_count_once(spark):
    a = spark.createDataFrame([(1, "s", "s", "p", 0.9, 1), (2, "s", "t", "p", 0.8, 1), (3, "u", "s", "p", 0.7, 1)], "assertion_id long, subject string, object string, predicate string, confidence double, document long")
    got = graph.neighbours(a, spark.createDataFrame([("s",)], "seed string")).collect()
    assert sorted((r.assertion_id, r.neighbour) for r in got) == [(1, "s"), (2, "t"), (3, "u")]


def test_ontology(spark):
    cyclic = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", None)], "name string, parent string")
    assert {(r.name, r.ancestor) for r in knowledge.ancestors(cyclic).collect()} >= {("A", "C"), ("A", "A"), ("B", "A")}
    ttl = '@prefix ex: <http://x/> .\nex:Cat a ex:Class ;\n  ex:label "Cat"@en ;\n  ex:subClassOf ex:Animal .\nex:Animal a ex:Class .'
    assert {tuple(r) for r in knowledge.load_turtle(spark, ttl).collect()} == {("Cat", "type", "Class"), ("Cat", "label", "Cat"), ("Cat", "subClassOf", "Animal"), ("Animal", "type", "Class")}


def test_merge_replace_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k long, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k long, v string, t int")
    assert {tuple(r) for r in tables.merge(old, new, ["k"], "t").collect()} == {(1, "c", 1), (2, "b", 5), (3, "e", 1)}
    assert {tuple(r) for r in tables.replace_group(old, new.where("k = 1"), "k").collect()} == {(1, "c", 1), (2, "b", 5)}
    assert tables.delete_where(old, new.where("k = 2"), "k").count() == 1


def test_publish_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    assert tables.publish(df, str(tmp_path / "p"), F.col("k") > 0).count() == 2
    with pytest.raises(ValueError, match="staged"):
        tables.publish(df, str(tmp_path / "q"), F.col("k") > 1)
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert tables.read_text(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    (tmp_path / "q.json").write_text('[{"id": 1, "query": "x"}, {"id": 2, "query": "y"}]')
    assert tables.read_queries(spark, str(tmp_path / "q.json")).count() == 2
    tables.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    (tmp_path / "d.bin").write_bytes(b"p1|p2|p3")
    got = tables.read_pages(spark, str(tmp_path / "d.bin"), lambda raw: raw.decode().split("|"), 2, 9).first().text
    assert got == "[[Page 2]]\n\np2\f[[Page 3]]\n\np3"


def test_admin_sql(spark):
    t = Tables(spark, SF)
    assert admin.run_sql(t, "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name;").count() == 5
    for bad in ("DROP TABLE region", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError, match="SELECT"):
            admin.run_sql(t, bad)


def test_redaction_and_models():
    assert redaction.redact_value({"a": [{"api_token": "x", "b": "y" * 5000}]}, ("token",)) == {"a": [{"api_token": "[redacted]", "b": "y" * 4000 + "..."}]}
    assert tables.clean_json({"a\x00": ["b\x00", 1]}) == {"a": ["b", 1]}
    calls = []

    def flaky(x):
        calls.append(1)
        if len(calls) < 2:
            raise OSError
        return x

    assert embedding.checked(flaky, ["a"], wait=0) == ["a"]
    with pytest.raises(ValueError, match="answers"):
        embedding.checked(lambda x: [], ["a"], wait=0)
    assert pages.is_full_page(9, 9, 10, 9.5) and not pages.is_full_page(5, 5, 10, 10)


def test_rate_limit_counts_allowed_hits_only(spark):
    at = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 2, 11, 12)]
    df = spark.createDataFrame([(k, 1, x) for k, x in enumerate(at)], "event_id long, key long, ts timestamp")
    assert [r.allowed for r in sensors.rate_limit(df, 2, 10).orderBy("event_id").collect()] == [True, True, False, True, True]


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(path)
    return streaming.read_events(spark, path, batch)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    schema = "reading_id long, sensor_id long, observed_at timestamp, metric_name string, numeric_value double, metadata_json string"
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    rows = [(1, 1, at(1), " Temp ", 2.0, "{}"), (2, 1, at(1), "temp", 2.0, "{}"), (3, 1, at(1, 30), "temp", 4.0, None), (4, 2, at(2), "", 1.0, None), (5, 2, at(2), "hum", 1.0, None)]
    s = stream_of(spark, tmp_path, rows, schema)
    assert run(streaming.ingest(s), "ingested", "append").count() == 3
    got = {(r.metric_name, r.n, r["mean"]) for r in run(streaming.rollup(s.where("metric_name <> ''").withColumn("metric_name", F.lower(F.trim("metric_name")))), "rolled", "complete").collect()}
    assert got == {("temp", 3, round(8 / 3, 4)), ("hum", 1, 1.0)}


def test_stream_rate_limit(spark, tmp_path):
    rows = [(1, datetime.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 11, 12)]
    s = stream_of(spark, tmp_path, rows, "key long, ts timestamp")
    assert [(r.allowed, r.refused) for r in run(streaming.rate_limit(s, 2, 10), "limited", "update").collect()] == [(4, 1)]


def test_closure_and_phrases(spark):
    deep = spark.createDataFrame([(f"c{k}", f"c{k + 1}" if k < 60 else None) for k in range(61)], "name string, parent string")
    assert knowledge.ancestors(deep).count() == 60 * 61 // 2
    docs = spark.createDataFrame([(1, "A near pointer, nearly."), (2, "pointer near")], "doc_id long, text string")
    found = {(r.doc_id, r.name, r.alias, r.place) for r in knowledge.tag(docs, spark).collect()}
    assert (1, "NearPointer", "near pointer", 1) in found and (2, "Pointer", "pointer", 0) in found and not any(d == 2 and "near" in a for d, _, a, _ in found)


def test_ad_hoc_sql_with_names_of_its_own(spark):
    from stratalode.plans import catalog
    from stratalode.sources import admin

    t = catalog.Tables(spark, "/root/testdata/sf0.001")
    assert admin.run_sql(t, "WITH region AS (SELECT 1 AS one) SELECT one FROM region").collect()[0].one == 1
    assert admin.run_sql(t, "SELECT extract(YEAR FROM o_orderdate) AS y, count(*) FROM orders GROUP BY 1").count() > 1


def test_context_compression_and_answers(spark):
    from stratalode.operators import context, retrieval

    rows = [(1, k, d, s, x) for k, (d, s, x) in enumerate([("a", 0.9, "alpha beta gamma delta"), ("a", 0.8, "Alpha  beta gamma DELTA"), ("b", 0.7, "alpha beta gamma epsilon"), ("c", 0.5, "zeta theta iota kappa"), ("d", 0.1, "other words here now")])]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, document string, score double, text string")
    assert [(r.doc_id, r.place) for r in retrieval.compress(scored, 10, 280).orderBy("place").collect()] == [(0, 1), (3, 2)]
    plan = lambda spread: spark.createDataFrame([(1, "fact", spread)], "query_id long, kind string, spread string")
    assert [r.doc_id for r in retrieval.compress(scored, 10, 280, plan("broad")).orderBy("place").collect()] == [0, 3, 4]
    assert [r.doc_id for r in retrieval.compress(scored, 1, 280, plan("single")).collect()] == [0]
    said = [None, "", "plain", '[1, 2]', '{"answer": " x ", "confidence": 2}', 'so {"answer": "y", "citations": [{"chunk_id": "k"}]}!', "{broken"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, c string").select("k", context.coerce_answer(F.col("c"), F.array(F.lit("c1"))).alias("r")).orderBy("k").select("r.*").collect()
    assert [(r.answer, r.confidence, list(r.used_chunk_ids), r.plain) for r in got] == [("", 0.74, ["c1"], True), ("", 0.74, ["c1"], True), ("plain", 0.74, ["c1"], True), ("[1, 2]", 0.74, ["c1"], True), ("x", 2.0, [], False), ("y", 0.0, ["k"], False), ("{broken", 0.74, ["c1"], True)]


def test_links(spark):
    from stratalode.operators import linking

    chunks_ = spark.createDataFrame([(1, 1, 1, 2, "yellow river bridge under repair"), (1, 2, 2, 3, "nothing alike here")], "group long, chunk_id long, page_start long, page_end long, text string")
    assets = spark.createDataFrame([(1, 7, 2, "River bridge"), (1, 8, 9, "elsewhere")], "group long, asset_id long, page long, label string")
    links = linking.scored(linking.on_pages(chunks_, assets))
    assert {(r.chunk_id, r.share, r.confidence) for r in links.collect()} == {(1, 1.0, 0.95), (2, 0.0, None)}
    assert [(r.chunk_id, r.assets, r.best) for r in linking.rollup(linking.best(links)).collect()] == [(1, [7], 0.95)]


def test_graph_expansion_scores_and_chains(spark):
    rows = [  # a1 is what the query found; n1 shares its subject, n2 its object, n3 touches no seed
        ("a1", "cat", "fish", "eats", 0.9, 1, "d1", "cat eats fish"),
        ("n1", "cat", "rest", "leads_to", 0.8, 2, "d1", "cat leads to rest"),
        ("n2", "bear", "fish", "eats", 0.7, 0, "d2", "bear eats fish"),
        ("n3", "dog", "bone", "has_a", 0.99, 5, "d1", "dog has a bone"),
    ]
    a = spark.createDataFrame(rows, "assertion_id string, subject string, object string, predicate string, confidence double, evidence long, document string, surface string")
    base = spark.createDataFrame([(1, "a1", 1)], "query_id long, assertion_id string, place int")
    asked = spark.createDataFrame([(1, "explanation", "why cat rest", ["d1"])], "query_id long, question_type string, q string, documents array<string>")
    near = graph.nearby(base, a)
    assert {(r.seed, r.assertion_id, r.neighbour) for r in near.collect()} == {("cat", "n1", "rest"), ("fish", "n2", "bear")}
    kept = graph.scored(near, a, asked)
    # n1: 0.8 + 0.35 * 2/3 + 0.14 causal + 0.08 evidence + 0.04 seed + 0.08 document; n2: 0.7 + 0.04
    assert {r.assertion_id: r.score for r in kept.collect()} == pytest.approx({"n1": 1.373333, "n2": 0.74}, abs=1e-6)
    got = {r.chain_id: (r.shared, r.score) for r in graph.chains(kept, base, a).collect()}
    assert got["a1|n1"] == ("cat", pytest.approx(0.9 + 0.8 + 0.3 * 2 / 3 + 0.09 + 0.04 - 0.06, abs=1e-6))
    assert got["a1|n2"] == ("fish", pytest.approx(0.9 + 0.7 + 0.3 / 3 + 0.03 + 0.04 - 0.06, abs=1e-6))


@pytest.mark.parametrize(("text", "want"), [
    ("Based on the provided sources: I think it  works.", "it works."), ("According to indexed corpus, yes", "yes"), ("I'm not sure, but it seems fine", "fine"),
    ("It looks like rain", "rain"), ("Here's the short version: no", "no"), ("in plain terms - yes", "yes"), ("The end.", "The end."), ("", ""),
])
def test_clean_answer(spark, text, want):
    assert one(spark, answers.clean_answer(F.lit(text))) == want


@pytest.mark.parametrize(("case", "free", "strict"), [
    ((0, 0.9, "x", False, True), None, "no_valid_citations"), ((0, 0.5, "x", False, True), "no_valid_citations", "no_valid_citations"), ((2, 0.5, "x", True, True), "low_confidence", "low_confidence"),
    ((2, 0.9, " ", True, True), "empty_answer", "empty_answer"), ((2, 0.9, "x", True, False), "model_abstained", "model_abstained"), ((2, 0.9, "x", False, False), None, "weak_grounding"), ((2, 0.55, "x", False, True), None, None),
])
def test_abstain_reason(spark, case, free, strict):
    cols = [F.lit(x) for x in case]
    assert one(spark, answers.abstain_reason(*cols)) == free
    assert one(spark, answers.abstain_reason(*cols, open_world=False)) == strict


def test_preferences_and_style(spark):
    turns = spark.createDataFrame([(1, "Walk me through it"), (1, "and be BRIEF"), (2, "hello"), (3, None), (4, "step by step")], "g long, text string")
    got = {r.g: (r.preferences, r["style"]) for r in answers.preferences(turns, "g").collect()}
    assert got == {1: (["prefer_step_by_step", "prefer_brief_answers"], "concise"), 2: ([], ""), 3: ([], ""), 4: (["prefer_step_by_step"], "procedural")}


def test_stable_facts(spark):
    rows = [(1, 1, "Bees fly", "retrieval_grounded", 0.8, 0, 0), (1, 2, "bees FLY", "user_self_report", 0.9, 0, 0), (1, 3, "I keep bees", "user_self_report", 0.1, 0, 0), (1, 4, "Backed", "retrieval_grounded", 0.5, 1, 0), (1, 5, " ", "user_self_report", 1.0, 3, 3)]
    facts = spark.createDataFrame(rows, "g long, at long, fact string, source_type string, confidence double, assertions long, supports long")
    assert [r.fact for r in answers.stable_facts(facts, "g", 10).orderBy("place").collect()] == ["I keep bees", "Backed", "Bees fly"]
    assert answers.stable_facts(facts, "g", 1).count() == 1


def test_route(spark):
    rows = [(False, "remote", True, False, 0.9), (True, "local", True, False, 0.9), (True, "remote", False, False, 0.9), (True, "remote", True, True, 0.9), (True, "remote", True, False, 0.54), (True, "remote", True, False, None), (True, "remote", True, False, 0.55)]
    df = spark.createDataFrame([(k, "fact", *r, "comparison", 40) for k, r in enumerate(rows)], "k int, kind string, enabled boolean, provider string, has_key boolean, failed boolean, confidence double, router_kind string, router_top_k int")
    got = [(r.source.removeprefix("fallback:"), r.question_type, r.top_k) for r in answers.route(df, F.lit(8)).orderBy("k").collect()]
    assert got == [("disabled", "fact", 8), ("provider_disabled", "fact", 8), ("no_api_key", "fact", 8), ("error", "fact", 8), ("low_confidence", "fact", 8), ("low_confidence", "fact", 8), ("router", "comparison", 12)]


def test_prompt_parts_give_way_in_order(spark):
    items = [(1, "history", 1, 10), (1, "history", 2, 10), (1, "chunks", 1, 10), (1, "chunks", 2, 10), (1, "chains", 1, 10), (1, "topics", 1, 10), (1, "facts", 1, 10)]
    df = spark.createDataFrame(items, "g long, part string, place long, size long")
    got = [tuple(context.fit(df, "g", limit).first())[1:] for limit in (100, 65, 50, 45, 35, 5)]
    # topics, chains, the second chunk, the older turn; a fact, a chunk and the newest turn stay
    assert got == [(7, 0, 70), (6, 1, 60), (5, 2, 50), (4, 3, 40), (3, 4, 30), (3, 4, 30)]


def test_memory_keeps_each_opening_once_within_its_budget(spark):
    rows = spark.createDataFrame([(1, 3, "B second. x"), (1, 1, "A first. y"), (1, 2, "A first. z"), (1, 4, "C" * 50), (1, 5, "D"), (2, 1, None)], "g long, turn long, text string")
    got = {r.g: r.summary for r in context.merge_memory(rows, "g", "turn", "text", 20).collect()}
    assert got == {1: "A first | B second | D", 2: ""}


def test_best_sentences():
    quotes = ["The first sentence is about bees here. Short. Another sentence of bees and honey follows.", "The first sentence is about bees here. Last but long enough to count."]
    assert context.best_sentences(quotes, {"bees", "honey"}) == "The first sentence is about bees here. Another sentence of bees and honey follows. Last but long enough to count."


def test_judge_needs_all_a_case_asks_for(spark):
    good = {"id": 0, "question_type": "fact", "abstained": False, "abstain_reason": None, "confidence": 0.8, "grounded": True, "citations": 2, "filenames": ["Bee Book.pdf"], "kinds": ["chunk"], "n_terms": 2, "answer_coverage": 0.5, "citation_coverage": 0.5,
            "expected_type": None, "expected_abstained": None, "expected_documents": ["bee book"], "forbidden_documents": ["wasp"], "expected_kinds": ["chunk"], "least_confidence": 0.7, "least_answer": None, "least_citation": None}
    changes = [{}, {"expected_type": "definition"}, {"expected_abstained": True}, {"expected_documents": ["ant"]}, {"forbidden_documents": ["BEE"]}, {"expected_kinds": ["asset"]}, {"grounded": False}, {"citations": 0}, {"confidence": 0.6}, {"answer_coverage": 0.3}, {"citation_coverage": 0.2}]
    silent = {"abstained": True, "abstain_reason": "thin", "expected_abstained": True, "confidence": 0.0, "grounded": False, "citations": 0, "citation_coverage": 0.0, "expected_documents": None, "expected_kinds": None}
    rows = [{**good, **c, "id": k} for k, c in enumerate([*changes, silent, {**silent, "abstain_reason": ""}])]
    schema = "id int, question_type string, abstained boolean, abstain_reason string, confidence double, grounded boolean, citations int, filenames array<string>, kinds array<string>, n_terms int, answer_coverage double, citation_coverage double, expected_type string, expected_abstained boolean, expected_documents array<string>, forbidden_documents array<string>, expected_kinds array<string>, least_confidence double, least_answer double, least_citation double"
    judged = evaluation.judge(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema))
    got = {r.id: [c for c in evaluation.CHECKS if not r[c]] for r in judged.collect()}
    assert [got[k] for k in range(1, 11)] == [[c] for c in evaluation.CHECKS]
    assert not got[0] and not got[11] and got[12] == ["grounding_ok"]
    assert tuple(evaluation.summary(judged).first())[:5] == (13, 2, 0.1538, 3, 2)


def test_hot_seeds_meet_queries_as_one_row(spark):
    """A seed with many assertions is one row from its query to its neighbours; own assertions give way to the next best."""
    from stratalode.operators import graph as G

    around = [(k, "hub", f"p{k}", "contains", 1 - k / 1000, 0, f"d{k}", f"hub contains p{k}") for k in range(100)]
    lines = spark.createDataFrame(around, "assertion_id long, subject string, object string, predicate string, confidence double, evidence long, document string, surface string")
    base = spark.createDataFrame([(q, a, p) for q in range(20) for p, a in enumerate([q, (q + 1) % 20])], "query_id long, assertion_id long, place int")
    near = G.nearby(base, lines)
    joins = [x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert not any("LeftAnti" in x for x in joins)
    got = {(r.query_id, r.rn): r.assertion_id for r in near.where("seed = 'hub'").collect()}
    for q in range(20):
        free = [a for a in range(100) if a not in (q, (q + 1) % 20)]
        assert [got[q, 1], got[q, 2]] == free[:2]
