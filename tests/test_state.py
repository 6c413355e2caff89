"""State over time against a plain scan, and owned merges."""

import random

import pytest
from pyspark.sql import functions as F

from stratalode.operators import state as Z


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_last_write_before_each_reading(spark, stretch):
    rng = random.Random(stretch)
    writes = [(rng.choice("ab"), rng.randint(0, 60), k, rng.choice([None, k])) for k in range(40)] + [("hot", k, k, k) for k in range(0, 60, 9)]
    readings = [(rng.choice(["a", "b", "c"]), rng.randint(-3, 63), k) for k in range(80)] + [("hot", k, 100 + k) for k in range(60)]
    w, r = spark.createDataFrame(writes, "key string, at long, n long, v long").repartition(3), spark.createDataFrame(readings, "key string, at long, id long").repartition(3)
    got = {x.id: tuple(x["last"]) if x["last"] else None for x in Z.as_of(r, w, ["key"], "at", "n", ["v"], F.floor(F.col("at") / stretch)).collect()}
    for key, at, i in readings:
        before = [(a, n, v) for k, a, n, v in writes if k == key and a <= at]
        assert got[i] == ((max(before, key=lambda x: x[:2])[0], max(before, key=lambda x: x[:2])[2]) if before else None), (key, at)
    assert len(got) == len(readings)


def test_routes_that_may_not_be_reused(spark):
    kind = "tenant string, pattern string, at timestamp, order long, identity string, question_type string, top_k string, confidence string, approved int, rejected int"
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = [("t", "good", 1, "me", "fact", "40", None, 0, 0), ("t", "old", 1, "me", "fact", "4", "0.9", 0, 0), ("t", "theirs", 1, "other", "fact", "4", "0.9", 0, 0), ("t", "bad", 1, "me", "fact", "4", "0.9", 1, 2), ("t", "odd", 1, "me", "fun", "4", "0.9", 0, 0), ("t", "number", 1, "me", "fact", "x", "0.9", 0, 0), ("t", "sure", 1, "me", "fact", "0", "7", 0, 0)]
    entries = spark.createDataFrame([(t, p, day(1, 20), *r) for t, p, *r in rows], kind.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))
    asked = [(p, "t", 2, 1, 21) for p in ("good", "theirs", "bad", "odd", "number", "sure", "none")] + [("old", "t", 2, 2, 21), ("good", "u", 2, 1, 21), ("good", "t", 1, 1, 21), ("good", "t", 2, 1, 19), ("good", "t", 3, 2, 19)]
    questions = spark.createDataFrame([(k, t, p, n, day(d, h)) for k, (p, t, n, d, h) in enumerate(asked)], "id int, tenant string, pattern string, keywords int, at string").withColumn("at", F.to_timestamp("at"))
    got = Z.cached_routes(questions, entries, F.lit("me"), ("fact",), 86_400, 12).orderBy("id").collect()
    assert [r.source.removeprefix("router:") for r in got] == ["router_cache", "other_identity", "rejected", "invalid", "invalid", "router_cache", "miss", "expired", "miss", "few_keywords", "miss", "router_cache"]
    assert [(r.question_type, r.top_k, r.confidence) for r in got if r.source == "router_cache"] == [("fact", 12, 0.0), ("fact", 1, 1.0), ("fact", 12, 0.0)]


def test_sensors_need_what_their_owner_has(spark):
    sensor = "tenant string, owner string, external_id string, name string, place int, hive int, hive_name string, label string, at int"
    places = spark.createDataFrame([("t", "me", 1, "Garden"), ("t", "me", 2, "Roof"), ("t", "you", 3, "Yours")], "tenant string, owner string, place int, place_name string")
    hives = spark.createDataFrame([("t", "me", 10, "H10", 1), ("t", "me", 11, "H11", None), ("t", "you", 12, "H12", 3)], "tenant string, owner string, hive int, own_name string, hive_place int")
    old = spark.createDataFrame([("t", "me", "s1", "first", None, None, None, "shed", 0), ("t", "you", "s1", "other", None, None, None, None, 0)], sensor)
    row = lambda i, at, place=None, hive=None, owner="me", name="n", label=None: ("t", owner, i, name, place, hive, "told", label, at)
    writes = [row("s1", 1, 1, 10), row("s1", 2, None, 10, name="late"), row("s2", 1, None, None, label="free"), row("s3", 1, 3), row("s4", 1, None, 12), row("s5", 1, 2, 10), row("s6", 1, 1, 11), row("s7", 1, None, 11), row("s8", 1, owner=None), row(" ", 1), row("s9", 1, name="")]
    kept, refused = Z.sensor_upsert(old, spark.createDataFrame(writes, sensor), places, hives)
    assert {r.external_id: r.reason for r in refused.collect()} == {"s3": "place_not_found", "s4": "hive_not_found", "s5": "hive_of_another_place", "s6": "hive_without_place", "s8": "missing_owner", " ": "missing_external_id", "s9": "missing_name"}
    assert {(r.owner, r.external_id, r.name, r.place, r.hive, r.hive_name, r.label) for r in kept.collect()} == {("me", "s1", "late", 1, 10, "H10", "Garden"), ("you", "s1", "other", None, None, None, None), ("me", "s2", "n", None, None, "told", "free"), ("me", "s7", "n", None, 11, "H11", None)}
    again, _ = Z.sensor_upsert(kept, spark.createDataFrame(writes, sensor), places, hives)
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_resume_validates_texts_once(spark, monkeypatch):
    from stratalode.plans import quality as QP
    from stratalode.plans import registry

    whole, seen = QP.validated, spark.sparkContext.accumulator(0)

    def counted(t):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = whole(t)
        return df.mapInArrow(count, df.schema)

    monkeypatch.setattr(QP, "validated", counted)
    registry.queries()["resume"](spark, "/root/testdata/sf0.001").collect()
    assert 0 < seen.value <= spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_revalidate_validates_texts_once(spark, monkeypatch):
    from stratalode.plans import quality as QP
    from stratalode.plans import registry

    whole, calls = QP.validated, []
    monkeypatch.setattr(QP, "validated", lambda t: calls.append(1) or whole(t))
    assert registry.queries()["revalidate"](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_only_failed_chunks_are_extracted_again(spark, monkeypatch):
    from stratalode.plans import knowledge as KP
    from stratalode.plans import registry

    whole, sizes = KP.extractions, []

    def sized(t):
        df = whole(t)
        sizes.append(df.count())
        return df

    monkeypatch.setattr(KP, "extractions", sized)
    registry.queries()["kg_reprocess"](spark, "/root/testdata/sf0.001").collect()
    assert len(sizes) == 2 and 0 < sizes[1] < sizes[0] / 5
