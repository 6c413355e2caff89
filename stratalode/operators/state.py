"""Keyed state over time: what was last written before each reading, and whether it may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(readings: DataFrame, writes: DataFrame, keys: list[str], at: str, order: str, value: list[str], chunk: Column) -> DataFrame:
    """readings (keys, at, ...) with `last`: the columns `value` of the last write (keys, at, order, value) at or before `at`.

    Of writes at one time the greatest `order` is last. chunk cuts time (an expression of `at`, rising with it) into stretches: a
    stretch of a key is sorted alone and begins with what the stretches before it left, so a key with many rows is no one task.
    """
    kind = F.struct(at, *value)
    rows = readings.select(*keys, at, F.lit(None).cast(writes.schema[order].dataType).alias("__order"), F.lit(None).cast(writes.select(kind.alias("k")).schema["k"].dataType).alias("__w"), F.struct(*readings.columns).alias("__r"))
    both = rows.unionByName(writes.select(*keys, at, F.col(order).alias("__order"), kind.alias("__w"), F.lit(None).cast(rows.schema["__r"].dataType).alias("__r"))).withColumn("__chunk", chunk)
    within = Window.partitionBy(*keys, "__chunk").orderBy(at, F.col("__r").isNotNull(), "__order").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__in", F.last("__w", ignorenulls=True).over(within)).where("__r IS NOT NULL")
    ends = both.where("__w IS NOT NULL").groupBy(*keys, "__chunk").agg(F.max(F.struct(F.col(at).alias("a"), F.col("__order").alias("o"), F.col("__w").alias("w")))["w"].alias("__end"))
    starts = both.select(*keys, "__chunk").distinct().join(ends, [*keys, "__chunk"], "left")
    before = starts.withColumn("__before", F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("__end")  # rows are stretches
    return told.join(before, [*keys, "__chunk"]).select("__r.*", F.coalesce("__in", "__before").alias("last"))


def cached_routes(questions: DataFrame, entries: DataFrame, identity: Column, kinds: tuple[str, ...], max_age: int, most: int, chunk: str = "day") -> DataFrame:
    """questions (tenant, pattern, keywords, at, ...) with source, question_type, top_k and confidence of a cached route.

    entries: (tenant, pattern, at, order, identity, question_type, top_k, confidence, approved, rejected), as they were saved. The
    last entry before a question is used if the question has two keywords, and the entry isn't older than max_age seconds, comes
    from the same router, was not rejected more often than approved, and holds a known type, a number of results and a
    confidence. Else source tells why the router is asked.
    """
    held = ["identity", "question_type", "top_k", "confidence", "approved", "rejected"]
    met = as_of(questions, entries, ["tenant", "pattern"], "at", "order", held, F.date_trunc(chunk, "at"))
    e = F.col("last")
    sure, k = e["confidence"].try_cast("double"), e["top_k"].try_cast("int")
    why = (
        ("router:few_keywords", F.col("keywords") < 2), ("router:miss", e.isNull()), ("router:expired", F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(e["at"].cast("timestamp")) > max_age * 1_000_000), ("router:other_identity", ~F.coalesce(e["identity"] == identity, F.lit(False))),
        ("router:rejected", e["rejected"] > e["approved"]), ("router:invalid", ~F.coalesce(e["question_type"].isin(*kinds), F.lit(False)) | k.isNull() | (e["confidence"].isNotNull() & sure.isNull())),
    )
    source = F.coalesce(*(F.when(holds, F.lit(name)) for name, holds in why), F.lit("router_cache"))
    out = met.withColumn("source", source)
    used = lambda c: F.when(F.col("source") == "router_cache", c)
    return out.select(*questions.columns, "source", used(e["question_type"]).alias("question_type"), used(F.greatest(F.lit(1), F.least(F.lit(most), k))).alias("top_k"), used(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.0))))).alias("confidence"))


def sensor_upsert(old: DataFrame, writes: DataFrame, places: DataFrame, hives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sensors, refused): a batch of writes merged into sensors along the chain of what its owner has.

    sensors: (tenant, owner, external_id, name, place, hive, hive_name, label, at); writes have those columns. places: (tenant,
    owner, place, place_name); hives: (tenant, owner, hive, own_name, hive_place). A place and a hive must be the writer's own,
    and a hive must stand in the place that is named; without one the hive's place counts. The names of both come from their
    tables. Of accepted writes the last of a sensor stays. refused has the writes that don't hold, with a reason.
    """
    mine = ["tenant", "owner"]
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    named = places.select(*mine, F.col("place").alias("__p"), F.col("place_name").alias("__pn"))
    stands = hives.select(*mine, F.col("hive").alias("__h"), F.col("own_name").alias("__hn"), F.col("hive_place").alias("__hp"))
    on = lambda a, b: [F.col(f"w.{c}") == F.col(f"r.{c}") for c in mine] + [F.col(f"w.{a}") == F.col(f"r.{b}")]
    a = writes.alias("w").join(stands.alias("r"), on("hive", "__h"), "left").select("w.*", "__h", "__hn", "__hp")
    a = a.withColumn("__place", F.coalesce("place", "__hp"))
    a = a.alias("w").join(named.alias("r"), on("__place", "__p"), "left").select("w.*", "__p", "__pn")
    why = F.coalesce(
        *(F.when(blank(c), F.lit(f"missing_{c}")) for c in ("owner", "external_id", "name")), F.when(F.col("place").isNotNull() & F.col("__p").isNull(), "place_not_found"), F.when(F.col("hive").isNotNull() & F.col("__h").isNull(), "hive_not_found"),
        F.when(F.col("place").isNotNull() & (F.col("__hp") != F.col("place")), "hive_of_another_place"), F.when(F.col("hive").isNotNull() & F.col("place").isNotNull() & F.col("__hp").isNull(), "hive_without_place"),
    )
    judged = a.withColumn("reason", why)
    refused = judged.where("reason IS NOT NULL").select(*writes.columns, "reason")
    good = judged.where("reason IS NULL").withColumns({"place": F.col("__p"), "hive_name": F.coalesce("__hn", "hive_name"), "label": F.coalesce("__pn", "label")}).select(*old.columns)
    rest = [c for c in old.columns if c not in (*mine, "external_id")]
    last = old.unionByName(good).groupBy(*mine, "external_id").agg(F.max_by(F.struct(*rest), F.struct("at", "name")).alias("r"))
    return last.select(*mine, "external_id", "r.*").select(*old.columns), refused
