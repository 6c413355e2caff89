"""Search for entities of the knowledge graph by their names, their assertions' literals and their evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode.operators.retrieval import terms
from stratalode.session import shared_path

# fixed values: what a term adds where it is found: at a name's start, in the name, the type, the id, any literal, any excerpt
PREFIX, NAME, TYPE, ID, LITERAL, EXCERPT = 40, 24, 10, 6, 5, 3
MOST_TERMS, LIMIT = 8, 6
#: Distinct terms that are looked for in one pass over a table.
TERM_BLOCK = 4096


def found_terms(rows: DataFrame, key: list[str], fields: list[str], wanted: DataFrame, blocks: int) -> DataFrame:
    """(key, term, at, prefix): which of the wanted terms each row holds, as bits by field; prefix has those that start with it.

    wanted: distinct (term, block). A block's terms, TERM_BLOCK at most or so, make one automaton that reads each text once.
    """
    spark, out = rows.sparkSession, None
    slim = rows.select(*key, *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields))
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    for b in range(blocks):
        known = spark.sparkContext.broadcast([r[0] for r in wanted.where(F.col("block") == b).select("term").collect()])

        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for x in known.value:
                machine.add_word(x, x)
            machine.make_automaton()
            for batch in batches:
                texts = [batch[f].to_pylist() for f in fields]
                row, term, at, prefix = [], [], [], []
                for k in range(batch.num_rows):
                    met: dict[str, list[int]] = {}
                    for f, column in enumerate(texts):
                        for end, x in machine.iter(column[k]) if known.value else ():
                            bits = met.setdefault(x, [0, 0])
                            bits[0] |= 1 << f
                            bits[1] |= (end + 1 == len(x)) << f
                    for x, (a, p) in met.items():
                        row.append(k)
                        term.append(x)
                        at.append(a)
                        prefix.append(p)
                take = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in key), pa.array(term, pa.string()), pa.array(at, pa.int32()), pa.array(prefix, pa.int32())], [*key, "term", "at", "prefix"])

        one = slim.mapInArrow(scan, f"{kind}, term string, at int, prefix int")
        out = one if out is None else out.unionByName(one)
    return out


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several steps read, written once."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def search_entities(entities: DataFrame, assertions: DataFrame, evidence: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, entity_id, relevance, assertions, documents, place): the entities that queries (query_id, q) speak of.

    entities: (entity_id, canonical_name, entity_type); assertions, those in the reader's scope: (assertion_id, document_id,
    subject_entity_id, object_entity_id, object_literal); evidence: (assertion_id, excerpt). An entity counts on the subject's and
    on the object's side. A query's first eight terms add up, repeated ones again, each with the best that any of the entity's
    assertions gives. An entity found by itself counts all its assertions, another those that were found. Entities without
    assertions in scope are not found.

    Queries of the same terms are answered once, as one ask. Entities whose names, types and ids hold the same terms are a class,
    those of a class whose assertions hold the same terms a unit: all of a unit are equally relevant to any ask. So asks meet
    classes, then the units of classes that can reach an ask's `limit` best, then the first `limit` entities of the units left.
    Only where entities known by their assertions alone may be among the best do asks meet the assertions.
    """
    asks = queries.select("query_id", F.slice(terms(F.col("q")), 1, MOST_TERMS).alias("ask"))
    asks = asks.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("ask"))).alias("ask")).where(F.size("ask") > 0)
    # from here on an ask is a number, as it goes along with each row that it meets
    numbered = _stored(asks.select(F.col("ask").alias("terms")).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    asks = asks.withColumnRenamed("ask", "terms").join(numbered, "terms").select("query_id", "ask")
    asked = numbered.select("ask", F.explode(F.array_compact("terms")).alias("term")).groupBy("ask", "term").agg(F.count("*").alias("times"))
    words = asked.select("term").distinct()
    blocks = max(1, -(-words.count() // TERM_BLOCK))
    wanted = words.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))

    sides = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    fan = lambda x: assertions.select(x, F.explode(sides).alias("entity_id")).distinct().groupBy("entity_id")
    totals = fan("assertion_id").agg(F.count("assertion_id").alias("assertions")).join(fan("document_id").agg(F.count("document_id").alias("documents")), "entity_id")
    known = entities.select("entity_id", "canonical_name").join(totals, "entity_id")

    named = entities.select("entity_id", "canonical_name", "entity_type", F.col("entity_id").alias("id_text"))
    own = found_terms(named, ["entity_id"], ["canonical_name", "entity_type", "id_text"], wanted, blocks)
    bit = lambda column, k, worth: F.when(F.col(column).bitwiseAND(F.lit(1 << k)) > 0, worth).otherwise(0)
    own = own.select("entity_id", "term", (bit("prefix", 0, PREFIX) + bit("at", 0, NAME) + bit("at", 1, TYPE) + bit("at", 2, ID)).alias("worth"))

    # what a literal tells stays in its assertion's row; excerpts meet assertions as they are, not one for each side
    literals, excerpts = assertions.where("object_literal <> ''").select("assertion_id", "document_id", sides.alias("sides"), "object_literal"), evidence.where("excerpt <> ''")
    literal = found_terms(literals, ["assertion_id", "document_id", "sides"], ["object_literal"], wanted, blocks).select("assertion_id", "document_id", "sides", "term", F.lit(LITERAL).alias("literal"), F.lit(0).alias("excerpt"))
    shown = found_terms(excerpts, ["assertion_id"], ["excerpt"], wanted, blocks).select("assertion_id", "term")
    excerpt = assertions.select("assertion_id", "document_id", "subject_entity_id", "object_entity_id").join(shown, "assertion_id").select("assertion_id", "document_id", sides.alias("sides"), "term", F.lit(0).alias("literal"), F.lit(EXCERPT).alias("excerpt"))
    met = literal.unionByName(excerpt).select("assertion_id", "document_id", "term", "literal", "excerpt", F.explode(F.filter("sides", lambda x: x.isNotNull())).alias("entity_id"))
    met = _stored(met, "entity-met")
    by_term = _stored(met.groupBy("entity_id", "term").agg((F.max("literal") + F.max("excerpt")).alias("worth")), "entity-terms")

    has = lambda df, name: df.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("term", "worth"))).alias(name))
    none = F.array().cast("array<struct<term:string,worth:int>>")
    members = known.join(has(own, "class"), "entity_id").join(has(by_term, "unit"), "entity_id", "left").withColumn("unit", F.coalesce("unit", none))
    members = _stored(members, "entity-classes")
    order = [F.desc("assertions"), F.desc("documents"), "canonical_name", "entity_id"]
    # a unit's entities have one relevance and count all they have, so their order is the same in every ask
    inside = Window.partitionBy("class", "unit")
    firsts = members.withColumn("nth", F.row_number().over(inside.orderBy(*order))).where(F.col("nth") <= limit)
    units = members.groupBy("class", "unit").agg(F.count("*").alias("n"))
    classes = units.groupBy("class").agg(F.sum("n").alias("n"))

    def worth(side: str) -> DataFrame:
        """(ask, side, n, value): what classes or units that hold a term of an ask give it."""
        rows = {"class": classes, "unit": units.groupBy("unit").agg(F.sum("n").alias("n"))}[side]
        each = rows.select(side, F.explode(side).alias("x")).select(side, "x.term", "x.worth")
        return each.join(asked, "term").groupBy("ask", side).agg(F.sum(F.col("worth") * F.col("times")).alias("value"))

    def reached(rows: DataFrame, value: str) -> DataFrame:
        """rows (ask, n, value) with least: what the ask's entity at `limit` has at least, 0 where there are fewer."""
        upto = F.sum("n").over(Window.partitionBy("ask").orderBy(F.desc(value)))
        return rows.withColumn("upto", upto).withColumn("least", F.coalesce(F.max(F.when(F.col("upto") >= limit, F.col(value))).over(Window.partitionBy("ask")), F.lit(0))).drop("upto")

    most = by_term.groupBy("term").agg(F.max("worth").alias("most")).join(asked, "term").groupBy("ask").agg(F.sum(F.col("most") * F.col("times")).alias("most"))
    by_class = reached(worth("class").join(classes, "class"), "value").join(most, "ask", "left").fillna(0, ["most"])
    hopeful = by_class.where(F.col("value") + F.col("most") >= F.col("least")).select("ask", "class", "value")
    by_unit = hopeful.join(units, "class").join(worth("unit").withColumnRenamed("value", "more"), ["ask", "unit"], "left")
    by_unit = reached(by_unit.withColumn("relevance", F.col("value") + F.coalesce("more", F.lit(0))), "relevance").where(F.col("relevance") >= F.col("least"))
    found = by_unit.select("ask", "class", "unit", "relevance").join(firsts, ["class", "unit"]).select("ask", "entity_id", "canonical_name", "relevance", "assertions", "documents")

    # asks whose best by themselves are too few, or weigh no more than assertions alone can
    sure = by_class.where(F.col("least") > F.col("most")).select("ask").distinct()
    open_ = asked.join(sure, "ask", "left_anti")
    by_told = by_term.join(open_, "term").groupBy("ask", "entity_id").agg(F.sum(F.col("worth") * F.col("times")).alias("relevance"))
    by_told = by_told.join(own.join(open_, "term").select("ask", "entity_id"), ["ask", "entity_id"], "left_anti")
    # relevance comes first, so what has less than an ask's entity at `limit` needs no counting
    by_told = by_told.withColumn("nth", F.rank().over(Window.partitionBy("ask").orderBy(F.desc("relevance")))).where(F.col("nth") <= limit).drop("nth")
    # what an entity met goes to the entity once, where its asks are; each ask's count needs no further move
    holds = (F.col("told") == F.col("entity_id")) & F.array_contains("terms", F.col("term"))
    counted = by_told.join(numbered, "ask").repartition("entity_id").join(met.select("assertion_id", "document_id", "term", F.col("entity_id").alias("told")), holds).groupBy("ask", "entity_id", "relevance")
    counted = counted.agg(F.countDistinct("assertion_id").alias("assertions"), F.countDistinct("document_id").alias("documents"))
    alone = counted.join(entities.select("entity_id", "canonical_name"), "entity_id")

    best = found.unionByName(alone.select(*found.columns)).withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("relevance"), *order)))
    return asks.join(best.where(F.col("place") <= limit), "ask").select("query_id", "entity_id", "relevance", "assertions", "documents", "place")
