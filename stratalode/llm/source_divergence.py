"""Source divergence audit: how far the sources of a language are from each other and from it, and by which terms.

Terms are counted by single-pass in-memory indexing. A task inverts its documents into postings of terms per language and source
until they fill its memory, then spills them as a run sorted by term; runs are dealt by the hash of language and term, and each
shard merges its runs in term order (the priority-queue merge of Spark's external sort) into frequencies, in one pass that
holds one term. Every document is read once.

Probabilities are smoothed, so each of a source's terms counts in each pair. The sum over all terms is exact without visiting
them for all pairs: a source's terms are first summed per distinct count against the other's share of an unseen term, and then
the postings are streamed by term, and what differs where both have the term is added as a correction per pair.

p = 1 + floor(scale * (count + 1) / (N + V)), f(p, q) = floor((p - q)^2 / q), all in integers. Null text, lang and source are
''. Terms are runs of letters A-Z, a-z (lowered) and characters beyond ASCII. Equal rows are documents like others; a group
without terms, or a language without kept terms, has its pairs with their values (0 without terms). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalode.llm._support import PIECE, buffer_of, materialise

LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Postings that a task holds before it spills runs, terms counted in; rows of a run sent at once; pairs whose corrections it holds.
POSTINGS, RUN_ROWS, PAIRS = 6_000_000, 1 << 17, 1 << 20
#: In UTF-8 bytes, of lowered text.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_RUN = "lang string, term string, source string, occurrences long, documents long"
_FREQUENCIES = "lang string, term string, source string, count long, lang_count long, lead boolean"


def _pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """Stretches of a text that cut no term."""
    at = 0
    while len(text) - at > limit:
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a document's terms, and how often each occurs."""
    ids, counts = np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts), return_counts=True)
    return ids, counts


class Block:
    """Postings of terms per source for the languages of some documents, in memory."""

    def __init__(self):
        self.terms: dict[str, defaultdict[bytes, int]] = {}
        self.sources: dict[str, list[str]] = {}
        self.ids: dict[str, list[np.ndarray]] = {}
        self.counts: dict[str, list[np.ndarray]] = {}
        self.postings = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        if lang not in self.terms:
            self.terms[lang], self.sources[lang], self.ids[lang], self.counts[lang] = defaultdict(count().__next__), [], [], []
        numbers = self.terms[lang].__getitem__  # a term not met before takes the next number
        found = [np.fromiter(map(numbers, w), np.int64, len(w)) for piece in _pieces(text) if (w := _TERM.findall(piece))]
        if found:
            ids, counts = _counted(found)
            self.sources[lang].append(source)
            self.ids[lang].append(ids)
            self.counts[lang].append(counts)
            self.postings += len(ids)

    @property
    def size(self) -> int:
        """Postings held; a term of the dictionary takes as much memory as about eight."""
        return self.postings + 8 * sum(map(len, self.terms.values()))

    def runs(self) -> Iterator[pa.RecordBatch]:
        """A run per language, sorted by term and source."""
        for lang, terms in self.terms.items():
            if not self.ids[lang]:
                continue
            order = sorted(terms)
            rank = np.empty(len(order), np.int64)
            rank[np.fromiter(map(terms.__getitem__, order), np.int64, len(order))] = np.arange(len(order))
            names = sorted(set(self.sources[lang]))
            place = {s: k for k, s in enumerate(names)}
            source = np.repeat(np.array([place[s] for s in self.sources[lang]]), [len(x) for x in self.ids[lang]])
            key = rank[np.concatenate(self.ids[lang])] * len(names) + source
            by = np.argsort(key, kind="stable")
            key, counts = key[by], np.concatenate(self.counts[lang])[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            occurrences, documents = np.add.reduceat(counts, first), np.diff(np.append(first, len(key)))
            key, words, names = key[first], pa.array(order, pa.binary()).cast(pa.string()), pa.array(names, pa.string())
            for at in range(0, len(key), RUN_ROWS):
                cut = slice(at, at + RUN_ROWS)
                term, source = np.divmod(key[cut], len(names))
                yield _rows(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(term), np.int8))), words.take(pa.array(term)), names.take(pa.array(source)), occurrences[cut], documents[cut])


def _rows(lang: pa.Array, term: pa.Array, source: pa.Array, occurrences: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, term, source, pa.array(occurrences), pa.array(documents)], ["lang", "term", "source", "occurrences", "documents"])


def _inverter(limit: int):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, str], None] = {}
        block = Block()
        for batch in batches:
            buf, off = buffer_of(batch["text"])
            buf, off = memoryview(np.ascontiguousarray(buf)), off.tolist()
            for k, group in enumerate(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)):
                met.setdefault(group)
                block.add(*group, bytes(buf[off[k] : off[k + 1]]).lower())
                if block.size >= limit:
                    yield from block.runs()
                    block = Block()
        yield from block.runs()
        none = np.zeros(len(met), np.int64)  # a row without a term says that a group occurs
        yield _rows(*(pa.array(c, pa.string()) for c in ([g[0] for g in met], [""] * len(met), [g[1] for g in met])), none, none)

    return invert


def _changes(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a row's values differ from the row before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        if n > 1:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _merger(least: int):
    """Merges sorted runs; holds the sources of one term beyond a batch."""

    def summed(rows: pa.Table) -> pa.Table:
        first = np.flatnonzero(_changes(rows["lang"], rows["term"], rows["source"]))
        sums = [pa.array(np.add.reduceat(rows[c].to_numpy(), first)) for c in ("occurrences", "documents")]
        return pa.table([*(rows[c].take(pa.array(first)) for c in ("lang", "term", "source")), *sums], ["lang", "term", "source", "occurrences", "documents"])

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        new = _changes(rows["lang"], rows["term"])
        first, term = np.flatnonzero(new), np.cumsum(new) - 1
        occurrences = rows["occurrences"].to_numpy()
        total, documents = np.add.reduceat(occurrences, first)[term], np.add.reduceat(rows["documents"].to_numpy(), first)[term]
        group = pc.equal(rows["term"], "").to_numpy()
        out = pa.table([rows["lang"], rows["term"], rows["source"], pa.array(occurrences), pa.array(total), pa.array(new & ~group)], ["lang", "term", "source", "count", "lang_count", "lead"])
        yield from out.filter(pa.array((documents >= least) | group)).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = summed(pa.concat_tables([open_, now.cast(open_.schema)]) if open_ is not None else now)
            last = int(np.flatnonzero(_changes(now["lang"], now["term"]))[-1])  # this term may go on
            yield from kept(now.slice(0, last))
            open_ = now.slice(last).combine_chunks()
        if open_ is not None:
            yield from kept(open_)

    return merge


def frequencies(docs: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = POSTINGS) -> DataFrame:
    """(lang, term, source, count, lang_count, lead): counts of terms in at least `least` documents of their language.

    lead marks one row of each kept term. Every (lang, source) that occurs has one row with the term '' and count 0 beside.
    """
    part = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = part.mapInArrow(_inverter(limit), _RUN)
    return runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(_merger(least), _FREQUENCIES)


def share(count: str, n: str, v: str, scale: int = SCALE) -> Column:
    """p of a count among n with v terms, as exact decimals; null where there are neither."""
    return F.expr(f"1 + CAST({scale} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0)) div nullif({n} + {v}, 0)")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of sources, what terms that both have add to the sums by one's counts; a task holds about twice PAIRS of pairs and one term."""
    pairs, sums, waiting = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), 0
    todo: list[tuple[np.ndarray, np.ndarray]] = []

    def add(cols: dict[str, np.ndarray], new: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if not len(new):
            return
        end = np.repeat(np.append(new[1:], len(cols["gid"])), np.diff(np.append(new, len(cols["gid"]))))
        left, step = np.arange(len(end)), 1
        while len(left := left[left + step < end[left]]):
            a, b = left, left + step
            for x, y in ((a, b), (b, a)):
                p, p0, q, q0 = cols["p"][x], cols["p0"][x], cols["p"][y], cols["p0"][y]
                todo.append((np.column_stack([cols["gid"][x], cols["gid"][y]]), _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)))
                waiting += len(x)
            step += 1
            if waiting > PAIRS:
                fold()
                if len(pairs) > PAIRS:
                    yield out()

    def fold() -> None:
        nonlocal pairs, sums, waiting
        keys, values = np.concatenate([pairs, *(k for k, _ in todo)]), np.concatenate([sums, *(v for _, v in todo)])
        todo.clear()
        waiting = 0
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
        pairs, sums = keys[first], np.add.reduceat(values, first) if len(first) else values

    def out() -> pa.RecordBatch:
        nonlocal pairs, sums
        now = pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(sums)], ["a", "b", "value"])
        pairs, sums = pairs[:0], sums[:0]
        return now

    open_: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([open_, now]).combine_chunks() if open_ is not None else now
        new = np.flatnonzero(_changes(now["lang"], now["term"]))
        held = {c: now[c].to_numpy() for c in ("gid", "p", "p0")}
        yield from add({c: v[: new[-1]] for c, v in held.items()}, new[:-1])
        open_ = now.slice(int(new[-1]))
    if open_ is not None:
        yield from add({c: open_[c].to_numpy() for c in ("gid", "p", "p0")}, np.zeros(1, np.int64))
    fold()
    yield out()


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, scale: int = SCALE, limit: int = POSTINGS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` (each other source of the language) and `term` (the first `top`)."""
    found = materialise(frequencies(docs, least, limit), "frequencies")
    groups = found.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count_if("lead").alias("leads"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("leads").alias("v"))
    groups = groups.join(langs, "lang").withColumn("p0", share("0", "n", "v", scale))
    groups = materialise(groups.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "n", "lang_n", "v", "p0"), "groups")
    postings = found.where("term <> ''").join(groups, ["lang", "source"]).withColumn("p", share("count", "n", "v", scale))

    terms = postings.withColumn("q", share("lang_count", "lang_n", "v", scale)).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = terms.select("*", rank).where(F.col("rank") <= top)

    counted = postings.groupBy("gid", "p").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "v", F.col("gid").alias("a"), "p0").join(other, "lang").where("a <> b")
    by_count = counted.withColumnRenamed("gid", "a").join(pairs, "a")
    by_count = by_count.groupBy("a", "b").agg(F.sum("terms").alias("own"), F.sum(F.col("terms") * divergence("p", "q0")).alias("left"), F.sum(F.col("terms") * divergence("q0", "p")).alias("right"))
    by_count = materialise(by_count, "sums-by-count")
    back = by_count.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("others"), "right")
    streamed = postings.select("lang", "term", "gid", "p", "p0").repartition("lang", "term").sortWithinPartitions("term", "lang")
    both = streamed.mapInArrow(_correct, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("both"))
    all_ = pairs.join(by_count.drop("right"), ["a", "b"], "left").join(back, ["a", "b"], "left").join(both, ["a", "b"], "left").fillna(0, ["own", "others", "left", "right", "both"])
    value = F.expr("coalesce((v - own - others) * ((p0 - q0) * (p0 - q0) div q0), 0) + left + right + both").alias("value")
    pair = all_.select("lang", "source", F.lit("pair").alias("part"), "item", value)
    return pair.select("*", rank).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all documents, and the 200 terms that set each apart."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY 1, 2, 3),
l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM k),
n AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM n),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE c > 0 AND p > q),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 200
"""
