"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts are lower-cased in A-Z and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Every window of n item words (an item
of fewer words is one window) goes into a sorted hash set. Document windows are hashed in bulk, looked up and verified
word by word; hit spans are then reported, cut out, or used to drop documents.

Defined cases: null and empty texts have no words and are never hit; rows are reported one by one, whatever their doc_ids; an
item without words gives no window; repeated items count one by one; items with a null item_id hit like others and count as one item,
which has no place among the ids; an empty table on either side gives no hits; columns other than the named ones pass through
`remove` untouched. Memory: the set is broadcast in blocks of about `block_bytes` of item text. All blocks mark their hits beside
the row, in one scan, and spans are merged, reported, judged and cut once, on the text as it came; the number of blocks changes nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm._support import buffer_of, ints, pieces, runs, window_hashes, with_ids, without_ids, words_of

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that are no word bytes once A-Z are lower-cased.
SEPARATOR = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATOR[_lo : _hi + 1] = True
BLOCK_BYTES = 8 << 20
_BITS = 22
_SPANS = "array<struct<a:long,b:long>>"
#: Stands for a null item_id.
NO_ITEM = -(1 << 63)


def _words(text: str | None) -> list[bytes]:
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    s, e, _, _ = words_of(buf, np.array([0, len(buf)]), SEPARATOR, FOLD, hashed=False)
    low = FOLD[buf].tobytes()
    return [low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class NgramSet:
    """Windows of item words by length: sorted hashes, a bitmap before them, and the words to verify with."""

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        windows: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = _words(text)
            size = min(n, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                windows[size][tuple(words[k : k + size])].add(item)
        self.by_length = {}
        for size, grams in sorted(windows.items()):
            joined = [b" ".join(g) for g in grams]
            buf = np.frombuffer(b"\n".join(joined), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(x) + 1 for x in joined])])
            off[-1] = len(buf)
            _, _, h, doc = words_of(buf, off, SEPARATOR, FOLD)
            at, keys = window_hashes(h, doc, size)
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_length[size] = (keys[order], [joined[i] for i in doc[at[order]]], [sorted(grams[tuple(joined[i].split(b" "))]) for i in doc[at[order]]], bitmap)

    def hits(self, low: np.ndarray, starts, ends, h, doc) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, length, items) of each verified occurrence."""
        for size, (keys, grams, owners, bitmap) in self.by_length.items():
            at, w = window_hashes(h, doc, size)
            maybe = np.flatnonzero(bitmap[(w >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            at, w = at[maybe], w[maybe]
            k = np.searchsorted(keys, w)
            k[k == len(keys)] = 0
            for i, j in zip(at[keys[k] == w].tolist(), k[keys[k] == w].tolist(), strict=True):
                while True:  # equal hashes of different windows lie side by side
                    if grams[j] == b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)):
                        yield i, size, owners[j]
                        break
                    if j + 1 >= len(keys) or keys[j + 1] != keys[j]:
                        break
                    j += 1


def _marker(grams, at: int):
    """Adds to the last two columns the word spans hit, as a, b, a, b, ..., and the items; column `at` has the text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = grams.value
        for batch in batches:
            buf, off = buffer_of(batch.column(at))
            marks, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, j in pieces(off):
                part, part_off = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, h, doc = words_of(part, part_off, SEPARATOR, FOLD)
                hit, owners = np.zeros(len(starts), bool), defaultdict(set)
                for k, size, found in index.hits(FOLD[part], starts, ends, h, doc):
                    hit[k : k + size] = True
                    owners[int(doc[k])].update(found)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                for d, found in owners.items():
                    marks[i + d] = [*marks[i + d], *np.stack(runs(hit[first[d] : first[d + 1]]), 1).reshape(-1).tolist()]
                    items[i + d] = sorted({*items[i + d], *found})
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(marks, kind), pa.array(items, kind)], batch.schema.names)

    return mark


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int) -> DataFrame:
    """docs with two more columns, the last: marks of all blocks, and items."""
    names = []
    for name in ("__marks", "__items"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    out = docs.withColumns({name: F.array().cast("array<long>") for name in names})
    schema, at = out.schema, docs.columns.index("text")
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        items = [(NO_ITEM if r[0] is None else int(r[0]), r[1]) for r in part.collect()]  # about block_bytes
        out = out.mapInArrow(_marker(docs.sparkSession.sparkContext.broadcast(NgramSet(items, n)), at), schema)
    return out


def _union(marks: list[int], n: int) -> np.ndarray:
    """Which of n words lie in a span of marks."""
    hit = np.zeros(n, bool)
    for x, y in zip(marks[::2], marks[1::2], strict=True):
        hit[x:y] = True
    return hit


def _reporter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        buf, off = buffer_of(batch.column(1))
        counts, spans, where = [], [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        marks = batch.column(2).to_pylist()
        for i, j in pieces(off):
            part, part_off = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, ends, _, doc = words_of(part, part_off, SEPARATOR, FOLD, hashed=False)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            counts += np.diff(first).tolist()
            for d in range(j - i):
                if marks[i + d]:
                    f = int(first[d])
                    a, b = runs(_union(marks[i + d], int(first[d + 1]) - f))
                    spans[i + d] = [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    where[i + d] = [{"a": int(starts[f + x] - part_off[d]), "b": int(ends[f + y - 1] - part_off[d])} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(where, span), batch.column(3)], ["doc_id", "n_words", "spans", "byte_spans", "items"])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, word spans and byte spans hit (merged, end exclusive) and the items with a window in the document (NO_ITEM: null)."""
    marked = _marked(with_ids(docs, "text"), benchmark, n, block_bytes)
    return marked.mapInArrow(_reporter, f"doc_id long, n_words long, spans {_SPANS}, byte_spans {_SPANS}, items array<long>")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, benchmark, n, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    ids = F.concat_ws(",", F.array_sort(F.transform(F.array_remove("items", F.lit(NO_ITEM)), lambda x: x.cast("string"))))
    return without_ids(found).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cutter(names: list[str], share: float):
    """Cuts the union of the marked spans, or drops the document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            buf, off = buffer_of(batch.column(at))
            for d, marks in enumerate(batch.column(len(names)).to_pylist()):
                if not marks:
                    continue
                part = buf[off[d] : off[d + 1]]
                starts, ends, _, _ = words_of(part, np.array([0, len(part)]), SEPARATOR, FOLD, hashed=False)
                hit = _union(marks, len(starts))
                keep[d] = hit.sum() <= share * len(starts)
                raw, out, last = part.tobytes(), [], 0
                for x, y in zip(*(e.tolist() for e in runs(hit)), strict=True):
                    out.append(raw[last : starts[x]])
                    last = int(ends[y - 1])
                texts[d] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return cut


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the words hit; a document with more than drop_share of its words hit goes altogether."""
    return _marked(docs, benchmark, n, block_bytes).mapInArrow(_cutter(docs.columns, drop_share), docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS gram
      FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM d, s, unnest(range(1, len(w) - n + 2)) AS t(k)),
o AS (SELECT x.doc_id, x.n, x.k, g.item_id FROM x JOIN g ON x.gram = g.gram AND x.n = g.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
