"""Substring dedup over word windows with a count-min prefilter.

First pass: every partition sketches the minimal five-word hash of each window of n words; the merged sketch overestimates
how often a window's minimal hash, and so the window, occurs. Second pass: only windows estimated repeated are grouped
by two independent 64-bit hashes (each of words hashed by a table of its own), after each task has settled what it can alone (a window met in a smaller
document of the same task is removed there, and just the smallest document's places travel). So a passage in a third of
all documents reaches its group once a task. No window is lost: what the sketch denies occurs once.

Result: words covered by a window whose words also start in a document with a smaller doc_id. Defined cases: null and
empty texts have no words; texts under n words have no windows; equal doc_ids count as one document; rows with a null
doc_id rank last and share one document's place; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import _sketch
from stratalode.llm._support import U64, buffer_of, free_name, hashes_of, ints, pieces, same_row, text_bytes, to_runs, union_of, window_hashes, with_ids, without_ids, words_of

WINDOW = 13
GRAM = 5
#: Windows a task holds before it settles them, and bytes of text a word takes at about.
FLUSH = 2_000_000
WORD_BYTES = 6
BUCKET_BYTES = 16 << 20


def _anchored(buf: np.ndarray, off: np.ndarray, n: int):
    """The words (starts, ends, hashes) and their documents; of the windows of n words: first word, place and value of the minimal hash."""
    starts, ends, h, doc = words_of(buf, off)
    m = len(h) - n + 1
    if m <= 0:
        return (starts, ends, h), doc, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    gram = min(GRAM, n)
    _, g = window_hashes(h, np.zeros(len(h), np.int64), gram, salt=9)
    best, arg = g[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, n - gram + 1):
        less = g[j : m + j] < best
        best[less] = g[j : m + j][less]
        arg[less] = j
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return (starts, ends, h), doc, at, at + arg[at], best[at]


def _keys_of(n: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        buf, off = buffer_of(batch.column(1))
        for i, j in pieces(off):
            _, _, _, place, key = _anchored(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
            if len(place):
                yield key[np.flatnonzero(np.diff(place, prepend=-1))]

    return keys


_SENT = "bucket int, h1 binary, h2 binary, doc binary, place binary, done_doc binary, done_first binary, done_n binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _settle(h1, h2, doc, place, buckets: int, turn: int) -> pa.RecordBatch:
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    here = doc == least
    done = to_runs(doc[~here], place[~here])
    h1, h2, doc, place = h1[here], h2[here], doc[here], place[here]
    bucket = (h1 % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    here = np.unique(np.append(bucket, turn % buckets)) if len(done[0]) else np.unique(bucket)
    lo, hi = (np.searchsorted(bucket[order], here, side).tolist() for side in ("left", "right"))
    rows: list[list] = [[] for _ in _NAMES]
    for b, i, j in zip(here.tolist(), lo, hi, strict=True):  # the buckets met, however many there are
        part = order[i:j]
        own = done if b == turn % buckets else (np.zeros(0, np.int64),) * 3
        for column, x in zip(rows, [b, *(x[part].tobytes() for x in (h1, h2, doc, place)), *(x.tobytes() for x in own)], strict=True):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], _NAMES)


def _sender(repeats, n: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, held, size, turn = repeats.value, [], 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, (buf, off) = ints(batch.column(0)), buffer_of(batch.column(1))
            for i, j in pieces(off):
                (starts, ends, h), doc, at, _, key = _anchored(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                keep = np.flatnonzero(known.may_repeat(key))
                if not len(keep):
                    continue
                _, h1 = window_hashes(h, doc, n, salt=1)
                _, h2 = window_hashes(hashes_of(buf[off[i] : off[j]], starts, ends), doc, n, salt=2)
                first = np.searchsorted(doc, np.arange(j - i))
                at = at[keep]
                held.append((h1[keep], h2[keep], ids[i:j][doc[at]], at - first[doc[at]]))
                size += len(keep)
                if size > FLUSH:
                    yield _settle(*map(np.concatenate, zip(*held, strict=True)), buckets, turn)
                    held, size, turn = [], 0, turn + 1
        if size:
            yield _settle(*map(np.concatenate, zip(*held, strict=True)), buckets, turn)

    return send


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])


def _decide(table: pa.Table) -> pa.Table:
    h1, h2, doc, place = (_joined(table, c, k) for c, k in (("h1", U64), ("h2", U64), ("doc", np.int64), ("place", np.int64)))
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
    out = [_joined(table, c, np.int64) for c in ("done_doc", "done_first", "done_n")]
    if len(h1):
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        later = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        out = [np.concatenate(x) for x in zip(out, to_runs(doc[later], place[later]), strict=True)]
    return pa.table({"doc_id": out[0], "first": out[1], "n": out[2]})


def repeated_windows(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id and spans (first word, windows) of the windows that also start in a document with a smaller doc_id."""
    source = with_ids(docs, "text")
    total = text_bytes(docs)
    known = _sketch.repeats(source, _keys_of(n), int(total / WORD_BYTES * 2 / (n - min(GRAM, n) + 2)))
    buckets = int(max(64, total / WORD_BYTES * 0.25 * 32 / BUCKET_BYTES))
    sent = source.mapInArrow(_sender(docs.sparkSession.sparkContext.broadcast(known), n, buckets), _SENT)
    spans = sent.groupBy("bucket").applyInArrow(_decide, "doc_id long, first long, n long")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))  # bounded by the document


def _digester(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()  # at \x20 and \x09-\x0D, as bytes.split() does
                covered = union_of(spans, n)
                kept, last = [], 0
                for a, b in covered:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                for column, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def report(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) of every document."""
    both = with_ids(docs, "text").join(repeated_windows(docs, n), "doc_id", "left").select("doc_id", "text", "spans")
    return without_ids(both.mapInArrow(_digester(n), "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def _cutter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    raw = texts[k].encode("utf-8", "surrogatepass")
                    buf = np.frombuffer(raw, np.uint8)
                    s, e, _, _ = words_of(buf, np.array([0, len(buf)]), hashed=False)
                    out, last = [], 0
                    for a, b in union_of(spans, n):
                        out.append(raw[last : s[a]])
                        last = int(s[b]) if b < len(s) else len(raw)
                    texts[k] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            last = len(names) - 1
            yield pa.RecordBatch.from_arrays(columns[:last], names[:last])

    return run


def remove(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with repeated words cut out of the texts; white space between kept words stays."""
    key, last = free_name(docs, "key"), free_name(docs, "spans")
    spans = repeated_windows(docs, n).select(F.col("doc_id").alias(key), F.col("spans").alias(last))
    both = docs.join(spans, same_row("doc_id", key), "left").drop(key)
    return both.mapInArrow(_cutter(n), docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(k)),
f AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g),
p AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM x JOIN f USING (g) WHERE x.doc_id > f.least),
a AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN p ON u.doc_id = p.doc_id AND u.p = p.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""
