"""Suffix-array dedup of bytes by a logarithmic index family.

A byte goes if a `width`-byte string that covers it starts anywhere else as well. Suffixes are sampled: of all start
positions in reach, each `width`-byte string has one anchor, its least hashed position, so equal strings have equal
anchors. A first pass sketches the anchors' CONTEXT bytes (see _sketch); strings whose anchor occurs once are unique. A
second pass sends what is left, grouped by the anchor's key, and each group feeds its bytes batch by batch to a
logarithmic family of ordered arrays of suffixes: a new batch is sorted, merge-scanned against every level for matches of full
width, and levels of like size merge. Suffixes are ordered by their first byte and then by a fingerprint of all `width`
bytes, confirmed by a second, independent one: past the first byte only equality over the full width matters, so this order
replaces the lexicographic one of suffix arrays.

Skew: equal stretches within a task travel once. Keys the sketch calls hot, such as a passage in a third of all
documents, don't meet in one group: their strings are dealt by the hash of the whole string, after each task has settled
its own repeats.

Defined cases: null text is empty; texts under `width` bytes lose nothing; a text that repeats itself loses both places;
rows with equal doc_ids are told apart by nothing, so doc_id must be a key (null: one row's worth); an empty table gives
no rows; other columns pass through `remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import _sketch
from stratalode.llm._support import PIECE, U64, buffer_of, free_name, ints, mix, same_row, text_bytes, to_runs, union_of, with_ids, without_ids

WIDTH = 200
CONTEXT = 96
_GRAM = 8
_PLACE_BITS = 22
#: Bytes of content, and hot strings, that a task holds before it sends them.
FLUSH_BYTES = 16 << 20
FLUSH_HOT = 2_000_000
BUCKET_BYTES = 12 << 20
#: Bytes of a new batch of the index.
BATCH_BYTES = 4 << 20


def _coefficients(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _grams(buf: np.ndarray) -> np.ndarray:
    """A mixed 64-bit value of the eight bytes at every position."""
    raw = np.ndarray(len(buf) - _GRAM + 1, "<u8", np.ascontiguousarray(buf), strides=(1,))
    g = raw * U64(0x9E3779B97F4A7C15)
    g ^= g >> U64(29)
    g *= U64(0xBF58476D1CE4E5B9)
    g ^= g >> U64(32)
    return g


def _over(grams: np.ndarray, at: np.ndarray, n: int, *seeds: int, block: int = 1) -> list[np.ndarray]:
    """Hashes, one a seed, of the n bytes at each place, from values over `block` grams each at every block and the last."""
    size = _GRAM * block
    steps = [*range(0, n - size + 1, size)]
    if steps[-1] != n - size:
        steps.append(n - size)
    out = [np.zeros(len(at), U64) for _ in seeds]
    coefficients = [_coefficients(seed, len(steps)) for seed in seeds]
    for k, step in enumerate(steps):
        here = grams[at + step]
        for x, c in zip(out, coefficients, strict=True):
            x += here * c[k]
    return [mix(x) for x in out]


def _strings(grams: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Two independent hashes of the width bytes at each place; wide strings go by mixed values of five grams, made once a position and hash."""
    if width < 5 * _GRAM:
        return _over(grams, at, width, 2, 3)
    m, out = len(grams) - 4 * _GRAM, []
    for seed in (2, 3):
        wide = grams[:m] * _coefficients(seed + 20, 1)[0]
        for j, c in zip(range(1, 5), _coefficients(seed + 2, 4), strict=True):
            wide += grams[j * _GRAM : m + j * _GRAM] * c
        out += _over(mix(wide), at, width, seed, block=5)
    return out


def _least(grams: np.ndarray, m: int, reach: int) -> np.ndarray:
    """For each of m windows the leftmost place of the least gram among `reach` places from its start."""
    n = m + reach - 1
    pad = -n % reach
    v = np.full(n + pad, ~U64(0))
    v[:n] = (grams[:n] >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | np.arange(n, dtype=U64)
    blocks = v.reshape(-1, reach)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:m], before[reach - 1 : reach - 1 + m]) & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _stretches(buf: np.ndarray, off: np.ndarray, width: int, context: int):
    """(start of the stretch, its bytes, grams, starts of whole windows in it, their anchors and keys), piece by piece."""
    n = len(buf)
    for lo in range(0, n - width + 1, PIECE):
        m = min(PIECE, n - width + 1 - lo)
        part = buf[lo : lo + m + width - 1]
        valid = np.ones(m, bool)
        for e in off[np.searchsorted(off, lo, "right") : np.searchsorted(off, lo + m + width, "left")].tolist():
            valid[max(0, e - width + 1 - lo) : max(0, e - lo)] = False
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        grams = _grams(part)
        anchor = _least(grams, m, width - context + 1)[at]
        new = np.diff(anchor, prepend=-1) != 0
        yield lo, part, grams, at, anchor, _over(grams, anchor[new], context, 1)[0], new


def _keys_of(width: int, context: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        buf, off = buffer_of(batch.column(1))
        for *_, key, _ in _stretches(buf, off, width, context):
            yield key

    return keys


_SENT = "bucket int, doc binary, start binary, n binary, body binary, h1 binary, h2 binary, hot_doc binary, hot_at binary, done_doc binary, done_first binary, done_n binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_NONE = np.zeros(0, np.int64)
#: In place of a document whose window is already settled: it only proves that the string occurs.
_SETTLED = -(1 << 62)


class _Outbox:
    """What a task sends: stretches of plain keys, hashes of hot windows, runs settled here; by bucket."""

    def __init__(self, buckets: int, width: int, turn: int):
        self.buckets, self.width, self.turn = buckets, width, turn
        self.clear()

    def clear(self) -> None:
        self.bodies: dict[bytes, list[int]] = {}  # body -> [bucket, doc, start, count of further ones]
        self.bytes, self.hot, self.n_hot = 0, [], 0
        self.done: list[tuple[int, int, int]] = []

    def add(self, bucket: int, doc: int, start: int, n: int, body: bytes) -> None:
        known = self.bodies.get(body)
        if known is None:
            self.bodies[body] = [bucket, doc, start]
            self.bytes += len(body)
        else:
            if known[1] != _SETTLED:
                self.done.append((known[1], known[2], n))
                known[1] = _SETTLED
            self.done.append((doc, start, n))

    def add_hot(self, h1, h2, doc, at) -> None:
        self.hot.append((h1, h2, doc, at))
        self.n_hot += len(h1)

    def full(self) -> bool:
        return self.bytes > FLUSH_BYTES or self.n_hot > FLUSH_HOT or len(self.done) > FLUSH_HOT

    def send(self) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for body, (bucket, doc, start) in self.bodies.items():
            by_bucket.setdefault(bucket, []).append((doc, start, len(body) - self.width + 1, body))
        hot, done = (_NONE.astype(U64), _NONE.astype(U64), _NONE, _NONE), [_NONE, _NONE, _NONE]
        if self.done:
            done = [np.array(x, np.int64) for x in zip(*self.done, strict=True)]
        if self.hot:
            h1, h2, doc, at = map(np.concatenate, zip(*self.hot, strict=True))
            order = np.lexsort((h2, h1))
            h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
            first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            starts = np.flatnonzero(first)
            many = np.diff(np.append(starts, len(h1))) > 1
            again = np.repeat(many, np.diff(np.append(starts, len(h1))))
            done = [np.concatenate(x) for x in zip(done, to_runs(doc[again], at[again]), strict=True)]
            hot = (h1[starts], h2[starts], np.where(many, _SETTLED, doc[starts]), at[starts])
        bucket = (hot[0] % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        here = sorted({*by_bucket, *np.unique(bucket).tolist(), *([self.turn % self.buckets] if len(done[0]) else [])})
        lo, hi = (np.searchsorted(bucket[order], here, side).tolist() for side in ("left", "right"))
        rows: list[list] = [[] for _ in _NAMES]
        for b, i, j in zip(here, lo, hi, strict=True):  # the buckets met, however many there are
            part, plain = order[i:j], by_bucket.get(b, [])
            own = done if b == self.turn % self.buckets else (_NONE,) * 3
            docs, starts, ns, bodies = zip(*plain, strict=True) if plain else ((), (), (), ())
            values = [b, *(np.array(x, np.int64).tobytes() for x in (docs, starts, ns)), b"".join(bodies), *(x[part].tobytes() for x in hot), *(x.tobytes() for x in own)]
            for column, x in zip(rows, values, strict=True):
                column.append(x)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], _NAMES)
        self.turn += 1
        self.clear()


def _sender(repeats, width: int, context: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = repeats.value, _Outbox(buckets, width, TaskContext.get().partitionId())
        for batch in batches:
            ids, (buf, off) = ints(batch.column(0)), buffer_of(batch.column(1))
            for lo, part, grams, at, anchor, key, new in _stretches(buf, off, width, context):
                maybe = known.may_repeat(key)
                if not maybe.any():
                    continue
                hot = known.is_hot(key)
                group = np.cumsum(new) - 1
                cold = np.flatnonzero((maybe & ~hot)[group])
                if len(cold):
                    same = np.concatenate([[True], (group[cold][1:] != group[cold][:-1]) | (at[cold][1:] != at[cold][:-1] + 1)])
                    first = np.flatnonzero(same)
                    count = np.diff(np.append(first, len(cold))).tolist()
                    start = at[cold[first]]
                    doc = np.searchsorted(off, start + lo, "right") - 1
                    raw = part.tobytes()
                    bucket = (key[group[cold[first]]] % U64(buckets)).astype(np.int64).tolist()
                    for b, d, f, s, n in zip(bucket, ids[doc].tolist(), (start + lo - off[doc]).tolist(), start.tolist(), count, strict=True):
                        out.add(b, d, f, n, raw[s : s + n + width - 1])
                warm = at[(maybe & hot)[group]]
                if len(warm):
                    doc = np.searchsorted(off, warm + lo, "right") - 1
                    out.add_hot(*_strings(grams, warm, width), ids[doc], warm + lo - off[doc])
                if out.full():
                    yield from out.send()
        yield from out.send()

    return send


class SuffixLevels:
    """Suffix arrays of geometrically growing sizes; matched[i] tells whether suffix i has an equal among those added."""

    def __init__(self, total: int):
        self.matched = np.zeros(total, bool)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (order, confirmation, suffix), sorted

    @staticmethod
    def order(head: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """Suffixes sort by their first byte, then by a fingerprint of the whole width."""
        return (head.astype(U64) << U64(56)) | (fingerprint >> U64(8))

    def add(self, order: np.ndarray, confirm: np.ndarray, suffix: np.ndarray) -> None:
        new = self._sorted(order, confirm, suffix)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
            new = self._sorted(*(np.concatenate(x) for x in zip(self.levels.pop(), new, strict=True)))
        for level in self.levels:  # larger ones are scanned, not rebuilt
            at = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
            hit = np.flatnonzero((level[0][at] == new[0]) & (level[1][at] == new[1]))
            self.matched[new[2][hit]] = True
            self.matched[level[2][at[hit]]] = True
        if len(new[0]):
            self.levels.append(new)

    def _sorted(self, order: np.ndarray, confirm: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sort, mark neighbours that are equal and keep one suffix of each string, as more add nothing."""
        at = np.argsort(order)
        by = order[at]
        if ((by[1:] == by[:-1]) & (confirm[at][1:] != confirm[at][:-1])).any():
            at = np.lexsort((confirm, order))
        order, confirm, suffix = order[at], confirm[at], suffix[at]
        same = (order[1:] == order[:-1]) & (confirm[1:] == confirm[:-1])
        self.matched[suffix[1:][same]] = True
        self.matched[suffix[:-1][same]] = True
        one = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        return order[one], confirm[one], suffix[one]


def _batches(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(strings of each stretch, bytes) of the rows that tasks sent, joined to batches of about BATCH_BYTES."""
    counts, bodies, size = [], [], 0
    for own, body in zip(table.column("n"), table.column("body"), strict=True):
        counts.append(np.frombuffer(own.as_py(), np.int64))
        bodies.append(body.as_py())
        size += len(bodies[-1])
        if size > BATCH_BYTES:
            yield np.concatenate(counts), np.frombuffer(b"".join(bodies), np.uint8)
            counts, bodies, size = [], [], 0
    if size:
        yield np.concatenate(counts), np.frombuffer(b"".join(bodies), np.uint8)


def _matcher(width: int):
    def match(table: pa.Table) -> pa.Table:
        joined = lambda c, k: np.concatenate([np.frombuffer(x.as_py(), k) for x in table.column(c)])
        out = [[joined(c, np.int64) for c in ("done_doc", "done_first", "done_n")]]
        h1, h2, doc, at = (joined(c, k) for c, k in (("h1", U64), ("h2", U64), ("hot_doc", np.int64), ("hot_at", np.int64)))
        index = SuffixLevels(len(h1))
        index.add(h1, h2, np.arange(len(h1)))
        found = index.matched & (doc != _SETTLED)
        out.append(to_runs(doc[found], at[found]))
        doc, start, n = (joined(c, np.int64) for c in ("doc", "start", "n"))
        ends = np.cumsum(n)
        index, done = SuffixLevels(int(n.sum())), 0
        for count, raw in _batches(table):
            size = count + width - 1
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            places = np.repeat(np.cumsum(size) - size, count) + inner
            fingerprint, confirm = _strings(_grams(raw), places, width)
            index.add(index.order(raw[places], fingerprint), confirm, np.arange(done, done + len(places)))
            done += len(places)
        if done:
            owner = np.searchsorted(ends, np.arange(done), "right")
            found = np.flatnonzero(index.matched & (doc != _SETTLED)[owner])
            who = owner[found]
            out.append(to_runs(doc[who], start[who] + found - (ends - n)[who]))
        return pa.table(dict(zip(("doc_id", "first", "n"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return match


def repeated_strings(docs: DataFrame, width: int = WIDTH, context: int | None = None) -> DataFrame:
    """doc_id and spans (first byte, strings) of the width-byte strings that start elsewhere as well."""
    context = context or max(_GRAM, width * CONTEXT // WIDTH)
    source = with_ids(docs, "text")
    total = text_bytes(docs)
    known = _sketch.repeats(source, _keys_of(width, context), int(total * 2 / (width - context + 2)))
    buckets = int(max(64, total * 0.6 / BUCKET_BYTES))
    sent = source.mapInArrow(_sender(docs.sparkSession.sparkContext.broadcast(known), width, context, buckets), _SENT)
    spans = sent.groupBy("bucket").applyInArrow(_matcher(width), "doc_id long, first long, n long")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))  # bounded by the document


def _cut(raw: bytes, spans: list, width: int) -> tuple[bytes, int]:
    out, last, stretches = [], 0, union_of(spans, width)
    for a, b in stretches:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]]), len(stretches)


def _digester(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text or b""
                kept, n = _cut(raw, spans, width)
                for column, x in zip(out, (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    both = with_ids(docs, "text").join(repeated_strings(docs, width), "doc_id", "left").select("doc_id", "text", "spans")
    return without_ids(both.mapInArrow(_digester(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated bytes cut out; a character cut in its middle goes as well."""
    key, held = free_name(docs, "key"), free_name(docs, "spans")
    spans = repeated_strings(docs, width).select(F.col("doc_id").alias(key), F.col("spans").alias(held))
    both = docs.join(spans, same_row("doc_id", key), "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, last = names.index("text"), len(names) - 1
            texts = [t if not s else _cut(t.encode("utf-8", "surrogatepass"), s, width)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:last], names[:last])

    return both.mapInArrow(run, docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
