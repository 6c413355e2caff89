"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A round is a window (one sequence): each queue is credited with its share of what the
window needs, serves the whole tokens of its deficit (credit less what it was served) and carries the rest into the next
window. A token is due once the deficit reaches the queue's phase, a fixed part of a token that differs between queues, lest
equal queues have all their turns at once. So while all queues last, a window's tokens of a queue differ from its share p of
the window by at most 1 + p * queues, commonly by one or two, and windows are full but for the last.

Distribution: credits grow in proportion to a virtual time, at which queue q with weight w has its i-th turn at
(i + phase) / w. Deficits at the start of any window are therefore known without replaying earlier ones, and any task plans
just the blocks of windows its documents meet, with the deficits that all windows before them leave: blocks and partitions
change nothing (tested against one sequential replay). Queue positions come from per-task token sums, so no task sees a
whole queue, and these few rows are written, so that the planner can broadcast them instead of shuffling the tokens. A
block's plan takes memory by its tokens, however many queues there are. Token ids are made once and kept in the shared folder.

Defined cases: null text is empty and gives the end id alone; documents and sources may repeat; a null source is a queue
of its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalode.llm._support import buffer_of, ints, materialise
from stratalode.llm._support import pieces as split

LENGTH = 2048
END_ID = 1
#: Tokens planned at once, and rows of plans that a task keeps.
BLOCK, KEPT = 1 << 18, 1 << 20
#: Token ids of the pieces that a task holds before it sends them, about.
RUN = 1 << 19
#: Characters whose classes every version of the two libraries' patterns agrees on.
_PLAIN = re.compile(r"[^\t\n\r -~\u00a1-\u00ac\u00ae-\u017f\u2010-\u2027\u20ac]")
#: Bytes that only texts may hold that need the closer look: controls, and lead bytes of characters outside U+00C0-U+017F.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), 11, 12, *range(14, 32), 127, 0xC2, *range(0xC6, 256)]] = True
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE ids of texts as little-endian unsigned 16- or 32-bit integers.

    The file is one of `tokenizers`. Where its ids follow the order of its merges, the same ranks and pattern run in
    `tiktoken` for plain text, several times faster with equal ids; other texts and other files go to `tokenizers`.
    """

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ids = [*spec["model"]["vocab"].values()] if isinstance(spec["model"].get("vocab"), dict) else [self.model.get_vocab_size() - 1]
        self.width = 2 if max([*ids, *(t["id"] for t in spec.get("added_tokens", []))], default=0) < 1 << 16 else 4
        self.fast = self._ranked(spec)

    @cached_property
    def model(self):
        """Read when the first text needs it: most tasks hold one table of the vocabulary."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        return model

    @staticmethod
    def _ranked(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or spec.get("normalizer"):
            return None
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merged]
        if any(a >= b for a, b in zip(ids, ids[1:])):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], odd: list[bool] | None = None) -> list[bytes]:
        """odd: which texts may hold characters that aren't plain; by default all are looked at."""
        kind, out = f"<u{self.width}", []
        for t, look in zip(texts, odd or [True] * len(texts), strict=True):
            if self.fast is None or look and _PLAIN.search(t):
                out.append(np.array(self.model.encode(t, add_special_tokens=False).ids, kind).tobytes())
            else:
                ids = array("H" if self.width == 2 else "I", self.fast.encode_ordinary(t))
                if sys.byteorder == "big":
                    ids.byteswap()
                out.append(ids.tobytes())
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokeniser(path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path or default_tokenizer())
        tail, pid, before = np.array([end], f"<u{enc.width}").tobytes(), TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, hi in split(buffer_of(batch.column(2))[1]):
                part = batch.slice(lo, hi - lo)
                buf, off = buffer_of(part.column(2))
                odd = np.zeros(part.num_rows, bool)
                odd[np.searchsorted(off, np.flatnonzero(_ODD[buf]), "right") - 1] = True
                ids = [x + tail for x in enc.encode([t or "" for t in part.column(2).to_pylist()], odd.tolist())]
                queues, starts, counts = part.column(1).to_pylist(), [], []
                for q, x in zip(queues, ids, strict=True):
                    starts.append(before.get(q, 0))
                    counts.append(len(x) // enc.width)
                    before[q] = starts[-1] + counts[-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([pid] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([enc.width] * len(ids), pa.int32())],
                    ["doc_id", "queue", "pid", "local", "n", "ids", "width"],
                )

    return run


def phases(queues: int) -> np.ndarray:
    """Fixed, evenly spread parts of a token."""
    return (np.arange(1, queues + 1) * 0.6180339887498949) % 1.0


class Plan:
    """What each window takes from each queue. totals: tokens of each queue; weights: target shares (any scale)."""

    def __init__(self, totals: list[int], weights: list[float], length: int = LENGTH, block: int | None = None):
        """block: windows planned at once."""
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, float)
        self.phase = phases(len(totals))
        self.length, self.block = length, block or max(1, BLOCK // length)
        self.total = int(self.totals.sum())
        self.windows = -(-self.total // length)
        self.plans: dict[int, tuple[np.ndarray, ...]] = {}

    def _turn(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Virtual time at which this token of the queue is due."""
        return (token + self.phase[queue]) / self.weights[queue]

    def served(self, time: float) -> np.ndarray:
        """Tokens of each queue whose turn is at this time or before."""
        every = np.arange(len(self.totals))
        n = np.floor(np.clip(self.weights * time + 1 - self.phase, 0, self.totals)).astype(np.int64)
        n -= (n > 0) & (self._turn(every, n - 1) > time)
        return n + ((n < self.totals) & (self._turn(every, n) <= time))

    def before(self, tokens: int) -> np.ndarray:
        """Tokens served of each queue when `tokens` are served in all; turns at the same time go in queue order."""
        if tokens >= self.total:
            return self.totals.copy()
        lo, hi, few = 0.0, float(np.max((self.totals + 1) / self.weights)), 4 * len(self.totals) + 64
        guess, near = (x / float(self.weights.sum()) for x in (tokens, len(self.totals) + 1))
        for time in (guess - near, guess + near):  # the time lies between these while no queue has run out
            lo, hi = (max(lo, time), hi) if self.served(time).sum() <= tokens else (lo, min(hi, time))
        while (more := self.served(hi)).sum() - (out := self.served(lo)).sum() > few and lo < (mid := (lo + hi) / 2) < hi:
            lo, hi = (mid, hi) if self.served(mid).sum() <= tokens else (lo, mid)
        queue = np.repeat(np.arange(len(out)), more - out)
        token = np.arange(len(queue)) - np.repeat(np.cumsum(more - out) - more, more - out)
        first = np.argsort(self._turn(queue, token), kind="stable")[: tokens - int(out.sum())]
        return out + np.bincount(queue[first], minlength=len(out))

    def of_block(self, b: int) -> tuple[np.ndarray, ...]:
        """Block b as (queue, window, first token of the queue, offset in the window, tokens), by queue and window."""
        if b in self.plans:
            return self.plans[b]
        start, stop = (self.before(x * self.block * self.length) for x in (b, b + 1))
        queues = np.flatnonzero(stop > start)
        count = (stop - start)[queues]
        edge = np.cumsum(count) - count
        queue = np.repeat(queues, count)
        token = np.arange(len(queue)) - np.repeat(edge - start[queues], count)
        window = np.empty(len(queue), np.int64)
        window[np.argsort(self._turn(queue, token), kind="stable")] = np.arange(len(queue)) // self.length
        new = np.flatnonzero(np.concatenate([[True], (queue[1:] != queue[:-1]) | (window[1:] != window[:-1])])) if len(queue) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(queue)))
        order = np.argsort(window[new], kind="stable")
        ahead = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(new), np.int64)
        offset[order] = ahead % self.length  # all windows but the last are full
        while self.plans and sum(len(x[0]) for x in self.plans.values()) + len(new) > KEPT:
            self.plans.pop(next(iter(self.plans)))
        self.plans[b] = queue[new], window[new] + b * self.block, token[new], offset, size
        return self.plans[b]

    def pieces(self, queue: int, start: int, n: int) -> np.ndarray:
        """Rows (window, offset in it, first token in the document, tokens) of tokens [start, start + n) of a queue."""
        out, at, size = [], start, self.block * self.length
        b = int(self.served(float(self._turn(queue, start))).sum() - 1) // size
        while b and self.before(b * size)[queue] > start:  # turns at the same time may lie before the block's start
            b -= 1
        while at < start + n:
            queues, window, first, offset, count = self.of_block(b)
            i, j = np.searchsorted(queues, [queue, queue + 1])
            lo, hi = i + max(0, int(np.searchsorted(first[i:j], at, "right")) - 1), i + int(np.searchsorted(first[i:j], start + n))
            if hi > lo:
                begin, end = np.maximum(first[lo:hi], at), np.minimum(first[lo:hi] + count[lo:hi], start + n)
                some = end > begin
                out.append(np.stack([window[lo:hi], offset[lo:hi] + begin - first[lo:hi], begin - start, end - begin])[:, some])
                at = max(at, int(end[-1]))
            b += 1
        return np.concatenate(out, axis=1)


def _cut(plan: Plan, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first token in it, tokens, window, offset there) of the pieces of documents, in their order.

    Documents of a queue that follow each other there are cut together.
    """
    order = np.lexsort((start, queue))
    q, s, e = queue[order], start[order], start[order] + n[order]
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != e[:-1])]))
    out = []
    for i, j in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
        window, offset, at, size = plan.pieces(int(q[i]), int(s[i]), int(e[j - 1] - s[i]))
        docs = s[i:j] - s[i]
        edges = np.union1d(at, docs)
        row, doc = np.searchsorted(at, edges, "right") - 1, np.searchsorted(docs, edges, "right") - 1
        out.append((order[i:j][doc], edges - docs[doc], np.diff(np.append(edges, at[-1] + size[-1])), window[row], offset[row] + edges - at[row]))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)]
    by = np.lexsort((joined[1], joined[0]))
    return tuple(x[by] for x in joined)


def _packer(names: list[str], totals: list[int], weights: list[float], length: int):
    fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number = Plan(totals, weights, length), {q: k for k, q in enumerate(names)}
        for batch in batches:
            start, n = ints(batch.column(2)), ints(batch.column(3))
            queue = np.array([number[q] for q in batch.column(1).to_pylist()], np.int64)
            buf, off = buffer_of(batch.column(4))
            width = int(batch.column(5)[0].as_py()) if batch.num_rows else 4
            for i, j in split(off, RUN * width):
                owner, at, size, window, offset = _cut(plan, queue[i:j], start[i:j], n[i:j])
                # pieces cover their documents in order, so their ids are the documents' ids one after another
                ids = np.frombuffer(buf[off[i] : off[j]].tobytes(), f"<u{width}").astype("<u4")
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * np.int32(4)
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                whose = pa.array(owner + i)
                columns = [batch.column(0).take(whose), pa.array(at), pa.array(size), binary, batch.column(3).take(whose), pa.array(window), pa.array(offset), batch.column(1).take(whose)]
                yield pa.RecordBatch.from_arrays(columns, fields)

    return run


def pack(docs: DataFrame, length: int = LENGTH, targets: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids as little-endian unsigned 32-bit, doc_tokens, sequence_id, offset, queue).

    targets: share of each source in every window, by default the sources' own shares, so that all queues last to the
    end. Queues that run out earlier leave their share to the others.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("\x00null"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("queue"), F.col("text"))
    made = materialise(slim.mapInArrow(_tokeniser(tokenizer, end_id), "doc_id long, queue string, pid int, local long, n long, ids binary, width int"), "tokens")
    sums = materialise(made.groupBy("pid", "queue").agg(F.sum("n").alias("tokens")), "queue-sums", files=1)
    before = sums.select("pid", "queue", F.coalesce(F.sum("tokens").over(Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = materialise(before, "queue-bases", files=1)
    totals = {r[0]: r[1] for r in sums.groupBy("queue").agg(F.sum("tokens")).collect()}  # one row a queue
    names = sorted(totals)
    counts = [int(totals[q]) for q in names]
    weights = [float((targets or {}).get(q, 0.0)) if targets else float(c) for q, c in zip(names, counts, strict=True)]
    least = min([w for w in weights if w > 0], default=1.0) * 1e-3
    placed = made.join(before, ["pid", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("local")).alias("start"), "n", "ids", "width")
    return placed.mapInArrow(_packer(names, counts, [w or least for w in weights], length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))

