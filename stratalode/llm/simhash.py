"""SimHash near-duplicates over an index of fingerprints in Gray order.

A fingerprint's bit is set if it is set in over half of the 64-bit hashes of the text's word shingles, repeats included. Two
fingerprints link at `far` or fewer differing bits, and a component is what links reach.

The index is a forest of masked bit patterns. Its upper nodes are patterns of a mask of a few bits; far + 1 masks partition the
64 bits, so two linked codes agree in one mask at least and meet below one upper node. A node with too many codes is divided by
far + 1 masks of its free bits in the same way, and what is still too large by tiles of codes, each pair of which is searched.
Spark counts, divides and shuffles the nodes. Below a node, in one task, the codes are sorted by Gray rank; runs of FAN
neighbours, and runs of these, are nodes that hold the bits all their codes share and that no node above holds. A search adds
up the bits in which a code differs from the patterns on its way down, and leaves a whole group as soon as the sum is over far.

A node reports a spanning forest of its links, not all of them, so links grow with codes and no component is lost. Nulls and
texts without words have fingerprint zero; rows with a null doc_id have components like others, and take no part in the least
doc_id (a component of such rows alone has a null id). Equal rows are documents like others. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stratalode.llm._support import U64, buffer_of, materialise
from stratalode.llm.near_dedup import components

SHINGLE, FAR, SEED = 4, 4, 42
#: Neighbours in Gray order that a node of the index takes together.
FAN = 16
#: Codes of a node that one task searches; a pair of tiles has twice as many.
NODE = 4096
#: Divisions by masks before tiles.
DEPTH = 2
#: Pairs of a code and a node that a search holds at once, about.
FRONTIER = 1 << 22
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text; zero without words."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and only the ASCII spaces part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = max(1, len(words) - n + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:k].tolist()
    ends = ends[len(words) - k :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):
        cut = slice(at, at + (1 << 16))
        hashes = map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts[cut], ends[cut], strict=True)], repeat(SEED))
        bits = np.unpackbits(np.fromiter(hashes, U64, len(starts[cut])).view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > k).view(U64)[0])


def _marker(n: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffer_of(batch["text"])
            buf, off = memoryview(np.ascontiguousarray(buf)), off.tolist()
            codes = np.fromiter((fingerprint(bytes(buf[a:b]), n) for a, b in zip(off, off[1:])), U64, batch.num_rows)  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(codes.view(np.int64))], ["doc_id", "fingerprint"])

    return mark


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) of every document."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_marker(n), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def parts_of(taken: int, parts: int) -> list[int]:
    """Masks that partition the bits outside of a mask, each joined with it."""
    free = [b for b in range(64) if not taken >> b & 1]
    return [taken | sum(1 << int(b) for b in part) for part in np.array_split(free, parts)]


def _masks(masks: list[int]) -> Column:
    return F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, as a long whose bits count unsigned."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def dealt(codes: DataFrame, far: int = FAR, most: int = NODE) -> DataFrame:
    """(mask, pattern, i, j, fingerprint): groups of at most about 2 * most codes, one of which every two linked codes share."""
    node, whole, groups = ["mask", "pattern"], [F.lit(0).alias("i"), F.lit(0).alias("j"), "fingerprint"], []
    masks = parts_of(0, far + 1)
    level = codes.select("fingerprint", F.explode(_masks(masks)).alias("mask"))
    for depth in range(DEPTH):
        level = level.withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask")))
        large = materialise(level.groupBy(*node).agg(F.count("*").alias("codes")).where(F.col("codes") > most), "large-nodes")
        groups.append(level.join(large, node, "left_anti").select(*node, *whole))
        level = level.join(large, node)
        if depth < DEPTH - 1:
            below = F.create_map(*(x for m in masks for x in (_masks([m])[0], _masks(parts_of(m, far + 1)))))
            masks = [x for m in masks for x in parts_of(m, far + 1)]
            level = level.select("fingerprint", F.explode(F.element_at(below, F.col("mask"))).alias("mask"))
    tiles = F.ceil(F.col("codes") / F.lit(most))
    level = level.select(*node, "fingerprint", F.pmod(F.xxhash64("fingerprint"), tiles).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))).alias("other"))
    groups.append(level.select(*node, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "fingerprint"))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out


class GrayIndex:
    """Codes sorted by group and Gray rank, below runs of neighbours that hold what their codes share.

    Level 0 are the codes. Node k of a level covers first[k] to first[k + 1] of the level below. `pattern` has the bits that all
    its codes share, `rest` marks those of them that no node above holds.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, fan: int = FAN):
        self.codes, n = codes, len(codes)
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(new, n))
        self.group_end = np.repeat(new + size, size)
        place = np.arange(n) - np.repeat(new, size)
        self.first, self.rest, self.pattern, self.node = [], [], [], []
        run, shared, at = fan, [], [np.arange(n)]
        while True:
            start = np.flatnonzero(place % run == 0)
            both, any_ = np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start)
            shared.append(~(both ^ any_))
            self.pattern.append(both)
            at.append(start)
            self.node.append(np.repeat(np.arange(len(start)), np.diff(np.append(start, n))))
            self.first.append(np.append(np.searchsorted(at[-2], start), len(at[-2])))
            if run >= size.max():
                break
            run *= fan
        for level, mask in enumerate(shared):
            above = shared[level + 1][self.node[level + 1][at[level + 1]]] if level + 1 < len(shared) else U64(0)
            self.rest.append(mask & ~above)
        self.below = ~shared[0]
        self.last = [np.append(a[1:], n) for a in at[1:]]

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of codes whose searches hold about FRONTIER pairs."""
        work = np.cumsum(self.group_end - np.arange(len(self.codes)))
        cut = np.unique(np.searchsorted(work, np.arange(FRONTIER, work[-1] + FRONTIER, FRONTIER), "left") + 1).clip(max=len(work)) if len(work) else []
        a = 0
        for b in cut:
            if b > a:
                yield a, int(b)
                a = int(b)

    def links(self, a: int, b: int, far: int = FAR) -> tuple[np.ndarray, np.ndarray]:
        """(x, y), x in [a, b) and y after x in the same group, that differ in at most far bits."""
        top = len(self.first) - 1
        x = np.arange(a, b)
        lo, hi = self.node[top][x], self.node[top][self.group_end[x] - 1] + 1
        x, node = _ranges(x, lo, hi)
        sums = np.zeros(len(x), np.uint8)
        for level in range(top, -1, -1):
            sums = sums + np.bitwise_count((self.codes[x] ^ self.pattern[level][node]) & self.rest[level][node])
            kept = (sums <= far) & (self.last[level][node] > x + 1)
            x, node, sums = x[kept], node[kept], sums[kept]
            lo, hi = self.first[level][node], self.first[level][node + 1]
            held = self.below[node] if level == 0 else None
            sums, held = np.repeat(sums, hi - lo), None if held is None else np.repeat(held, hi - lo)
            x, node = _ranges(x, lo, hi)
        near = (node > x) & (sums + np.bitwise_count((self.codes[x] ^ self.codes[node]) & held) <= far)
        return x[near], node[near]


def _ranges(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each x beside every number of its range [lo, hi)."""
    n = hi - lo
    out = np.repeat(x, n)
    return out, np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root with the components of the links (a, b) joined; every node's root is the least of its component."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _linker(far: int):
    def found(codes: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        index, root = GrayIndex(codes, group), np.arange(len(codes))
        for a, b in index.blocks():
            root = join_roots(root, *index.links(a, b, far))
        k = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(codes[root[k]].view(np.int64)), pa.array(codes[k].view(np.int64))], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([batch[c].to_numpy().astype(np.int64) for c in ("mask", "pattern", "i", "j", "fingerprint")]))
            now = np.concatenate(held) if len(held) > 1 else held[0]
            change = np.flatnonzero((now[1:, :4] != now[:-1, :4]).any(1)) + 1
            whole = int(change[-1]) if len(change) else 0  # the last group may go on
            if whole:
                yield found(np.ascontiguousarray(now[:whole, 4]).view(U64), np.searchsorted(change, np.arange(whole), "right"))
            held = [now[whole:]]
        if held and len(held[0]):
            last = held[0]
            yield found(np.ascontiguousarray(last[:, 4]).view(U64), np.zeros(len(last), np.int64))

    return link


def links(codes: DataFrame, far: int = FAR, most: int = NODE) -> DataFrame:
    """(a, b): links of distinct codes (fingerprint long) that span every component of codes at far or fewer differing bits."""
    key = ["mask", "pattern", "i", "j"]
    sorted_ = dealt(codes, far, most).repartition(*key).sortWithinPartitions(*key, gray_rank(F.col("fingerprint")))
    return sorted_.mapInArrow(_linker(far), "a long, b long").distinct()


def classes(docs: DataFrame, far: int = FAR, n: int = SHINGLE, most: int = NODE) -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row a document, with the least doc_id that its links reach."""
    marked = materialise(fingerprints(docs, n), "fingerprints")
    codes = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "codes")
    label = components(materialise(links(codes.select("fingerprint"), far, most), "code-links")).select(F.col("node").alias("fingerprint"), "root")
    rooted = codes.join(label, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 4 or fewer differing bits."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
