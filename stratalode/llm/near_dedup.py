"""MinHash near-dedup by BagMinHash: signatures of weighted Jaccard similarity over word shingles.

A document is a multiset of shingles (five words; a text of fewer, but not none, is one shingle). For every shingle, weights
are cut into octaves [2^j, 2^(j+1)); each octave is a Poisson process of rate 2^j whose points carry a time, a component of
the signature and a level within the octave. A point counts for weights above its level. A component's least counting
point is its signature value, so two documents agree there with probability sum(min) / sum(max) of their weights: unbiased.
Points are generated in order of time and stop once all components are settled, so cost follows the signature's size.

Documents with the same multiset are one representative from the start (an aggregate). Representatives are banded; in a
bucket each is paired with its least and its greatest member only, so no group emits its pairs. Pairs are screened by their
signatures and then verified on the whole multisets. Verified links are closed to components by hooking each root to its
least neighbour. Further rounds take buckets that still hold several components and pair their members with another one.
What is then unchecked between different components of a bucket is checked by tiles: a bucket's members are dealt to tiles
of bounded size, each pair of tiles is a group that counts all its overlaps at once and gives one link a member at most.
So every pair that shares a band is verified or joined already.

Defined cases: null and empty texts have no words; all of them have one multiset, the empty one; equal rows are copies. Inside,
a row is known by a hash of its doc_id and text, so rows that share a doc_id, or have none, are told apart; a class is named by
its least doc_id, and has no name where all its ids are null. An empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm._support import NO_ID, U64, buffer_of, free_name, ints, materialise, mix, pieces, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: 28 bands of 4: a pair at 0.8 shares none with probability 4e-7.
BANDS, PER_BAND = 28, 4
SIZE = BANDS * PER_BAND
#: Share of equal signature values below which a pair isn't verified. A pair at 0.8 has 5.3 standard deviations more, so one
#: in 2e7 of such pairs stops here, as one in 2.5e6 has no band in common: both are the signatures' own error.
SCREEN = 0.60
#: Passes that pair members with one of their bucket (its ends first) before the rest is checked by tiles.
ROUNDS = 3
#: Members of a tile, and bytes of their multisets, on average at most.
TILE, TILE_BYTES = 1024, 16 << 20
#: Keys of representatives that go to all tasks at once, about 100 MB there; more are met by a shuffle of the texts.
BROADCAST_KEYS = 4_000_000
_UNIT = 2.0**-64


def multisets(buf: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted, of the documents buf[off[i]:off[i+1]]."""
    _, _, h, doc = words_of(buf, off)
    count = np.bincount(doc, minlength=len(off) - 1)
    base, full = U64(0x9FB21C651E98DF25), np.zeros(0, U64)
    m = len(h) - n + 1
    at = np.zeros(0, np.int64)
    if m > 0:
        g = h[:m].copy()
        for j in range(1, n):
            g *= base
            g += h[j : m + j]
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        full = mix(g[at])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.array([_fold(h[f : f + c]) for f, c in zip(first.tolist(), count[short].tolist(), strict=True)], U64)
        owner, shingle = np.concatenate([doc[at], short]), np.concatenate([full, extra])
    else:
        owner, shingle = doc[at], full
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[new], shingle[new], np.diff(np.append(new, len(owner)))


def _fold(h: np.ndarray) -> int:
    x = len(h) * 0x9E3779B97F4A7C15
    for v in h.tolist():
        x = (x * 0xC2B2AE3D27D4EB4F + v) & 0xFFFFFFFFFFFFFFFF
    return x


def _octaves(shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, octave, seed) of the octaves that each element's weight reaches into: 0 for [0, 1), j for [2^(j-1), 2^j)."""
    top = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(shingle)), top + 1)
    octave = np.arange(len(element)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    return element, octave, mix(shingle[element] + (octave.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """docs x size BagMinHash values (unsigned 32-bit) of the multisets; all ones for an empty multiset.

    All points up to a time are generated; where a component has none by then, its document is done again to twice the time.
    """
    out = np.full((docs, size), 0xFFFFFFFF, np.uint32)
    weight = np.bincount(owner, count, minlength=docs)
    limit = size * (np.log(size) + 3.0) / np.maximum(weight, 1.0)
    open_ = weight > 0
    while open_.any():
        mine = np.flatnonzero(open_[owner])
        element, octave, seed = _octaves(shingle[mine], count[mine])
        top, doc = count[mine][element], owner[mine][element]
        rate = np.where(octave == 0, 1.0, 2.0 ** (octave - 1))
        low = np.where(octave == 0, 0.0, rate)
        time, step, found = np.zeros(len(seed)), 0, []
        while len(seed):
            step += 1
            x = mix(seed + U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log((x.astype(np.float64) + 1.0) * _UNIT) / rate
            keep = np.flatnonzero(time < limit[doc])
            x, seed, rate, low, time, top, doc = x[keep], seed[keep], rate[keep], low[keep], time[keep], top[keep], doc[keep]
            y = mix(x + U64(0x632BE59BD9B4E019))
            hit = np.flatnonzero(low + (y & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate < top)
            component = ((y[hit] >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            found.append((doc[hit] * size + component, time[hit], (mix(y[hit]) >> U64(32)).astype(np.uint32)))
        slot, when, value = (np.concatenate(c) for c in zip(*found, strict=True))
        best = np.full(docs * size, np.inf)
        np.minimum.at(best, slot, when)
        first = np.flatnonzero(when == best[slot])
        flat = out.reshape(-1)
        flat[slot[first]] = 0xFFFFFFFF
        np.minimum.at(flat, slot[first], value[first])
        open_ &= np.isinf(best.reshape(docs, size)).any(axis=1)
        limit = limit * 2.0
    return out


def expanded(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A multiset as the sorted set of (shingle, number of the occurrence), hashed to 32 bits."""
    many = np.flatnonzero(count > 1)
    inner = np.arange(int(count[many].sum())) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
    again = mix(np.repeat(shingle[many], count[many]) + inner.astype(U64) * U64(0xA24BAED4963EE407))
    return np.unique((np.concatenate([mix(shingle[count == 1]), again]) >> U64(32)).astype(np.uint32))


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[tuple]:
    ids, (buf, off) = ints(batch.column(0)), buffer_of(batch.column(1))
    for i, j in pieces(off):
        yield (ids[i:j], *multisets(buf[off[i] : off[j]], off[i : j + 1] - off[i], n))


def _signer(n: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, at = ints(batch.column(2)), 0
            for ids, owner, shingle, count in _parts(batch, n):
                sig, place = signatures(owner, shingle, count, len(ids), size), places[at : at + len(ids)]
                at += len(ids)
                keys = []
                for salt in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93):
                    each = mix(mix(shingle + U64(salt)) + count.astype(U64) * U64(salt))
                    total = np.zeros(len(each) + 1, U64)
                    np.cumsum(each, out=total[1:])
                    cut = np.searchsorted(owner, np.arange(len(ids) + 1))
                    sums = total[cut[1:]] - total[cut[:-1]]
                    keys.append(pa.array(sums.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), *keys, pa.array([x.tobytes() for x in sig], pa.binary())], ["row", "place", "m1", "m2", "sig"])

    return run


def _bander(bands: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, bands, per).astype(U64)
            key = np.broadcast_to(np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
            for k in range(per):
                key = mix(key + sig[:, :, k] + U64(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *(pa.array(np.repeat(ints(batch.column(c)), bands)) for c in (0, 2))], ["bucket", "rep", "place"])

    return run


def _expander(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, owner, shingle, count in _parts(batch, n):
                cut = np.searchsorted(owner, np.arange(len(ids) + 1))
                bags = [expanded(shingle[a:b], count[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bags, pa.binary())], ["rep", "bag"])

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or len(x) < threshold * len(y):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(bags: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: how many elements the bags (sorted sets) at these places share; a bag's with itself don't count."""
    n, out = len(bags), np.zeros((len(left), len(right)), np.int64)
    owner = np.repeat(np.arange(n), [len(b) for b in bags])
    _, element, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    common = (count > 1) & (count * 32 >= n)
    number, step = np.cumsum(common) - 1, max(1024, (4 << 20) // n)
    at = np.flatnonzero(common[element])
    at = at[np.argsort(number[element[at]], kind="stable")]
    column = number[element[at]]
    for lo in range(0, int(common.sum()), step):  # elements of many bags: products of 0-1 matrices
        part = slice(*np.searchsorted(column, [lo, lo + step]))
        has = np.zeros((n, step), np.float32)
        has[owner[at[part]], column[part] - lo] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    at = np.flatnonzero(((count > 1) & ~common)[element])
    at = at[np.argsort(element[at], kind="stable")]
    many = count[element[at]]
    first = np.searchsorted(element[at], element[at])
    row, col = np.full(n, -1), np.full(n, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    edge = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(at):  # elements of few bags: all their pairs
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + (1 << 20), "right")) - 1)
        m = many[lo:hi]
        other = np.repeat(first[lo:hi] - (edge[lo:hi] - edge[lo]), m) + np.arange(int(m.sum()))
        x, y = row[owner[np.repeat(at[lo:hi], m)]], col[owner[at[other]]]
        both = (x >= 0) & (y >= 0)
        out += np.bincount(x[both] * len(right) + y[both], minlength=out.size).reshape(out.shape)
        lo = hi
    return out


def _tiler(threshold: float):
    """Links of a pair of tiles, as (least of those linked within the group, member)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile, rep, root = (ints(table[c].combine_chunks()) for c in ("tile", "rep", "root"))
        left, right = np.flatnonzero(tile == key[1].as_py()), np.flatnonzero(tile == key[2].as_py())
        x = y = np.zeros(0, np.int64)
        if len(left) and len(right) and (root != root[0]).any():
            bags = [np.frombuffer(b, np.uint32) for b in table["bag"].to_pylist()]
            size = np.array([len(b) for b in bags])
            both = overlaps(bags, left, right)
            near = (both >= threshold * (size[left][:, None] + size[right] - both)) & (both > 0) & (root[left][:, None] != root[right])
            x, y = np.nonzero(near)
            x, y = left[x], right[y]
        order = np.argsort(rep)
        label = np.empty(len(rep), np.int64)
        label[order] = np.arange(len(rep))
        while (label[x] != label[y]).any():
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            label = label[order[label]]
        to = rep[order[label]]
        return pa.table({"a": to[to != rep], "b": rep[to != rep]})

    return run


def _screener(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= share))

    return run


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, column of a, column of b); the hub's side may be hot, which the planner's skew join splits."""
    left, right = (table.select(F.col("rep").alias(k), F.col(column).alias(f"{column}_{k}")) for k in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", f"{column}_a", f"{column}_b")


def components(edges: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(node, root) with the least node of each component, for the nodes of edges (a, b) and of an earlier labelling.

    Each round hooks every root to its least smaller neighbour, jumps along the hooks until each leads to its last root, and
    contracts; a path of n nodes takes one round of log2(n) jumps. Rounds are materialised and shrink.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if label is None:
        label = nodes.select("node", F.col("node").alias("root"))
    else:
        label = label.unionByName(nodes.join(label, "node", "left_anti").select("node", F.col("node").alias("root")))
    label = materialise(label, "labels")
    to_root = label.select("node", "root")
    rest = edges
    for end in ("a", "b"):
        rest = rest.join(to_root.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end).drop(end).withColumnRenamed(f"r{end}", end)
    shrink = lambda e: materialise(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    rest = shrink(rest)
    while rest.limit(1).count():
        hook = _jumped(materialise(rest.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("to")), "hooks"))
        label = materialise(label.join(hook.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        for end in ("a", "b"):
            rest = rest.join(hook.select(F.col("node").alias(end), F.col("to").alias("__to")), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        rest = shrink(rest)
    return label


def _jumped(hook: DataFrame) -> DataFrame:
    """hook (node, to) with `to` replaced by the end of the chain it leads into; each pass halves the chains."""
    while True:
        further = hook.select(F.col("node").alias("to"), F.col("to").alias("end"))
        both = materialise(hook.join(further, "to", "left"), "hooks")
        if not both.where("end IS NOT NULL").limit(1).count():
            return hook
        hook = both.select("node", F.coalesce("end", "to").alias("to"))


def _tiled(now: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all members (bucket, rep, root) of a bucket that are near and have different roots."""
    sized = now.join(bags.select("rep", F.octet_length("bag").alias("bytes")), "rep")
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)).alias("tiles")
    mixed = materialise(sized.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), tiles).where("lo < hi").select("bucket", "tiles"), "rest-buckets")
    dealt = now.join(mixed, "bucket").withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "root")
    return materialise(dealt.join(bags, "rep").groupBy("bucket", "i", "j").applyInArrow(_tiler(threshold), "a long, b long").distinct(), "links")


def row_key() -> Column:
    """What a document is known by inside: equal for equal rows (doc_id, text) only."""
    return F.xxhash64("doc_id", "text")


def row_classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, per: int = PER_BAND, rounds: int = ROUNDS) -> DataFrame:
    """(row, class): the class of near copies of each distinct row (doc_id, text)."""
    source = docs.select(row_key().alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("place"))
    signed = materialise(source.mapInArrow(_signer(n, bands * per), "row long, place long, m1 long, m2 long, sig binary"), "signatures")
    rep = materialise(signed.groupBy("m1", "m2").agg(F.min(F.struct("place", "row"))["row"].alias("rep")), "representatives")
    sigs = signed.join(rep.select("rep"), F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "sig", "place")
    banded = sigs.mapInArrow(_bander(bands, per), "bucket long, rep long, place long")
    # the least doc_id is often what others were copied from
    end = lambda f: f(F.struct("place", "rep"))["rep"]
    ends = banded.groupBy("bucket").agg(end(F.min).alias("lo"), end(F.max).alias("hi")).where("lo <> hi")
    members = materialise(banded.drop("place").join(ends, "bucket"), "buckets")
    wanted = materialise(members.select("rep").distinct(), "candidates")
    # texts aren't shuffled for a set of keys that fits everywhere
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    bags = source.select("row", "text").join(few, F.col("row") == F.col("rep"), "left_semi").mapInArrow(_expander(n), "rep long, bag binary")
    bags = materialise(bags.dropDuplicates(["rep"]), "bags")
    sigs = materialise(sigs.drop("place").join(wanted, "rep", "left_semi").dropDuplicates(["rep"]), "candidate-signatures")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = _with_both(pairs, sigs, "sig").mapInArrow(_screener(SCREEN), "a long, b long")
        return materialise(_with_both(near, bags, "bag").mapInArrow(_verifier(threshold), "a long, b long"), "links")

    def rooted(open_: DataFrame) -> DataFrame:
        return open_.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))

    label = components(verified(members.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("rep").alias("b"))))
    open_ = members.where("rep <> lo AND rep <> hi").select("bucket", "rep")  # not yet paired with all of their bucket
    for k in range(1, rounds):
        now = rooted(open_)
        mixed = materialise(now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(k))).alias("hub")).where("lo < hi").select("bucket", "hub"), "mixed-buckets")
        now = materialise(now.join(mixed, "bucket"), "open")
        if not mixed.limit(1).count():
            break
        pairs = now.where("root <> hub.root").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))
        label = components(verified(pairs), label)
        open_ = now.where("rep <> hub.rep").select("bucket", "rep")
    else:
        label = components(_tiled(rooted(open_), bags, threshold), label)
    final = label.select(F.col("node").alias("rep"), "root")
    named = rep.join(final, "rep", "left").select("m1", "m2", F.coalesce("root", "rep").alias("class"))
    return signed.select("row", "m1", "m2").distinct().join(named, ["m1", "m2"]).select("row", "class")


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, row, class) of every document."""
    return materialise(docs.select("doc_id", row_key().alias("row")).join(row_classes(docs), "row").select("doc_id", "row", "class"), "members")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document; class_id is the least doc_id of its near copies."""
    members = _members(docs)
    # written, so that the join's exchange is its own and a large class's can be split
    names = materialise(members.groupBy("class").agg(F.min("doc_id").alias("class_id")), "class-names")
    return members.join(names, "class").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each class one row with the least doc_id stays, null ids last."""
    row = free_name(docs, "row")
    first = _members(docs).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("row").alias("row")))["row"].alias(row))
    return docs.withColumn(row, row_key()).join(first.select(row), row, "left_semi").dropDuplicates([row]).drop(row)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
