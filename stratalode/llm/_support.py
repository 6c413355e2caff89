"""Shared plumbing: session folders, Arrow buffers, vectorised words and packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.session import shared_path

U64 = np.uint64
#: Text is worked on in pieces of about this many bytes, which keeps arrays in cache and memory bounded.
PIECE = 1 << 20
_ODD = U64(0x9E3779B97F4A7C15)


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends, lost executors lose nothing.

    files: for small tables, how many to write, so that their size on disk is their rows' and not that of many footers.
    """
    spark = df.sparkSession
    df = df.repartition(files) if files else df
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use, whatever the case of letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents [i, j) of about limit bytes each; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_BYTE_2 = mix(np.arange(1001, 1257, dtype=U64) * _ODD)
_BASE = 0xD6E8FEB86659FD93
_POW_N = PIECE * 2


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if _pow is None or len(_pow[0]) < n:
        size = max(n, _POW_N)
        _pow = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _pow


#: Separators of words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray | None = None, hashed: bool = True):
    """(starts, ends, hashes, document of each word) of the words in the documents buf[off[i]:off[i+1]].

    A word is a longest run of bytes that aren't separators and doesn't cross documents. Equal words have equal
    64-bit hashes; fold maps bytes first. Works blockwise: memory beside the result is bounded but for one huge word.
    """
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, U64), e
    word = np.empty(n + 1, bool)
    word[:n] = ~sep[buf]
    word[n] = False
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = word[:n]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(~word & before)
    if len(cut):  # words that touch across a document's end are two
        cut = np.unique(cut)
        joined = cut[word[cut] & before[cut]]
        if len(joined):
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    doc = np.searchsorted(off, starts, "right") - 1
    if not hashed:
        return starts, ends, None, doc
    return starts, ends, hashes_of(buf, starts, ends, _BYTE if fold is None else _BYTE[fold]), doc


def hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words; by default of a second table of bytes, independent of the first."""
    table = _BYTE_2 if table is None else table
    h, k = np.empty(len(starts), U64), 0
    while k < len(starts):
        lo = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = ends[m - 1]
        up, down = powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[k:m] - lo, ends[k:m] - lo
        h[k:m] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _ODD)
        k = m
    return h


def window_hashes(h: np.ndarray, doc: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, 64-bit hash) of every window of n consecutive words of one document."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    base = mix(np.array([salt * 2 + 0x51ED27], U64))[0] | U64(1)
    out = h[:m].copy()
    for j in range(1, n):
        out *= base
        out += h[j : m + j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(out[at] ^ base)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


#: Stands for a null doc_id inside an operator; such rows rank last.
NO_ID = (1 << 63) - 1


def with_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a long that is never null, and the named columns."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), *columns)


def without_ids(df: DataFrame) -> DataFrame:
    """Undo with_ids."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def to_runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, count) of the runs of consecutive places of one document."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    if not len(doc):
        return doc, at, at
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], at[new], at[last] - at[new] + 1


def union_of(spans: list[dict] | None, width: int) -> list[tuple[int, int]]:
    """Runs (first, n) of windows as merged stretches [a, b) of what those windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["first"] + s["n"] - 1 + width) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as the length of the text now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def same_row(left: str, right: str) -> Column:
    """doc_ids are equal, or both null."""
    return F.coalesce(F.col(left).cast("long"), F.lit(NO_ID)) == F.coalesce(F.col(right).cast("long"), F.lit(NO_ID))
