"""Count-min sketches built by partitions, merged without the driver, and read back as one bitmap of what repeats.

A sketch has ROWS rows of 2^bits counters. A task sends, for each stretch of counters it touched, the counters' places
(sorted, delta coded) and the counts of those it met more than once. One group a stretch adds them up; only the bitmap of
counters of 2 or more returns, at most ROWS * 2^MAX_BITS / 8 bytes whatever the input, and the places of the few counters
of HOT or more. An estimate is never too low, so what the bitmap denies is unique for certain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalode.llm._support import U64

ROWS = 2
MIN_BITS, MAX_BITS = 22, 30
#: A key met this often, by the sketch's count, is hot.
HOT = 512
STRETCH = 20
#: Keys a task holds before it sends them.
FLUSH = 4_000_000


def bits_for(keys: int) -> int:
    """Counters for about `keys` occurrences: four a key in each row at least, within bounds that keep memory bounded."""
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(2, 4 * keys))))))


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each key in each row."""
    return [(keys >> U64(64 - bits)).astype(np.int64), ((keys * U64(0xFF51AFD7ED558CCD)) >> U64(64 - bits)).astype(np.int64)]


def _packed(places: np.ndarray) -> bytes:
    gaps = np.diff(places, prepend=0)
    return b"\x04" + gaps.astype("<u4").tobytes() if len(gaps) and gaps.max() >= 1 << 16 else b"\x02" + gaps.astype("<u2").tobytes()


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64))


def _emit(keys: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    found = np.concatenate(keys) if keys else np.zeros(0, U64)
    for row, at in enumerate(cells(found, bits)):
        at = np.sort(at)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at, count = at[first], np.diff(np.append(first, len(at)))
        cut = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << min(STRETCH, bits)))
        out: tuple[list, ...] = ([], [], [], [])
        for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if hi > lo:
                here = at[lo:hi] - (k << STRETCH)
                out[0].append((row << 32) + k)
                out[1].append(_packed(here))
                many = count[lo:hi] > 1
                out[2].append(_packed(here[many]))
                out[3].append(np.minimum(count[lo:hi][many], 65535).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["stretch", "met", "more", "counts"])


def _sender(keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size > FLUSH:
                    yield from _emit(held, bits)
                    held, size = [], 0
        if size:
            yield from _emit(held, bits)

    return send


def _merger(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << min(STRETCH, bits), np.uint32)
        for met, more, counts in zip(table.column("met"), table.column("more"), table.column("counts"), strict=True):
            sums[_places(met.as_py())] += 1
            sums[_places(more.as_py())] += np.frombuffer(counts.as_py(), "<u2").astype(np.uint32) - 1
        return pa.table({"stretch": table.column("stretch").slice(0, 1).cast(pa.int64()), "twice": pa.array([np.packbits(sums > 1).tobytes()], pa.binary()), "hot": pa.array([_packed(np.flatnonzero(sums >= HOT))], pa.binary())})

    return merge


class Repeats:
    """The merged bitmap: may_repeat(keys) is True for every key that occurs twice, and for few others."""

    def __init__(self, bits: int, parts: dict[int, bytes], hot: dict[int, bytes]):
        self.bits = bits
        at = [[_places(raw) + ((k & 0xFFFFFFFF) << STRETCH) for k, raw in sorted(hot.items()) if k >> 32 == row] for row in range(ROWS)]
        self.hot = [np.concatenate([np.zeros(0, np.int64), *x]) for x in at]
        self.rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
        step = 1 << (min(STRETCH, bits) - 3)
        for k, raw in parts.items():
            at = (k & 0xFFFFFFFF) * step
            self.rows[k >> 32][at : at + step] = np.frombuffer(raw, np.uint8)

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, at in zip(self.rows, cells(keys, self.bits), strict=True):
            out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for hot, at in zip(self.hot, cells(keys, self.bits), strict=True):
            k = np.searchsorted(hot, at)
            out &= (hot[np.minimum(k, len(hot) - 1)] == at) if len(hot) else False
        return out


def repeats(source: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int) -> Repeats:
    """Sketch the keys of all rows of source and merge; expected: about how many keys there are."""
    bits = bits_for(expected)
    sent = source.mapInArrow(_sender(keys_of, bits), "stretch long, met binary, more binary, counts binary")
    merged = sent.groupBy("stretch").applyInArrow(_merger(bits), "stretch long, twice binary, hot binary").collect()
    return Repeats(bits, {r[0]: bytes(r[1]) for r in merged}, {r[0]: bytes(r[2]) for r in merged})
