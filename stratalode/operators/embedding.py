"""Interfaces to models that live elsewhere: batches with a bounded size, checked answers, retries."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 32


def digest_vectors(texts: list[str]) -> list[list[float]]:
    return [[b / 255.0 * 2 - 1 for b in hashlib.sha256(x.encode()).digest()[:16]] for x in texts]


def checked(call: Callable[[list[str]], list], texts: list[str], tries: int = 3, wait: float = 0.5) -> list:
    """call(texts) with one answer a text, tried again with growing waits."""
    for k in range(tries):
        try:
            out = call(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} answers for {len(texts)} texts")
            return out
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    return []


def embed(df: DataFrame, key: str, text: str, call: Callable[[list[str]], list[list[float]]] = digest_vectors, batch: int = BATCH) -> DataFrame:
    """key and vec of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vecs = checked(call, [x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vecs, pa.list_(pa.float64()))], [key, "vec"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, vec array<double>")


def word_candidates(texts: list[str]) -> list[str]:
    """A stand-in extractor: capitalised words as entity candidates."""
    return [json.dumps({"entities": sorted(set(re.findall(r"\b[A-Z][a-z]{3,}\b", x)))[:12], "relations": []}) for x in texts]


def extract_candidates(df: DataFrame, key: str, text: str, call: Callable[[list[str]], list[str]] = word_candidates, batch: int = BATCH) -> DataFrame:
    """key and payload (JSON) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(checked(call, [x or "" for x in part.column(1).to_pylist()]), pa.string())], [key, "payload"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, payload string")
