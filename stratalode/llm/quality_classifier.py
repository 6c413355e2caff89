"""Quality classifier by Bradley-Terry pairwise ranking.

Labels give preferences: a document labelled 1 beats one labelled 0. A document's strength is linear in its features, the
probability of a preference is the logistic function of the strengths' difference, and the weights minimise that logistic
loss (Newton steps with a ridge). The threshold is a quantile of the strengths of all labelled, learnable documents: the one
that leaves as large a share below it as labels call bad. Strengths are mapped to scores so that the threshold is at 0.7.

What is learnt from: rows with crc32(doc_id as text) mod 4 other than 2; the fit takes at most `max_labels` of them (those
of least hash) and `pairs` preferences for each of their rows. Features, strengths, the threshold's quantile and all scores
cover every row. Labels, lang, source and doc_id never enter a score.

Defined cases: null and empty texts have zero features and are scored like any other; labels that are null or of one class
only leave all weights at zero, so every score is 0.7; a document with several labels counts with each; equal rows score
alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm._support import buffer_of, ints, materialise, pieces, window_hashes, with_ids, without_ids, words_of

#: Labelled rows that the fit takes at most, and preferences made for each of them.
MAX_LABELS = 20_000
PAIRS = 8
RIDGE = 1e-3
#: Of the quantile: ranks are right to one in so many.
ACCURACY = 10_000
CUT = 0.7
FEATURES = (
    "log_words", "few_words", "word_length", "long_words", "symbols", "upper", "shouting", "digits", "sentence_ends", "bangs", "pipes",
    "duplicate_lines", "line_words", "repeated_trigrams", "distinct_words", "top_word", "other_bytes", "capitalised",
)


def _sum_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, minlength=n)


def _in_docs(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def _table(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_UPPER, _DIGIT, _END, _BANG, _PIPE, _SYMBOL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".?"), _table("!"), _table("|"), _table("#*$%&<>{}[]^~=+_\\/@")
_LINE = np.zeros(256, bool)
_LINE[10] = True


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document buf[off[i]:off[i+1]]."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    starts, ends, h, doc = words_of(buf, off)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    upper = _UPPER[buf]
    ups = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    word_ups = ups[ends] - ups[starts]
    pair = np.lexsort((h, doc))
    first = np.concatenate([[True], (doc[pair][1:] != doc[pair][:-1]) | (h[pair][1:] != h[pair][:-1])]) if len(pair) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    counts, owner = np.diff(np.append(at, len(pair))).astype(float), doc[pair][at]
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    where, tri = window_hashes(h, doc, 3)
    tdoc = doc[where]
    order = np.lexsort((tri, tdoc))
    same = (tdoc[order][1:] == tdoc[order][:-1]) & (tri[order][1:] == tri[order][:-1]) if len(order) else np.zeros(0, bool)
    repeated = _sum_by(tdoc[order][1:][same], np.ones(int(same.sum())), n)
    _, _, lh, ldoc = words_of(buf, off, sep=_LINE)
    lorder = np.lexsort((lh, ldoc))
    lsame = (ldoc[lorder][1:] == ldoc[lorder][:-1]) & (lh[lorder][1:] == lh[lorder][:-1]) if len(lorder) else np.zeros(0, bool)
    lines = np.maximum(np.bincount(ldoc, minlength=n), 1).astype(float)
    out = [
        np.log1p(words),
        (words < 20).astype(float),
        _sum_by(doc, length, n) / some,
        _sum_by(doc, (length > 12).astype(float), n) / some,
        _in_docs(_SYMBOL[buf], off) / size,
        _in_docs(upper, off) / size,
        _sum_by(doc, (word_ups >= np.maximum(2, length * 0.6)).astype(float), n) / some,
        _in_docs(_DIGIT[buf], off) / size,
        _in_docs(_END[buf], off) / some,
        _in_docs(_BANG[buf], off) / some,
        _in_docs(_PIPE[buf], off) / some,
        _sum_by(ldoc[lorder][1:][lsame], np.ones(int(lsame.sum())), n) / lines,
        np.log1p(words / lines),
        repeated / some,
        np.bincount(owner, minlength=n) / some,
        top / some,
        _in_docs(buf >= 128, off) / size,
        _sum_by(doc, upper[starts].astype(float), n) / some,
    ]
    return np.stack(out, axis=1)


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and its features as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (buf, off) = batch.column(0), buffer_of(batch.column(1))
            for i, j in pieces(off):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), values], ["doc_id", "x"])

    return with_ids(docs, "text").mapInArrow(run, "doc_id long, x array<double>")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights) of the Bradley-Terry model with strength = weights . (x - mean) / deviation."""
    mean, deviation = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    z, w = np.clip((x - mean) / deviation, -8, 8), np.zeros(x.shape[1])
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return mean, deviation, w
    rng, m = np.random.default_rng(seed), pairs * len(x)
    d = z[rng.choice(better, m)] - z[rng.choice(worse, m)]
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1.0) / m + ridge * w
        hessian = (d * (p * (1.0 - p))[:, None]).T @ d / m + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return mean, deviation, w


def _strength(mean: np.ndarray, deviation: np.ndarray, w: np.ndarray) -> Column:
    total = F.lit(0.0)
    for k, (m, s, c) in enumerate(zip(mean.tolist(), deviation.tolist(), w.tolist(), strict=True)):
        total = total + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.get("x", F.lit(k)) - m) / s)) * c
    return total


def _threshold(strength: DataFrame, learnable: DataFrame) -> float:
    """The quantile of the strengths of all labelled, learnable rows that as large a share lies below as is labelled 0."""
    joined = strength.join(learnable, "doc_id")
    share = joined.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    return 0.0 if share is None else joined.agg(F.percentile_approx("strength", F.lit(share), ACCURACY)).first()[0]


def score(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted, strength of every document."""
    made = materialise(with_features(docs), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    few = known.orderBy(F.xxhash64("doc_id"), "quality").limit(max_labels)
    sample = made.join(few, "doc_id").select("doc_id", "x", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(max_labels).toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = ints(sample.column("quality").combine_chunks()) if sample.num_rows else np.zeros(0)
    mean, deviation, w = fit(x, y)
    strength = made.select("doc_id", _strength(mean, deviation, w).alias("strength"))
    cut = _threshold(strength, known) if w.any() else 0.0
    shift = float(np.log(CUT / (1 - CUT)))
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("strength") - cut + shift)))
    out = strength.select("doc_id", held_out().alias("held_out"), F.when(F.col("strength") >= cut, F.greatest(value, F.lit(CUT))).otherwise(value).alias("score"), "strength")
    return without_ids(out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "strength"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
