"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are hashed character 4- and 6-grams, folded to lower-case letters
and blanks. Each is scaled by its naive Bayes log-count ratio between toxic
and other labelled texts; a logistic regression over the scaled features
gives the weights. A text's score is the logistic of

    bias + sum over its positions of weight[n-gram] / sqrt(positions),

so scoring is one table look-up a position over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import bounded, hashes, laid_out, position_sums

LENGTHS, HASH_BITS = (4, 6), 20
#: Sample texts whose features are held together while fitting.
TOGETHER = 250
#: Bound of the labelled sample the classifier is fitted on, of either label.
MOST_TOXIC, MOST_OTHER = 3000, 5000
#: Features in fewer sample texts, or with a smaller |log ratio|, weigh nothing.
LEAST_TEXTS, LEAST_RATIO = 3, 0.7
RIDGE, ROUNDS = 1e-5, 600
#: A toxic text counts as so many others: missing one is worse than a false alarm.
TOXIC_WEIGHT = 2.0
FOLDS = 5


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def _counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, their counts, positions) of each text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    positions = np.zeros(len(texts), np.int64)
    for j, n in enumerate(LENGTHS):
        for codes, starts, index in laid_out(texts, n - 1):
            h = hashes(codes, n, HASH_BITS) + np.uint32(j << HASH_BITS)
            for i, a, b in zip(index, *bounded(starts, len(codes), n)):
                found[i].append(h[a:b])
                if j == 0:
                    positions[i] += b - a
    out = []
    for parts, t in zip(found, positions):
        u, k = np.unique(np.concatenate(parts), return_counts=True)
        out.append((u.astype(np.int32), k.astype(np.float32), int(t)))
    return out


def fit(texts: list[str | None], labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from texts, 0/1 labels and row weights.

    Texts are counted twice, TOGETHER at a time: once to choose the features,
    once for the chosen ones, which alone are kept. Without both labels there
    are no features, and the bias is the smoothed log-odds of the labels
    there are.
    """
    size = len(LENGTHS) << HASH_BITS
    toxic = labels == 1
    mass = np.array([weights[toxic].sum(), weights[~toxic].sum()])
    odds = float(np.log((mass[0] + 0.5) / (mass[1] + 1.5)))
    if not toxic.any() or toxic.all():
        return np.empty(0, np.int32), np.empty(0, np.float32), odds
    starts = range(0, len(texts), TOGETHER)
    seen = np.zeros((2, size), np.float32)
    for at in starts:
        for (u, _, _), y in zip(_counts(texts[at : at + TOGETHER]), toxic[at:]):
            seen[0 if y else 1, u] += 1
    ratio = np.log((seen[0] + 0.5) / (toxic.sum() + 1)) - np.log((seen[1] + 0.5) / ((~toxic).sum() + 1))
    ratio[(seen.sum(axis=0) < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    chosen = np.flatnonzero(ratio)
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    blocks, square = [], 0.0  # (texts, features, values, rows) of TOGETHER texts each
    for at in starts:
        cols, vals, sizes = [], [], []
        for u, k, t in _counts(texts[at : at + TOGETHER]):
            own = place[u] >= 0
            cols.append(place[u[own]])
            vals.append((ratio[u[own]] * k[own] / np.sqrt(max(t, 1))).astype(np.float32))
            sizes.append(len(cols[-1]))
        blocks.append((slice(at, at + len(sizes)), np.concatenate(cols), np.concatenate(vals), np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)))
        square += float((blocks[-1][2].astype(np.float64) ** 2).sum())
    scale = np.sqrt(square / len(texts)) or 1.0
    norms = np.concatenate([np.bincount(row, (val.astype(np.float64) / scale) ** 2, minlength=own.stop - own.start) for own, _, val, row in blocks])
    y, share = toxic.astype(np.float64), np.where(toxic, TOXIC_WEIGHT, 1.0) * weights
    share /= share.sum()
    step = 1 / (0.25 * np.quantile(norms, 0.95) + 0.25 + RIDGE)
    # accelerated descent on the weighted mean logistic loss with a ridge
    w = z = np.zeros(len(chosen))
    bias, pace = odds, 1.0
    for _ in range(ROUNDS):
        slope_of, total = np.zeros(len(chosen)), 0.0
        for own, col, val, row in blocks:
            margin = np.bincount(row, val * z[col], minlength=own.stop - own.start) / scale + bias
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[own]) * share[own]
            slope_of += np.bincount(col, val * slope[row], minlength=len(chosen)) / scale
            total += slope.sum()
        after = z - step * (slope_of + RIDGE * z)
        bias -= step * total
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        z, w, pace = after + (pace - 1) / faster * (after - w), after, faster
    return chosen.astype(np.int32), (w * ratio[chosen] / scale).astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most MOST_TOXIC + MOST_OTHER labelled rows outside fold 0.

    The sample is the rows with the smallest hash of the id, so it does not
    hang on order or partitions; it is weighted back to the labels' true
    shares. Null labels are left out; of several labels of an id the toxic
    one holds.
    """
    own = (
        labels.filter(fold_of(id_col, FOLDS) != 0)
        .filter(F.col("toxic").isin(0, 1))
        .groupBy(F.col(id_col).alias("i"))
        .agg(F.max("toxic").cast("int").alias("y"))
        .filter("i is not null")
    )
    total = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    order = [F.xxhash64("i"), F.col("i")]
    some = own.filter("y = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(own.filter("y = 0").orderBy(*order).limit(MOST_OTHER))
    share = {1: total.get(1, 0) / max(1, min(MOST_TOXIC, total.get(1, 0))), 0: total.get(0, 0) / max(1, min(MOST_OTHER, total.get(0, 0)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        y = np.array(ys, np.int64)
        f, w, bias = fit(texts, y, np.where(y == 1, share[1], share[0]))
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.list_(pa.int32())), pa.array([w], pa.list_(pa.float32())), pa.array([bias])], ["f", "w", "bias"])

    # the sample's ids are at most MOST_TOXIC + MOST_OTHER rows
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(some), "i")
    made = sample.select("t", "y").repartition(1).mapInArrow(run, "f array<int>, w array<float>, bias double").collect()
    if not made:
        return fit([], np.empty(0, np.int64), np.empty(0))
    return np.array(made[0]["f"], np.int32), np.array(made[0]["w"], np.float32), made[0]["bias"]


def score_texts(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Scores (0 to 1) of whole texts under a dense [lengths, buckets] table."""
    sums, positions = np.zeros(len(texts)), np.zeros(len(texts))
    for j, n in enumerate(LENGTHS):
        for codes, starts, index in laid_out(texts, n - 1):
            first, stop = bounded(starts, len(codes), n)
            if len(codes) >= n:
                np.add.at(sums, index, position_sums(table[j][hashes(codes, n, HASH_BITS)], first, stop))
            if j == 0:
                np.add.at(positions, index, stop - first)
    z = bias + sums / np.sqrt(np.maximum(positions, 1))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, empty texts too.

    Null texts count as empty: their score is the bias alone. held_out rows
    (fold 0) had no part in the training. Repeated rows score alike. With no
    usable labels every score is the same small value.
    """
    scored = score_column(docs, labels, id_col, text_col, [])
    return scored.select(
        "doc_id",
        (fold_of("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def score_column(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """doc_id, text, the ``others`` columns and the score of every row."""
    features, weights, bias = train(docs, labels, id_col, text_col)
    dense = np.zeros(len(LENGTHS) << HASH_BITS, np.float32)
    dense[features] = weights
    # of fixed size: len(LENGTHS) * 2**HASH_BITS weights
    shared = docs.sparkSession.sparkContext.broadcast(dense.reshape(len(LENGTHS), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = score_texts(b.column(1).to_pylist(), shared.value, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(run, f"{schema}, score double")
