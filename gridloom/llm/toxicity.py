"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Presence of lower-cased character n-grams, hashed, is counted in the toxic and the other
labelled texts. The log-count ratio r of each n-gram scales its feature; only n-grams whose
difference between the classes is significant are kept, so that the many chance n-grams of a
very long text don't drown a few telling ones. Logistic regression is fitted on the scaled features.

It is fitted on a bounded sample of labelled rows (``max_per_class`` of each class, by a hash of
the id). Every n-gram whose difference has a z of ``min_z`` counts, or of 0.7 times the largest that so few
labelled rows can reach; of these the ``max_features`` most telling ones make the model, all with None (the README has
figures of both). Every whole text is scored.
Null and empty texts have no n-grams: their score is that of the intercept. Rows with a null label don't count.
Repeated rows get equal scores; each labelled one counts. Very long texts count each n-gram once, and are read
whole in slices of their own. Without labelled rows of both classes every score is the share of label 1 (0 without
any). An empty table gives no rows. Other columns than doc_id, text and label aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import code_points, materialize, slices, text_array
from gridloom.llm.ngrams import gram_buckets, inside, lower, owners

LENGTHS, BITS = (3, 4, 5, 6), 20


@dataclass
class Model:
    """Sorted buckets (n-gram length in the high bits), their weights, the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def hits(batch: pa.RecordBatch, selected: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a batch; only those in the sorted array, if it is given."""
    points, offsets = code_points(text_array(batch))
    points, row = lower(points), owners(offsets)
    pairs = []
    for k, n in enumerate(LENGTHS):
        buckets, ok = gram_buckets(points, n, BITS), inside(offsets, n)
        if selected is not None:
            wanted = np.zeros(1 << BITS, bool)
            wanted[selected[(selected >> BITS) == k] & ((1 << BITS) - 1)] = True
            ok &= wanted[buckets]
        at = np.flatnonzero(ok)
        pairs.append(np.unique(row[at] << 24 | k << BITS | buckets[at].astype(np.int64)))
    pairs = np.concatenate(pairs)
    return pairs >> 24, pairs & ((1 << 24) - 1)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, len(LENGTHS) << BITS), np.int32)
    for batch in slices(batches):
        label = batch.column(batch.schema.get_field_index("label")).to_numpy()
        row, feature = hits(batch, None)
        for c in (0, 1):
            counts[c] += np.bincount(feature[label[row] == c], minlength=counts.shape[1]).astype(np.int32)
    seen = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(seen), 100_000):
        part = seen[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[0, part], pa.int64()), pa.array(counts[1, part], pa.int64())], ["feature", "n0", "n1"])


def features_of(selected: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, feature = hits(batch, selected)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            places = np.searchsorted(selected, feature[order]).astype("<i4")
            lists = pa.array([places[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), lists], ["label", "features"])

    return apply


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, label: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of logistic regression on sparse scaled features, by accelerated gradient descent."""
    n, d = len(label), len(scale)
    values = scale[cols]
    norm = np.bincount(rows, values**2, n).max(initial=1.0) + 1
    w = v = np.zeros(d + 1)
    rate = 4 / norm * 4
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * v[cols], n) + v[d]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        gradient = np.append(np.bincount(cols, values * error[rows], d) / n + l2 * v[:d], error.mean())
        step = v - rate * gradient
        v, w = step + (t - 1) / (t + 2) * (step - w), step
    return w[:d] * scale, float(w[d])


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 6000, max_features: int | None = 4096, min_z: float = 4.0, l2: float = 1e-4, steps: int = 400) -> Model:
    """Fit on (doc_id, text) and (doc_id, label); labels must hold only rows to learn from."""
    labels = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    sample = None
    for c in (0, 1):
        part = labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")  # 2 * max_per_class rows at most
    texts = materialize(texts, "toxicity-sample")
    if texts.count() > 2 * max_per_class:  # repeated ids; the bound is one of rows
        texts = materialize(texts.orderBy(F.xxhash64("text"), "label").limit(2 * max_per_class), "toxicity-sample")
    totals = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / max(n0 + n1, 1), 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = texts.mapInArrow(count_features, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p0, p1, p = F.col("n0") / n0, F.col("n1") / n1, (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    ratio = F.log((F.col("n1") + 1) / (n1 + 2)) - F.log((F.col("n0") + 1) / (n0 + 2))
    least = min(min_z, 0.7 * float(np.sqrt(4 * n0 * n1 / (n0 + n1))))  # few labelled rows can't reach more than the root
    chosen = counts.select("feature", F.abs(z).alias("z"), ratio.alias("r")).where(F.col("z") >= least)
    kept = (chosen if max_features is None else chosen.orderBy(F.desc("z"), "feature").limit(max_features)).collect()  # as many as there are buckets at most
    kept.sort(key=lambda x: x.feature)
    selected, scale = np.array([x.feature for x in kept], np.int64), np.array([x.r for x in kept], float)
    rows = texts.mapInArrow(features_of(selected), "label int, features binary").collect()  # 2 * max_per_class rows at most
    label = np.array([r.label for r in rows], float)
    lengths = np.array([len(r.features) // 4 for r in rows], int)
    cols = np.frombuffer(b"".join(r.features for r in rows), "<i4").astype(int)
    weights, intercept = logistic(np.repeat(np.arange(len(rows)), lengths), cols, scale, label, l2, steps)
    return Model(selected, weights, intercept)


def score_with(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, feature = hits(batch, model.buckets)
            z = model.intercept + np.bincount(row, model.weights[np.searchsorted(model.buckets, feature)], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return apply


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(score_with(model), "doc_id long, score double")
