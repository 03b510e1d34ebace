"""Quality by positive-unlabelled learning: the non-negative unbiased risk is minimised.

Trusted positives are labelled texts of quality 1; every document counts as unlabelled text.
Labels of quality 0 are never used. With the squared loss the three parts of the risk of a linear
score g are quadratic forms of the second moments of the features among positives (P) and
unlabelled texts (U), so moments summed over the whole corpus give the exact risk

    prior * R_P(+)  +  max(0, R_U(-) - prior * R_P(-))

and its minimiser: the solution for a multiplier in [0, 1] of the second term, 1 while that term
is positive, else the one at which it vanishes. The class prior is estimated from the corpus: the
smallest ratio of the tails of U and P under a score that tells P from U (best bin estimation).
(g + 1) / 2, cut to 0..1, estimates the posterior of quality and is the score.

The positives may be a bounded sample (``max_positives``, by a hash of the id). Null texts count
as empty; empty texts have a feature vector, and so a score. Without positives every score is 0. Repeated rows
count as often as they stand there and get equal scores; very long texts count once like others, read whole in slices of
their own. An empty table gives no rows. Other columns aren't read; score_texts keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, slices, text_array, utf8_parts
from gridloom.llm.ngrams import NEWLINE, SPACES, owners, span_hashes, spans

#: Classes of bytes: letters and non-ASCII bytes 0, then as listed. Fixed values.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",;:", b"!", b"?", b"|", b"#*$%&", b"\"'`", b"()[]{}<>", b"-_/\\+=~^@"]
SHAPES = 96
BINS = 1000


def class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(CLASSES, 1):
        table[list(chars)] = k
    return table


_CLASS = class_table()
WIDTH = SHAPES + 15 + 4 + 9


def features(strings: pa.Array) -> np.ndarray:
    """A row of WIDTH numbers from 0 to about 1 for each text; the last is 1."""
    data, offsets = utf8_parts(strings)
    n, size = len(strings), np.maximum(np.diff(offsets), 1)
    row, kind = owners(offsets), _CLASS[data]
    shares = np.bincount(row * 15 + kind, minlength=15 * n).reshape(n, 15) / size[:, None]
    # trigrams of the shape: classes with repeats folded
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
    shape, owner = kind[change].astype(np.int64), row[change]
    code = (shape[:-2] * 225 + shape[1:-1] * 15 + shape[2:]) * 2654435761 % (1 << 32) * SHAPES >> 32
    same = owner[:-2] == owner[2:]
    grams = np.bincount(owner[:-2][same] * SHAPES + code[same], minlength=SHAPES * n).reshape(n, SHAPES).astype(float)
    grams /= np.maximum(grams.sum(axis=1), 1)[:, None]
    # words
    start, end, owner = spans(data, offsets, SPACES)
    hashes = span_hashes(data, start, end)
    words = np.bincount(owner, minlength=n).astype(float)
    repeats = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    order = np.lexsort((hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][first], minlength=n)
    # lines
    ls, le, lo = spans(data, offsets, NEWLINE)
    lines, line_hash = np.bincount(lo, minlength=n), span_hashes(data, ls, le)
    order = np.lexsort((line_hash, lo))
    again = np.zeros(len(order), bool)
    again[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    doubled = np.bincount(lo[order][again], minlength=n) / np.maximum(lines, 1)
    some = np.maximum(words, 1)
    rest = [repeats / some, np.minimum(1, 4 * repeats / some), doubled, (distinct / some) ** 2, np.minimum(1, np.log1p(words) / 10), np.minimum(1, np.bincount(owner, end - start, n) / some / 20), words < 10, words == 0, np.ones(n)]
    loud = np.minimum(1, 8 * shares[:, [1, 8, 10, 11]])
    return np.column_stack([grams, shares, loud, *rest]).astype(np.float32)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = features(text_array(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, WIDTH, WIDTH))
    for batch in batches:
        x, positive = matrix(batch), batch.column(batch.schema.get_field_index("positive")).to_numpy(zero_copy_only=False)
        sums[0] += x.T @ x
        sums[1] += x[positive].T @ x[positive]
    i, j = np.tril_indices(WIDTH)
    yield pa.RecordBatch.from_arrays([pa.array(i * WIDTH + j, pa.int64()), pa.array(sums[0][i, j]), pa.array(sums[1][i, j])], ["cell", "u", "p"])


def linear(weights: np.ndarray):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(c, batch.column(batch.schema.get_field_index(c))) for c in ("doc_id", "positive") if c in batch.schema.names]
            g = matrix(batch) @ weights
            yield pa.RecordBatch.from_arrays([*(a for _, a in keep), pa.array(g)], [*(c for c, _ in keep), "g"])

    return apply


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def solve(su: np.ndarray, sp: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights that minimise the non-negative risk, from mean second moments (the last feature is 1)."""
    mu, mp, eye = su[-1], sp[-1], np.eye(len(su))

    def at(theta: float) -> np.ndarray:
        # gradient of prior * R_P(+) + theta * (R_U(-) - prior * R_P(-)) + ridge |w|^2 / 2 is zero
        return np.linalg.solve((prior * (1 - theta) * sp + theta * su) / 2 + ridge * eye, (prior * (1 + theta) * mp - theta * mu) / 2)

    def negative_part(w: np.ndarray) -> float:
        risk = lambda s, m: (1 + 2 * w @ m + w @ s @ w) / 4
        return risk(su, mu) - prior * risk(sp, mp)

    if negative_part(w := at(1.0)) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if negative_part(w := at(middle)) >= 0:
            low = middle
        else:
            high = middle
    return w


def estimate_prior(u: np.ndarray, p: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Best bin estimation from histograms (ascending scores) of unlabelled texts and positives."""
    nu, np_ = max(u.sum(), 1), max(p.sum(), 1)
    qu, qp = u[::-1].cumsum() / nu, p[::-1].cumsum() / np_
    slack = np.sqrt(np.log(4 / delta) / (2 * nu)) + np.sqrt(np.log(4 / delta) / (2 * np_))
    bound = np.where(qp > 0, (qu + (1 + gamma) * slack) / np.maximum(qp, 1e-12), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(qu[best] / max(qp[best], 1e-12), 0.01, 0.99))


def featurize(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the feature vectors as a table in the shared folder, so that the texts are read once."""
    return materialize(docs.select("doc_id", "text").mapInArrow(vectors, "doc_id long, x binary"), "quality-features")


def fit(vectors_: DataFrame, positives: DataFrame, max_positives: int = 20_000, ridge: float = 1e-4) -> Model:
    """Fit on featurize()'s table, all of it unlabelled, and the ids of trusted positives."""
    sample = positives.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives).withColumn("yes", F.lit(True))
    flagged = vectors_.join(F.broadcast(sample), "doc_id", "left").select("doc_id", "x", F.col("yes").isNotNull().alias("positive"))  # max_positives rows at most
    cells = flagged.mapInArrow(moments, "cell long, u double, p double").groupBy("cell").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect()  # WIDTH ** 2 rows at most
    s = np.zeros((2, WIDTH, WIDTH))
    for r in cells:
        i, j = divmod(r.cell, WIDTH)
        s[:, i, j] = s[:, j, i] = r.u, r.p
    nu, np_ = s[0, -1, -1], s[1, -1, -1]
    if not np_:
        return Model(np.append(np.zeros(WIDTH - 1), -1.0), 0.0)
    su, sp = s[0] / nu, s[1] / np_
    tell = np.linalg.solve(su + sp + 2 * ridge * np.eye(WIDTH), sp[-1] - su[-1])
    bin_ = F.least(F.greatest(F.floor((F.col("g") + 1) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    found = flagged.mapInArrow(linear(tell), "doc_id long, positive boolean, g double").groupBy(bin_.alias("bin")).agg(F.count("*").alias("u"), F.sum(F.col("positive").cast("long")).alias("p")).collect()  # BINS rows at most
    u, p = np.zeros(BINS), np.zeros(BINS)
    for r in found:
        u[r.bin], p[r.bin] = r.u, r.p
    prior = estimate_prior(u, p)
    return Model(solve(su, sp, prior, ridge), prior)


def score(vectors_: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of featurize()'s table."""
    g = vectors_.mapInArrow(linear(model.weights), "doc_id long, g double")
    return g.select("doc_id", F.least(F.greatest((F.col("g") + 1) / 2, F.lit(0.0)), F.lit(1.0)).alias("score"))


def score_texts(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of its text as a last column; a column of that name is replaced."""
    docs = docs.drop(name)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            g = features(text_array(batch)).astype(float) @ model.weights
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip((g + 1) / 2, 0, 1))], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(apply, f"{fields}, `{name}` double")
