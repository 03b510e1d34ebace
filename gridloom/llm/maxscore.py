"""Exact top-k search by inner product of integers: MaxScore over shards.

A vector's component x counts as floor(scale * x). A dimension is a term; its postings are the vectors in which it isn't
0, and a window of vectors knows the largest and smallest value of each term. A query's terms stand in order of the most that
each can add to a score there. The terms behind the first m are non-essential if together they can't reach the score that
is needed: a vector in none of the first m postings is no candidate. Candidates come from the essential postings; their
other terms are probed, and who falls too far behind for all that is left is dropped. What is needed rises with the best k found.

Vectors are dealt to shards of bounded bytes by a hash of the row. A task holds one shard at a time and reads the queries behind it as a stream, so
that vectors move once and no task holds all queries; each shard's best k of a query are merged. A query starts with the k-th
best score within a bounded sample, a lower bound that cuts nothing that counts.

Vectors that are null or hold null or non-finite components take no part, nor do null ids; zero vectors do. Scores are
defined between vectors of one length (empty ones: 0), so each length is searched for itself. Ties go to the smaller id. Rows
that share a vec_id aren't each other's candidates and are ranked once, by the best score of any of them; so is a query id
that is repeated. Sums that doubles can't hold exactly are made with Python's integers; a score beyond a
long is given as the nearest long. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.ann import stack
from gridloom.llm.common import materialize

#: Bytes of a shard's vectors as doubles, and of the sample; vectors of the sample at most.
SHARD_BYTES, SAMPLE_BYTES, SAMPLE_ROWS = 32 << 20, 16 << 20, 4096
#: Vectors of a window, terms between two prunings; shards for each core at least.
WINDOW, TERMS, SHARDS_A_CORE = 8192, 8, 4
#: Integers below it are exact as doubles.
EXACT = float(1 << 53)

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
SCHEMA = "query_id long, vec_id long, score long"


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles if they hold it, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if np.isfinite(y).all():
        return y
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def exact_ints(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


class Shard:
    """Vectors of one length, searched in windows; ids ascending."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.most = max(x.max(initial=0), -x.min(initial=0))
        self.exact = self if x.dtype == object else None
        self.windows = []
        for at in range(0, len(ids), WINDOW):
            columns = np.ascontiguousarray(x[at : at + WINDOW].T)
            places = [np.flatnonzero(c) for c in columns]
            postings = [p if 4 * len(p) < columns.shape[1] else None for p in places]  # None: most vectors
            self.windows.append((ids[at : at + WINDOW], columns, columns.max(axis=1), columns.min(axis=1), postings))

    def top(self, query_id: int, q: np.ndarray, k: int, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k other ids, best first; those whose score is less than ``limit`` may be missing."""
        if q.dtype == object or self.exact is self or float(abs(q).max(initial=0)) * self.most * self.x.shape[1] >= EXACT:
            self.exact = self.exact or Shard(self.ids, exact_ints(self.x))
            return self.exact.best(query_id, exact_ints(q[None])[0], k, limit)
        return self.best(query_id, q, k, limit)

    def best(self, query_id: int, q: np.ndarray, k: int, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        need = -np.inf if limit is None else limit
        for ids, columns, high, low, postings in self.windows:
            found, score = candidates(q, columns, high, low, postings, need)
            other = ids[found] != query_id
            if not other.any():
                continue
            all_ids, scores = np.concatenate([best_ids, ids[found][other]]), np.concatenate([best, score[other]])
            order = np.argsort(all_ids, kind="stable")
            all_ids, scores = all_ids[order], scores[order]
            first = np.flatnonzero(np.diff(all_ids, prepend=all_ids[0] - 1))
            all_ids, scores = all_ids[first], np.maximum.reduceat(scores, first)
            order = np.argsort(-scores, kind="stable")[:k]
            best_ids, best = all_ids[order], scores[order]
            if len(best) == k:
                need = max(need, best[-1] + 1)  # ids ascend: a later one must be better
        return best_ids, best


def candidates(q: np.ndarray, columns: np.ndarray, high: np.ndarray, low: np.ndarray, postings: list, need) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of a window's vectors whose score is ``need`` or more."""
    reach = np.maximum(q * high, q * low)
    terms = np.flatnonzero(q)
    terms = terms[np.argsort(-reach[terms], kind="stable")]
    rest = np.concatenate([np.cumsum(reach[terms][::-1])[::-1], np.zeros(1, q.dtype)])  # the most that terms from here on can add
    enough = np.flatnonzero(rest < need)
    everyone = np.arange(columns.shape[1])
    if len(enough) == 0:
        at = everyone  # even a vector without any of the terms may do
    else:
        essential = [postings[t] for t in terms[: enough[0]]]
        at = everyone if any(p is None for p in essential) else np.unique(np.concatenate([np.zeros(0, int), *essential]))
    score = np.zeros(len(at), q.dtype)
    for done, t in enumerate(terms, 1):
        if not len(at):
            break
        score += q[t] * (columns[t] if len(at) == columns.shape[1] else columns[t][at])
        if done % TERMS == 0 or done == len(terms):
            hopeful = score + rest[done] >= need
            at, score = at[hopeful], score[hopeful]
    return (at, score) if len(terms) else (at[score >= need], score[score >= need])


def as_long(score) -> int:
    return min(max(int(score), LONG_MIN), LONG_MAX)


def valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def floors(sample: list[tuple[int, bytes]], k: int, scale: int):
    """Adds to queries (vec_id, v) the k-th best score within a sample, null if there are fewer."""
    by_length: dict[int, list[tuple[int, bytes]]] = {}
    for vec_id, raw in sorted(sample):
        by_length.setdefault(len(raw) // 8, []).append((vec_id, raw))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {d: Shard(np.array([i for i, _ in rows]), integers(np.frombuffer(b"".join(r for _, r in rows)).reshape(len(rows), d), scale)) for d, rows in by_length.items()}
        for batch in batches:
            limits = []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.array(v.as_py(), float)
                scores = shards[len(x)].top(vec_id, integers(x[None], scale)[0], k, None)[1] if len(x) in shards else []
                limits.append(as_long(scores[-1]) if len(scores) == k and scores[-1] >= LONG_MIN else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(limits, pa.int64())], ["vec_id", "v", "limit"])

    return apply


def scan(k: int, scale: int):
    """Rows (dim, shard, asks, vec_id, v, limit) in this order: the vectors of a shard, then the queries that it answers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            dims, shards, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            changes = (np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(changes) + 1), batch.num_rows] if batch.num_rows else []
            for low, high in zip(edges, edges[1:]):
                if key != (dims[low], shards[low]):
                    key, held, shard = (dims[low], shards[low]), [], None
                dim = int(dims[low])
                x = stack(batch.column(4).slice(low, high - low), dim) if dim else np.zeros((high - low, 0))
                if not asks[low]:
                    held.append((ids[low:high], x))
                elif held:
                    shard = shard or Shard(np.concatenate([i for i, _ in held]), integers(np.concatenate([v for _, v in held]), scale))
                    limits = batch.column(5).slice(low, high - low).to_pylist()
                    out: list[tuple[int, int, int]] = []
                    for query_id, q, limit in zip(ids[low:high].tolist(), x, limits):
                        found, score = shard.top(query_id, integers(q[None], scale)[0], k, limit)
                        out += [(query_id, i, as_long(s)) for i, s in zip(found.tolist(), score)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return apply


def search(vectors: DataFrame, query_filter: Column, k: int = 10, scale: int = 1024, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each row that passes the filter. vectors: vec_id, column."""
    spark = vectors.sparkSession
    rows = valid(vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"), F.coalesce(query_filter, F.lit(False)).alias("asks")))
    size = rows.agg(F.coalesce(F.sum(8 * (F.size("v") + 1).cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    shards = max(SHARDS_A_CORE * spark.sparkContext.defaultParallelism, -(-size.bytes // SHARD_BYTES))
    some = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (size.dim + 1))))
    packed = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(some).select("vec_id", "v").mapInArrow(pack, "vec_id long, v binary")
    sample = [(r.vec_id, bytes(r.v)) for r in packed.collect()]  # SAMPLE_ROWS and SAMPLE_BYTES at most
    keys = [F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard")]
    members = rows.select(*keys, F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("limit"))
    asked = rows.where("asks").select("vec_id", "v").distinct().mapInArrow(floors(sample, k, scale), "vec_id long, v array<double>, limit long")
    asked = asked.select(keys[0], F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v", "limit")
    dealt = members.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "vec_id")
    found = materialize(dealt.mapInArrow(scan(k, scale), SCHEMA), "maxscore-found")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v.as_py(), float).tobytes() for v in batch.column(1)], pa.binary())], ["vec_id", "v"])


#: Every pair of a query and a candidate in DuckDB SQL.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0)::BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x) GROUP BY q.vec_id, c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
