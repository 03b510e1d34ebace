"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Vectors are scaled to length 1 and rotated by a random orthogonal matrix, so that the first
dimensions of a difference are a random projection of it. k-means centroids, fitted on a bounded
sample (``max_sample`` rows by a hash of the id), part all vectors into lists. A query reads the
nearest lists, and further ones until they hold k other vectors. Within a list the rotated vectors are read in column blocks: after each block a
candidate whose partial distance is too large for the hypothesis that it belongs to the best k
is abandoned. Survivors get the exact cosine of the original vectors in double precision.

Each query scans its nearest list first; its best k there bound the scan of all its other lists.

Lists and their queries are dealt out in blocks of bounded bytes, so a list of many copies makes
more tasks, not larger ones. Vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do null ids. Cosine is defined between vectors of one length, so each length is searched for itself.
Ties go to the smaller id. Rows that share a vec_id aren't each other's neighbours and are ranked once, by
the best score of any of them; so is a query id that is repeated. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import materialize

#: Bytes of vectors of a list, and of queries, that one task holds at a time.
BLOCK_BYTES = 16 << 20
#: Different lengths of vectors in one table; more are an error, as no such table is meant to be searched.
LENGTHS = 100
#: Dimensions of a column block, candidates between two updates of the bound, queries at once.
COLUMNS, STEP, QUERIES = 16, 512, 64
#: Tightness of the test: a true neighbour is abandoned with a chance falling as exp(-c * EPSILON ** 2).
EPSILON = 2.1


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 0.5 to 1: cosines stay as they are, without over- or underflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T - (centers**2).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    d = (centers**2).sum(axis=1) - 2 * x @ centers.T
    n = min(n, len(centers))
    part = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1), axis=1)


def valid(vectors: DataFrame, column: str) -> DataFrame:
    c, inf = F.col(column), float("inf")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda v: v != 0) & F.col("vec_id").isNotNull())


def stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def adaptive_scan(q: np.ndarray, x: np.ndarray, q0: np.ndarray, x0: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, epsilon: float = EPSILON, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of the best k of each query. q, x: rotated units; q0, x0: original vectors; limit: squared distances beyond which a candidate isn't wanted."""
    dim = q.shape[1]
    edges = [*range(0, dim, COLUMNS), dim]
    qn, xn = np.sqrt(np.einsum("ij,ij->i", q0, q0)), np.sqrt(np.einsum("ij,ij->i", x0, x0))
    best_q, best_x, best_s = (np.zeros(0, t) for t in (int, int, float))
    for at in range(0, len(q), QUERIES):
        rows = np.arange(at, min(at + QUERIES, len(q)))
        bound = np.full(len(rows), np.inf) if limit is None else limit[rows].copy()
        kq, kx, ks = (np.zeros(0, t) for t in (int, int, float))
        for start in range(0, len(x), STEP):
            cols = np.arange(start, min(start + STEP, len(x)))
            qi, xi = (a.ravel() for a in np.meshgrid(rows, cols, indexing="ij"))
            ok = qid[qi] != xid[xi]
            qi, xi = qi[ok], xi[ok]
            partial = np.zeros(len(qi))
            for b, (low, high) in enumerate(zip(edges, edges[1:])):
                if b == 0:
                    a, c = q[rows, low:high], x[cols, low:high]
                    first = (a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * a @ c.T
                    partial = np.maximum(first.ravel()[ok], 0)
                else:
                    diff = q[qi, low:high] - x[xi, low:high]
                    partial += np.einsum("ij,ij->i", diff, diff)
                slack = (1 + epsilon / np.sqrt(high)) ** 2 * high / dim if high < dim else 1.0
                keep = partial <= bound[qi - at] * slack * (1 + 1e-9) + 1e-9
                qi, xi, partial = qi[keep], xi[keep], partial[keep]
            s = np.einsum("ij,ij->i", q0[qi], x0[xi]) / (qn[qi] * xn[xi])
            kq, kx, ks = np.append(kq, qi), np.append(kx, xi), np.append(ks, s)
            order = np.lexsort((xid[kx], -ks, kq))
            kq, kx, ks = kq[order], kx[order], ks[order]
            rank = np.arange(len(kq)) - np.searchsorted(kq, kq, side="left")
            full = rank == k - 1
            bound[kq[full] - at] = np.minimum(bound[kq[full] - at], 2 - 2 * ks[full])
            kq, kx, ks = kq[rank < k], kx[rank < k], ks[rank < k]
        best_q, best_x, best_s = np.append(best_q, kq), np.append(best_x, kx), np.append(best_s, ks)
    return best_q, best_x, best_s


def probes_for(known: np.ndarray, centers: np.ndarray, k: int, recall: float, queries: int = 400) -> int:
    """How many lists hold that share of the true k neighbours, measured by brute force within the sample."""
    if len(known) <= k or len(centers) == 1:
        return len(centers)
    own = nearest_lists(known, centers, 1)[:, 0]
    at = np.linspace(0, len(known) - 1, min(queries, len(known))).astype(int)
    s = known[at] @ known.T
    s[np.arange(len(at)), at] = -np.inf
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = nearest_lists(known[at], centers, len(centers))
    place = np.argsort(order, axis=1)  # place of each list in the query's order
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed) - 1)]) + 1


def search(vectors: DataFrame, query_filter, k: int = 5, max_sample: int = 20_000, recall: float = 0.96, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row that passes the filter; vectors: vec_id, column.

    The square root of the number of vectors gives the number of lists, an eighth of the sample at most. So many of them
    are read for a query as brute force within the sample needs for ``recall``: few for clustered vectors, more than
    half for vectors without structure. A query whose lists hold fewer than k others reads more.
    """
    rows = valid(vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"), F.coalesce(query_filter, F.lit(False)).alias("asks")), "v")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in sorted(sizes):
        found = found.unionByName(_search(rows.where(F.size("v") == r.dim), r.dim, r.n, k, max_sample, recall))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, dim: int, n_rows: int, k: int, max_sample: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score): the best k of each block of a list that a query reads. rows: vec_id, v, asks, of one length."""
    packed = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("v").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in stack(b.column(0), dim)], pa.binary())], ["v"]) for b in batches), "v binary")
    sample = b"".join(r.v for r in packed.collect())  # max_sample rows at most
    turn = rotation(dim)
    known = unit(np.frombuffer(sample, float).reshape(-1, dim)) @ turn
    centers = kmeans(known, max(1, min(int(np.sqrt(n_rows)), len(known) // 8)))
    probes = probes_for(known, centers, k, recall)
    block = max(1024, BLOCK_BYTES // (8 * dim))

    def near(n: int, ids: np.ndarray | None):
        """(vec_id, x, lists): the n nearest lists; with the numbers of ids, more until k + 1 ids are in them."""

        def apply(batches):
            for batch in batches:
                x = scaled(stack(batch.column(1), dim))
                lists = nearest_lists(unit(x) @ turn, centers, n if ids is None else len(centers))
                if ids is not None:
                    short = (np.cumsum(ids[lists], axis=1) < k + 1).sum(axis=1) + 1
                    lists = [row[:m] for row, m in zip(lists, np.maximum(short, n))]
                raw = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array([row.astype(np.int32) for row in lists], pa.list_(pa.int32()))], ["vec_id", "x", "lists"])

        return apply

    schema = "vec_id long, x binary, lists array<int>"
    members = materialize(rows.select("vec_id", "v").mapInArrow(near(1, None), schema).select("vec_id", "x", F.col("lists")[0].alias("list")), "ann-members")
    held = members.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).collect()  # a row for each list
    ids = np.zeros(len(centers), np.int64)
    for r in held:
        ids[r.list] = r.ids
    queries = materialize(rows.where("asks").select("vec_id", "v").mapInArrow(near(probes, ids), schema), "ann-queries")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q0, x0 = (np.frombuffer(b"".join(t.column("x").to_pylist()), float).reshape(-1, dim) for t in (left, right))
        qid, xid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        qi, xi, s = adaptive_scan(unit(q0) @ turn, unit(x0) @ turn, q0, x0, qid, xid, k, limit=left.column("limit").to_numpy())
        return pa.table({"query_id": qid[qi], "vec_id": xid[xi], "score": s})

    def scanned(asked: DataFrame) -> DataFrame:
        """The scan of rows (vec_id, x, limit, list)."""
        m_blocks = {r.list: -(-r.n // block) for r in held}
        q_blocks = {r.list: -(-r.n // block) for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        table = [(i, m_blocks[i], q_blocks[i]) for i in range(len(centers)) if i in m_blocks and i in q_blocks]
        table = F.broadcast(rows.sparkSession.createDataFrame(table, "list int, mb int, qb int"))
        salt = F.xxhash64("vec_id")
        right = members.join(table, "list").select("list", F.pmod(salt, F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "vec_id", "x")
        left = asked.join(table, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(salt, F.col("qb")).cast("int").alias("q"), "vec_id", "x", "limit")
        keys = ["list", "m", "q"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")

    first = materialize(scanned(queries.select("vec_id", "x", F.lit(float("inf")).alias("limit"), F.col("lists")[0].alias("list"))), "ann-first")
    order = W.partitionBy("query_id").orderBy(F.desc("score"))
    kth = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("limit"))
    more = queries.join(kth, "vec_id", "left").select("vec_id", "x", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), F.explode(F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0)))).alias("list"))
    return first.unionByName(scanned(more))
