import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import maxscore, queries

SCHEMA = "vec_id long, embedding array<double>, score string, shard string"


def brute(rows, k, divisor=100, scale=1024):
    """Every pair, with Python's integers."""
    whole = lambda x: int(x) * scale if abs(x) > 2**53 else math.floor(x * scale)
    known = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    scores = defaultdict(dict)
    for qi, q in known:
        if qi % divisor == 0:
            for i, v in known:
                if i != qi and len(v) == len(q):
                    s = maxscore.as_long(sum(a * b for a, b in zip(q, v)))
                    scores[qi][i] = max(s, scores[qi].get(i, s))
    return sorted((qi, r, i, s) for qi, found in scores.items() for r, (s, i) in enumerate(sorted(((s, i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k], 1))


def run(spark, rows, k, divisor=100):
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, maxscore.search(df, F.col("vec_id") % divisor == 0, k).collect()))


def test_query_against_brute_force_and_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = sorted(map(tuple, queries.op13_topk(spark, sf_dir).collect()))
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows == brute(vectors, 10) and len(rows) == 50
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    assert rows == sorted(db.sql(maxscore.SQL).fetchall())


@pytest.mark.parametrize("density", [1.0, 0.3, 0.02])
def test_shards_of_dense_and_sparse_vectors(monkeypatch, density):
    monkeypatch.setattr(maxscore, "WINDOW", 50)
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 40, (400, 30)) * (rng.random((400, 30)) < density))
    ids = np.sort(rng.integers(0, 300, 400))
    shard = maxscore.Shard(ids, x)
    for j in range(60):
        best = {}
        for i, s in zip(ids, x @ x[j]):
            if i != ids[j]:
                best[i] = max(s, best.get(i, s))
        want = sorted(((s, i) for i, s in best.items()), key=lambda r: (-r[0], r[1]))[:5]
        for limit in (None, int(want[-1][0]), int(want[-1][0]) - 100):
            found, scores = shard.top(ids[j], x[j], 5, limit)
            assert [*zip(scores, found)] == want


def test_non_essential_terms_make_no_candidates():
    columns = np.zeros((3, 100))
    columns[0, 7], columns[1], columns[2] = 50, 1, -1
    postings = [np.flatnonzero(c) if c.any() and np.count_nonzero(c) < 25 else None for c in columns]
    at, score = maxscore.candidates(np.array([10.0, 2.0, 3.0]), columns, columns.max(axis=1), columns.min(axis=1), postings, 100)
    assert (at.tolist(), score.tolist()) == ([7], [499.0])


def test_ties_repeats_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "WINDOW", 8)
    monkeypatch.setattr(maxscore, "SAMPLE_ROWS", 6)
    nan, inf = float("nan"), float("inf")
    same = [(i, [0.25, -0.5, 1.0]) for i in range(60)]
    odd = [(100, None), (None, [1.0, 1.0, 1.0]), (200, [nan, 0.0, 0.0]), (300, [inf, 0.0, 0.0]), (400, [None, 1.0, 1.0]), (500, [0.0, 0.0, 0.0]), (600, []), (601, []), (700, [1.0, 2.0]), (800, [-0.0001, 0.0, 3.0])]
    repeated = [(900, [0.5, 0.5, 0.5]), (900, [0.5, 0.5, 0.5]), (900, [-1.0, -1.0, -1.0]), (61, [2.0, 2.0, 2.0]), (61, [-2.0, -2.0, -2.0])]
    rows = same + odd + repeated
    assert run(spark, rows, 4) == brute(rows, 4)
    assert run(spark, rows, 100, 50) == brute(rows, 100, 50)


def test_scores_beyond_doubles_and_longs(spark):
    big = [(0, [1e9, 3.0, 1.0]), (1, [1e9, 3.0, 2.0]), (2, [1e9, 3.0, 2.001]), (3, [-1e308, 1.0, 1.0]), (4, [1.7e308, 0.0, 0.0]), (5, [2.0**53, -1.0, 0.5]), (6, [0.1, 0.2, 0.3]), (100, [1e-9, 1e300, 7.0])]
    assert run(spark, big, 5) == brute(big, 5)


def test_empty_and_lone(spark):
    assert run(spark, [], 3) == [] == run(spark, [(0, [1.0])], 3)
    assert run(spark, [(0, [1.0]), (7, [2.0])], 3) == [(0, 1, 7, 1024 * 2048)]
