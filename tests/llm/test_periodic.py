import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import periodic, queries
from tests.llm.cases import ROWS, no_docs, odd_docs


def brute_runs(w):
    """Every stretch of equal pairs for every period, word by word."""
    smallest = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                smallest.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in smallest.items())


def brute_row(doc_id, text):
    """The contract's row of one document, from the rule."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        w = []
        while len(w) < rng.randint(10, 160):
            w += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 2, 3, 5, 9])
            w *= rng.choice([1, 1, 2])
        assert periodic.find_runs(np.array(w)) == brute_runs(w)


def test_small_blocks_find_the_same_runs(monkeypatch):
    monkeypatch.setattr(periodic, "POINTS", 7)
    monkeypatch.setattr(periodic, "LONGEST", 0)
    rng = random.Random(6)
    for _ in range(100):
        w = ([rng.randrange(2) for _ in range(5)] * rng.randint(1, 9) + [3] * rng.randint(0, 30)) * 3
        assert periodic.find_runs(np.array(w)) == brute_runs(w)


def test_lengths_at_the_limits():
    unlike = list(range(100, 140))
    for period, length, counts in ((1, 23, False), (1, 24, True), (8, 23, False), (8, 24, True), (9, 26, False), (9, 27, True)):
        w = unlike + [i % period for i in range(length)] + [99]
        assert periodic.find_runs(np.array(w)) == ([(40, length, period)] if counts else []) == brute_runs(w)


def test_long_texts():
    w = np.concatenate([np.zeros(300_000, np.int64), np.arange(1, 1000), np.tile(np.arange(5000, 5070), 100)])
    assert periodic.find_runs(w) == [(0, 300_000, 1), (300_999, 7000, 70)]


def test_query_against_brute_force_and_sql(spark, sf_dir):
    rows = sorted(map(tuple, queries.op12_periodic(spark, sf_dir).collect()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows == sorted(brute_row(d.doc_id, d.text) for d in docs)
    assert sum(r[1] > 0 for r in rows) > 10
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    assert rows == sorted(db.sql(periodic.SQL).fetchall())


def test_odd_documents(spark):
    extra = [(20, "a b " * 40 + "c"), (21, "x y " * 30), (22, "  \x1f " * 30), (23, "go " * 200_000), (24, "é \U0001f600 " * 30)]
    docs = odd_docs(spark).select("doc_id", "text", "n", F.col("run").alias("runs"), F.col("start").alias("collapsed"))
    docs = docs.unionByName(spark.createDataFrame([(i, t, "", "", "") for i, t in extra], docs.schema))
    found = sorted(map(tuple, periodic.digests(periodic.collapse_runs(docs)).collect()), key=str)
    plain = lambda i, t: (i, *brute_row(None, t)[1:])
    want = [plain(i, t) for i, t in ROWS + extra if i != 23]
    assert [r for r in found if r[0] != 23] == sorted(want, key=str)
    assert [r[1:6] for r in found if r[0] == 23] == [(1, 0, 200_000, 1, 200_000_000)]
    planted = {r.doc_id: r.text for r in periodic.plant(docs).collect()}
    assert planted[1] is None and planted[None] == dict(ROWS)[None]
    assert periodic.digests(periodic.collapse_runs(periodic.plant(no_docs(spark)))).count() == 0


def test_ties_of_the_strongest_run(spark):
    text = " ".join(["a b"] * 12 + ["."] + ["c d"] * 12 + [","] + ["e f g"] * 12)
    row = periodic.digests(periodic.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 0, 24, 2, 12_000)


def test_collapsed_text(spark):
    row = periodic.collapse_runs(spark.createDataFrame([(1, "start " + "one two three " * 9 + "end")], "doc_id long, text string")).first()
    assert row.collapsed == "start one two three end" and row.n_words == 29 and [tuple(r) for r in row.runs] == [(1, 27, 3)]
