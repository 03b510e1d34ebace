import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import divergence, queries
from tests.llm.cases import no_docs, odd_docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs=10, top=10):
    """All rows from the rule, group by group and term by term."""
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in docs):
        terms = [t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {a for a, _ in groups}:
        kept = sorted((t for t, n in seen[lang].items() if n >= min_docs), key=str.encode)
        own = sorted(s for a, s in groups if a == lang)

        def values(counter):
            total = sum(counter[t] for t in kept) + 2 * len(kept)
            return [1 + 1000000000 * (counter[t] + 2) // total for t in kept]

        p = {s: values(count[lang, s]) for s in own}
        q = values(sum((count[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in own if o != s]
            terms = [(f(a, b), t) for a, b, t in zip(p[s], q, kept) if count[lang, s][t] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_query_against_brute_force_and_sql(spark, sf_dir):
    rows = rows_of(queries.op11_divergence(spark, sf_dir))
    docs = [(d.lang, d.source, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows == brute(docs) and len(rows) > 1000
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    assert rows == sorted(db.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.SQL})").fetchall())


@pytest.mark.parametrize("seats", [1, 2, 3, 6])
def test_many_slices_and_shared_seats(spark, monkeypatch, seats):
    monkeypatch.setattr(divergence, "WIDTH", 7)
    monkeypatch.setattr(divergence, "SEATS", seats)
    rng = random.Random(seats)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Été", "été", "Éa", "zß", "\U0001f600", "ω"]
    docs = [(rng.choice("ab"), f"s{rng.randrange(9)}", " ".join(rng.choices(words, weights=range(1, 33), k=rng.randint(0, 30)))) for _ in range(300)]
    docs += [("c", "only", "one"), ("d", "x", "rare"), ("d", "y", None), (None, None, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, source string, text string, no int")
    assert rows_of(divergence.audit(df, 5, 3)) == brute(docs, 5, 3)


def test_odd_documents(spark):
    docs = odd_docs(spark).withColumn("source", F.col("found"))
    docs = docs.unionByName(docs.withColumn("source", F.lit(None).cast("string")))
    want = brute([(d.lang, d.source, d.text) for d in docs.collect()], 2)
    assert rows_of(divergence.audit(docs, 2)) == want and want
    assert divergence.audit(no_docs(spark).withColumn("source", F.lit("x"))).count() == 0


def test_each_pair_of_seats_meets_once(spark):
    for seats in range(2, 12):
        df = spark.range(seats).select(F.col("id").alias("seat"), F.lit(seats + seats % 2).cast("long").alias("teams"))
        df = df.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("teams") - 2)))
        df = df.withColumn("other", divergence.opponent(F.col("seat"), F.col("turn"), F.col("teams")))
        rows = df.withColumn("host", divergence.is_host(F.col("seat"), F.col("other"), F.col("teams"))).collect()
        by_turn = {(r.turn, r.seat): r.other for r in rows}
        assert all(by_turn[t, o] == s for (t, s), o in by_turn.items() if o < seats)
        met = [(min(r.seat, r.other), max(r.seat, r.other)) for r in rows if r.other < seats and not r.host]
        assert sorted(met) == [(i, j) for i in range(seats) for j in range(i + 1, seats)]
        hosted = Counter(r.seat for r in rows if r.other < seats and r.host)
        assert max(hosted.values()) <= seats // 2 + 1


def test_values_are_exact():
    rng = random.Random(1)
    for total in (7, 10**6, 9 * 10**15):
        counts = np.array([rng.randrange(total) for _ in range(50)] + [0, total - 2])
        assert divergence.scaled(counts, total).tolist() == [1 + 1000000000 * (int(c) + 2) // total for c in counts]


def test_sparse_and_dense_distances_are_equal():
    rng = np.random.default_rng(2)
    width = 1000
    for n in (0, 1, 20, 600):
        a, b = (divergence.Vector(divergence.compress(rng.permutation(width)[:n], rng.integers(1, 99, n)), 5000, width) for _ in range(2))
        assert a.distance(b) == b.distance(a) == int(divergence.differ(a.dense(), b.dense()).sum())
    assert divergence.Vector(divergence.compress(np.zeros(0, int), np.zeros(0, int)), 0, 0).distance(divergence.Vector(divergence.compress(np.zeros(0, int), np.zeros(0, int)), 0, 0)) == 0


def test_pieces_and_early_flushes(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    monkeypatch.setattr(divergence, "HELD", 3)
    texts = ["One two, three-four ONE é\U0001f600x", "x" * 40 + " one", "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["s"] * 4), pa.array(texts)], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence.count_terms(iter([batch, batch])):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n == {"one": 6, "two": 2, "three": 2, "four": 2, "é\U0001f600x": 2, "x" * 40: 2} and docs == {t: 4 if t == "one" else 2 for t in n}
