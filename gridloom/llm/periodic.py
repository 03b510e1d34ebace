"""Periodic runs of words: harmonic grid probing.

A run is a stretch of words with smallest period q (words q apart are identical), of at least
``max(MIN_WORDS, MIN_TIMES * q)`` words, that no neighbouring word extends keeping the period. For each period p
the grid points jp are probed: the words at jp and (j+1)p, then a few places between. A run holds its first grid
point and the p words behind it, so it survives all probes there; n / p points for a period make n log n in all. What
survives is compared over a first chunk, then extended both ways by chunks of the array, each twice as long as the last; grid
points within a found run whose period divides p are skipped: the stretch around them is that run.

A word that any run holds behind its first q words is a repetition; the collapsed text is the other words
joined by one space. Null and empty texts have no words, no run and an empty collapsed text; so has a text of
white space alone. Texts are read whole, however long; repeated rows and null ids get a result each. An empty table
gives no rows. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import slices

#: Words of the shortest run, and times that its period fits into it.
MIN_WORDS, MIN_TIMES = 24, 3
#: Grid points that are probed at once; words that all of a block's survivors are compared over in steps, and of the first chunk of an extension.
POINTS, CHUNK, STEP = 1 << 18, 64, 16
#: Runs whose grid points leave a block before it is probed; those in other runs leave one by one.
LONGEST = 8

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def grid_blocks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(period, grid point, reach) of all grids of n words, in blocks; a run that holds its first grid point there holds ``reach`` equal pairs behind it."""
    period = np.arange(1, n // MIN_TIMES + 1)
    reach = np.maximum(MIN_WORDS - 2 * period, period * (MIN_TIMES - 2))
    points = (n - 1 - reach - period) // period + 1
    total = np.cumsum(points)
    low = 0
    while low < len(period):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + POINTS, side="right")))
        count = points[low:high]
        p = np.repeat(period[low:high], count)
        j = np.arange(len(p)) - np.repeat(total[low:high] - count - before, count)
        yield p, j * p, np.repeat(reach[low:high], count)
        low = high


def survivors(w: np.ndarray, found: dict[int, tuple[list[int], list[int]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(period, grid points that pass the probes), periods ascending; without points in the longest of the runs found so far."""
    for p, at, reach in grid_blocks(len(w)):
        for _, start, end, q in nlargest(LONGEST, ((e - s, s, e, q) for q, runs in found.items() for s, e in zip(*runs))):
            ok = (p % q != 0) | (at < start) | (at + p >= end)
            p, at, reach = p[ok], at[ok], reach[ok]
        for part in (0, None, 2, 1, 3, 4):
            probe = at + (p if part is None else reach * part // 4)
            ok = w[probe] == w[probe + p]
            p, at, reach = p[ok], at[ok], reach[ok]
        for offset in range(0, CHUNK, STEP):
            probe = at[:, None] + np.minimum(offset + np.arange(STEP), reach[:, None])
            ok = (w[probe] == w[probe + p[:, None]]).all(axis=1)
            p, at, reach = p[ok], at[ok], reach[ok]
        first = np.flatnonzero(np.diff(p, prepend=0))
        for low, high in zip(first, [*first[1:], len(p)]):
            yield int(p[low]), at[low:high]


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays of one length."""
    done, step = 0, CHUNK
    while done < len(a):
        differs = a[done : done + step] != b[done : done + step]
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done, step = done + len(differs), 2 * step
    return done


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    found: dict[int, tuple[list[int], list[int]]] = {}  # period: starts, ends
    if len(w) >= MIN_WORDS:
        for p, points in survivors(w, found):
            dividing = [runs for q, runs in found.items() if p % q == 0]
            k = 0
            while k < len(points):
                i, end = int(points[k]), -1
                for starts, ends in dividing:
                    last = bisect_right(starts, i) - 1
                    if last >= 0 and i + p < ends[last]:
                        end = ends[last]
                        break
                else:
                    start = i - equal_ahead(w[:i][::-1], w[p : i + p][::-1])
                    end = i + p + equal_ahead(w[i : len(w) - p], w[i + p :])
                    if end - start >= max(MIN_WORDS, MIN_TIMES * p):
                        starts, ends = found.setdefault(p, ([], []))
                        starts.append(start)
                        ends.append(end)
                k = max(k + 1, int(np.searchsorted(points, end - p)))
    return sorted((s, e - s, p) for p, runs in found.items() for s, e in zip(*runs))


def repetitions(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n words, whether a run holds each behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def describe(text: bytes) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs and collapsed text. ``bytes.split`` parts at the six ASCII characters of white space alone."""
    words = text.split()
    runs: list[tuple[int, int, int]] = []
    if len(words) >= MIN_WORDS:
        number = {word: i for i, word in enumerate(dict.fromkeys(words))}
        runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    kept = words if not runs else [words[i] for i in np.flatnonzero(~repetitions(len(words), runs))]
    return len(words), runs, b" ".join(kept).decode()


def describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "length", "period")
    for batch in slices(batches):
        texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        n, runs, collapsed = zip(*(describe(t.as_buffer().to_pybytes()) for t in texts))
        flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), structs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start, then period, and its text without their repetitions."""
    return docs.select("doc_id", "text").mapInArrow(describe_batches, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first of equal ones; null without a run."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def digests(described: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, runs_sha256, collapsed_sha256."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = described.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def plant(docs: DataFrame) -> DataFrame:
    """The documents with a run put into every tenth by the checksum h of its id: word i >= a becomes word a + (i - a) % p, with g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


#: Rows of ``digests(collapse_runs(plant(documents)))`` in DuckDB SQL: probes at two grid points and between choose the periods, islands of equal words give the stretches.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END) + 1]) END AS w FROM e),
per AS (SELECT r, n, w, unnest(range(1, n // 3 + 1)) AS p FROM t WHERE n >= 24),
pt AS (SELECT r, n, w, p, greatest(24 - 2 * p, p) AS reach, unnest(range(0, n - p - greatest(24 - 2 * p, p), p)) AS i FROM per),
cand AS (SELECT DISTINCT r, p FROM pt WHERE w[i + 1] = w[i + p + 1] AND w[i + p + 1] = w[i + 2 * p + 1] AND w[i + reach // 2 + 1] = w[i + reach // 2 + p + 1]
         AND w[i + reach // 4 + 1] = w[i + reach // 4 + p + 1] AND w[i + reach + 1] = w[i + reach + p + 1]),
pos AS (SELECT r, p, w, unnest(range(n - p)) AS i FROM cand JOIN t USING (r)),
eq AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pos WHERE w[i + 1] = w[i + p + 1]),
st AS (SELECT r, p, min(i) AS s, count(*) + p AS l FROM eq GROUP BY r, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
run AS (SELECT r, s, l, min(p) AS p FROM st GROUP BY r, s, l),
best AS (SELECT r, s, l, p FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE a.r = b.r AND (b.l * a.p > a.l * b.p OR b.l * a.p = a.l * b.p AND (b.s, b.p) < (a.s, a.p)))),
txt AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS x FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM run),
left_ AS (SELECT u.r, string_agg(u.x, ' ' ORDER BY u.i) AS x FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM t) u ANTI JOIN gone ON gone.r = u.r AND gone.i = u.i GROUP BY u.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, p::BIGINT AS period, (1000 * l // p)::BIGINT AS exponent_milli,
       sha256(coalesce(txt.x, '')) AS runs_sha256, sha256(coalesce(left_.x, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN txt USING (r) LEFT JOIN left_ USING (r)
"""
