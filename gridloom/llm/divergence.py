"""Divergence of sources within a language: term distributions of all pairs of groups by systolic rotation.

Terms are runs of letters (A-Z, a-z, lower-cased) and of characters beyond ASCII. A language keeps the V terms that are in at
least ``min_docs`` of its documents. A group (lang, source), and the language as a whole, gives each kept term, with count
occurrences there, p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V)), N being its occurrences of kept terms. Two
distributions differ by f = floor((p - q)**2 / (p + q)) for a term. Part ``pair`` has the sum of f over all kept
terms for every two sources of a language, part ``term`` the terms of a group that most exceed the language's.
All arithmetic is in integers.

The kept terms of a language, in the order of their UTF-8 bytes, are cut into slices of ``WIDTH``. Within a slice the groups have seats
that stay where they are: one partition holds a seat's vectors. Compressed vectors of other seats come by in the rounds of a
round-robin tournament (circle method), in each of which a seat meets one other, at the place of one of them; a meeting gives the
value for both directions. Each vector so travels to half of the seats, a task holds the vectors of one seat and one visitor,
and all groups' values of a slice are made without gathering them. Local heaps keep each seat's highest terms; slices are summed and heaps merged.

Null text, lang and source count as ''. Groups without terms take part with counts of 0; without any kept term pairs have the value
0 and there are no terms. Ties rank by the item's UTF-8 bytes. Repeated rows count as often as they stand there, ids aren't read. Texts are read whole, in
pieces. An empty table gives no rows. Other columns than text, lang and source aren't read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.numbering import number_rows
from gridloom.llm.common import materialize, slices

#: Terms of a slice, bytes of a text that are parted at once, counts that a task holds before it gives them out.
WIDTH, PIECE, HELD = 8192, 4 << 20, 400_000
#: Seats of a language if it has so many sources, groups of a seat beyond them.
SEATS, SEAT_GROUPS = 32, 16
UNIT, SMOOTHING = 1_000_000_000, 2

#: Letters in lower case and bytes beyond ASCII as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists."""
    data, at = text.translate(_LETTERS), 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents, summed as far as a task holds them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), pa.array([t.decode() for t in n], pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in slices(batches):
        texts = pc.fill_null(batch.column(2).cast(pa.large_binary()), b"")
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in pieces(text.as_buffer().to_pybytes()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / total), a thousand at a time so that nothing overflows below 9e15 occurrences."""
    left, out = count + SMOOTHING, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left %= total
    return out + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compress(places: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(places)
    return zlib.compress(np.diff(places[order], prepend=0).astype(np.int32).tobytes() + counts[order].astype(np.int64).tobytes(), 1)


class Vector:
    """A slice of a distribution: its values at the places where terms occur, and the value of all other places."""

    def __init__(self, packed: bytes, total: int, width: int):
        raw = zlib.decompress(packed)
        n = len(raw) // 12
        self.places = np.cumsum(np.frombuffer(raw, np.int32, n)).astype(np.int64)
        counts = np.frombuffer(raw, np.int64, n, 4 * n)
        self.width = width
        self.p = scaled(counts, total) if width else counts
        self.base = int(scaled(np.zeros(1, np.int64), total)[0]) if width else 0

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at places (ascending) that hold all of the vector's own."""
        out = np.full(len(places), self.base, np.int64)
        out[np.searchsorted(places, self.places)] = self.p
        return out

    def dense(self) -> np.ndarray:
        out = np.full(self.width, self.base, np.int64)
        out[self.places] = self.p
        return out

    def distance(self, other: Vector) -> int:
        """Sum of the differences over all places of the slice."""
        if 8 * (len(self.places) + len(other.places)) > self.width:
            return int(differ(self.dense(), other.dense()).sum())
        places = np.union1d(self.places, other.places)
        rest = int(differ(np.array([self.base]), np.array([other.base]))[0]) if self.width else 0
        return int(differ(self.at(places), other.at(places)).sum()) + rest * (self.width - len(places))

    def highest(self, whole: np.ndarray, top: int) -> list[tuple[int, int]]:
        """(place, difference) of the terms here that most exceed the whole's values, by a heap."""
        q = whole[self.places]
        f = differ(self.p, q)
        more = np.flatnonzero(self.p > q)
        if len(more) > top:
            more = more[f[more] >= np.partition(f[more], -top)[-top]]
        return [(place, -f) for f, place in heapq.nsmallest(top, zip((-f[more]).tolist(), self.places[more].tolist()))]


#: Rows of a tournament, in the order of ``KEYS`` and ``ORDER``. kind 0: the language as a whole; 1: who sits there; 2: who comes by.
KEYS, ORDER = ["lang", "slice", "seat"], ["lang", "slice", "seat", "kind", "round", "source"]
FIELDS = [*ORDER, "total", "width", "first", "packed"]


def meetings(top: int):
    """(lang, source, other, no, value): the difference of two groups over a slice, or of a group's term ``no`` from its language."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, first, seated = None, None, 0, []
        for batch in batches:
            out: list[tuple] = []
            for lang, part, seat, kind, _, source, total, width, start, packed in zip(*(batch.column(i).to_pylist() for i in range(len(FIELDS)))):
                if key != (lang, part, seat):
                    key, seated = (lang, part, seat), []
                vector = Vector(packed, total, width)
                if kind == 0:
                    whole, first = vector.dense(), start
                    continue
                for other, known in seated:
                    value = vector.distance(known)
                    out += [(lang, source, other, None, value), (lang, other, source, None, value)]
                if kind == 1:
                    seated.append((source, vector))
                    out += [(lang, source, None, first + place, value) for place, value in vector.highest(whole, top)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "source", "other", "no", "value"])

    return apply


def opponent(seat: Column, turn: Column, teams: Column) -> Column:
    """Whom a seat of an even number of teams meets in a round: the last one stays in place, the others' numbers add up to twice the round, modulo teams - 1."""
    m = teams - 1
    other = F.pmod(2 * turn - seat, m)
    return F.when(seat == m, turn).when(other == seat, m).otherwise(other)


def is_host(seat: Column, other: Column, teams: Column) -> Column:
    """Whether the seat is the place of its meeting with the other: each seat is in about half of its meetings."""
    m = teams - 1
    return F.when(seat == m, other % 2 == 1).when(other == m, seat % 2 == 0).otherwise(F.pmod(other - seat, m) <= F.floor(m / 2))


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for block in batch.column(3):
            known = block.values if block.is_valid else pa.array([], pa.struct([("place", pa.int32()), ("n", pa.int64())]))
            packed.append(compress(*(known.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n"))))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(packed, pa.binary())], ["lang", "source", "slice", "packed"])


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for all groups of the documents: part ``pair`` whole, part ``term`` to rank ``top``."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    summed = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(summed, "divergence-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    vocabulary = materialize(number_rows(terms.select("lang", "term", "n"), ["lang", "term"], "no", 0), "divergence-terms")
    groups = materialize(number_rows(docs.select("lang", "source").distinct(), ["lang", "source"], "no", 0), "divergence-groups")

    kept = vocabulary.groupBy("lang").agg(F.min("no").alias("first"), F.count("*").alias("v"), F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.min("no").alias("first_group"), F.count("*").alias("groups")).join(kept, "lang", "left").na.fill(0, ["first", "v", "n"])
    seats = F.least("groups", F.greatest(F.lit(SEATS), F.ceil(F.col("groups") / SEAT_GROUPS)))
    langs = materialize(langs.withColumn("seats", seats.cast("long")), "divergence-langs")
    last = F.greatest(F.lit(0), F.expr(f"CAST((v - 1) div {WIDTH} AS INT)"))

    place = F.col("no") - F.col("first")
    entries = counts.select("lang", "source", "term", "n").join(vocabulary.select("lang", "term", "no"), ["lang", "term"]).join(langs.select("lang", "first"), "lang")
    entries = entries.select("lang", "source", F.expr(f"CAST((no - first) div {WIDTH} AS INT)").alias("slice"), (place % WIDTH).cast("int").alias("place"), "n")
    blocks = materialize(entries.groupBy("lang", "source", "slice").agg(F.collect_list(F.struct("place", "n")).alias("block"), F.sum("n").alias("n")), "divergence-blocks")
    sums = blocks.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    seated = groups.join(langs.select("lang", "first_group", "v", "first", "seats"), "lang").join(sums, ["lang", "source"], "left")
    seated = seated.withColumn("seat", (F.col("no") - F.col("first_group")) % F.col("seats")).withColumn("total", F.coalesce("n", F.lit(0)) + SMOOTHING * F.col("v"))
    every = seated.select("lang", "source", "seat", "seats", "total", "v", "first", F.explode(F.sequence(F.lit(0), last)).alias("slice"))
    packed = every.select("lang", "source", "slice").join(blocks.drop("n"), ["lang", "source", "slice"], "left").select("lang", "source", "slice", "block").mapInArrow(pack_blocks, "lang string, source string, slice int, packed binary")
    width = F.least(F.lit(WIDTH), F.col("v") - F.col("slice") * WIDTH).alias("width")
    first = (F.col("first") + F.col("slice") * WIDTH).alias("first")
    here = materialize(every.join(packed, ["lang", "source", "slice"]).select("lang", "slice", "seat", "source", "total", width, first, "packed", "seats"), "divergence-seats")

    total = langs.select("lang", (F.col("n") + SMOOTHING * F.col("v")).alias("total"), "v", "first", "seats", F.explode(F.sequence(F.lit(0), last)).alias("slice"))
    whole = vocabulary.join(langs.select("lang", "first"), "lang").groupBy("lang", F.lit("").alias("source"), F.expr(f"CAST((no - first) div {WIDTH} AS INT)").alias("slice"))
    whole = whole.agg(F.collect_list(F.struct((place % WIDTH).cast("int").alias("place"), "n")).alias("block"))
    whole = total.select("lang", "slice").join(whole, ["lang", "slice"], "left").select("lang", F.lit("").alias("source"), "slice", "block").mapInArrow(pack_blocks, "lang string, source string, slice int, packed binary")
    whole = total.join(whole, ["lang", "slice"]).withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))

    teams, turn = F.col("seats") + F.col("seats") % 2, F.col("round")
    guests = here.where("seats > 1").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), teams - 2))).withColumn("host", opponent(F.col("seat"), turn, teams))
    guests = guests.where((F.col("host") < F.col("seats")) & ~is_host(F.col("seat"), F.col("host"), teams)).withColumn("seat", F.col("host"))
    no_round = F.lit(0).cast("long").alias("round")
    rows = [
        whole.select("lang", "slice", "seat", F.lit(0).alias("kind"), no_round, "source", "total", width, first, "packed"),
        here.select("lang", "slice", "seat", F.lit(1).alias("kind"), no_round, "source", "total", "width", "first", "packed"),
        guests.select("lang", "slice", "seat", F.lit(2).alias("kind"), "round", "source", "total", "width", "first", "packed"),
    ]
    dealt = rows[0].unionByName(rows[1]).unionByName(rows[2]).repartition(*KEYS).sortWithinPartitions(*ORDER).select(*FIELDS)
    met = materialize(dealt.mapInArrow(meetings(top), "lang string, source string, other string, no long, value long"), "divergence-met")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.where("no IS NULL").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    by_number = W.partitionBy("lang", "source").orderBy(F.desc("value"), "no")
    best = met.where("no IS NOT NULL").withColumn("rank", F.row_number().over(by_number)).where(F.col("rank") <= top)
    best = best.join(vocabulary.select("no", F.col("term").alias("item")), "no").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)


#: The same rows in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v))::BIGINT AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // ((sum(sum(n)) OVER (PARTITION BY lang)) + 2 * any_value(v.v)))::BIGINT AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT i.lang, i.source, j.source AS item, sum((i.p - j.p) * (i.p - j.p) // (i.p + j.p)) AS value FROM p i JOIN p j ON i.lang = j.lang AND i.term = j.term AND i.source <> j.source GROUP BY ALL) x
         ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER w AS rank FROM pair WINDOW w AS (PARTITION BY lang, source ORDER BY value DESC, item)
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER w FROM term WINDOW w AS (PARTITION BY lang, source ORDER BY value DESC, item))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
