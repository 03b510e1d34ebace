"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups of equal texts are atoms: they keep together and are ordered by a 64-bit hash
of the text. The law is ``bytes``: the smallest capacity for which the ordered atoms fit
into the shards, each shard a contiguous run, is found by binary search; a greedy sweep
checks a capacity, and the shards are cut there. An atom above the mean of what is left
takes a shard of its own, in front, so that it does not loosen the capacity of the rest.

The driver never holds the atoms. It sees totals of ranges of the hash: 2**16 ranges first,
then finer ones only where a cut can fall. Its memory is bounded by the number of shards.

Nulls: a null text counts no bytes, and null texts form one group. Empty texts form another.
Repeated rows each get a slot; texts of equal hash, copies as a rule, are one atom. Texts of any length count whole. An
empty table gives an empty result. Other columns than doc_id and text are left out.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import materialize

FIRST_BITS, STEP_BITS, KEY_BITS = 16, 8, 62
#: Rows of a shard are numbered in so many independent runs.
RUNS = 1024


def greedy_cuts(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of the runs that a greedy sweep makes; None if they are too many."""
    cuts, at, last = [], 0, len(prefix) - 1
    while at < last:
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end == at or len(cuts) == shards:
            return None
        cuts.append(end)
        at = end
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity that a greedy sweep over the ordered sizes can keep."""
    prefix = [0]
    for size in sizes:
        prefix.append(prefix[-1] + size)
    low, high = max([*sizes, -(-prefix[-1] // shards)]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def isolate_large(sizes: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Keys of the atoms, largest first, that exceed the mean of the shards then left."""
    alone = []
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        left = shards - len(alone)
        if left <= 1 or size * left <= total:
            break
        alone.append(key)
        total -= size
    return alone


class HashRanges:
    """Totals of ranges of atom keys in key order, split further where cuts can fall."""

    def __init__(self, atoms: DataFrame):
        self.atoms = atoms
        #: first key -> (bits of the range's prefix, bytes, atoms)
        self.ranges = self._totals(FIRST_BITS, None)

    def _totals(self, bits: int, inside: list[tuple[int, int]] | None) -> dict[int, tuple[int, int, int]]:
        df = self.atoms
        if inside is not None:
            spark = df.sparkSession
            width = inside[0][1]
            parents = spark.createDataFrame([(first >> width,) for first, _ in inside], "parent long")
            df = df.withColumn("parent", F.shiftright("key", width)).join(F.broadcast(parents), "parent", "left_semi")
        low = KEY_BITS - bits
        rows = df.groupBy(F.shiftright("key", low).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("key").alias("k")).collect()
        return {(r.k if r.n == 1 else r.p << low): (KEY_BITS if r.n == 1 else bits, r.b, r.n) for r in rows}

    def refine(self, keys: list[int]) -> bool:
        """Split the ranges named that hold several atoms; False if there is none."""
        by_bits: dict[int, list[int]] = {}
        for key in keys:
            bits, _, n = self.ranges[key]
            if n > 1 and bits < KEY_BITS:
                by_bits.setdefault(bits, []).append(key)
        for bits, firsts in by_bits.items():
            finer = self._totals(min(bits + STEP_BITS, KEY_BITS), [(k, KEY_BITS - bits) for k in firsts])
            for k in firsts:
                del self.ranges[k]
            self.ranges |= finer
        return bool(by_bits)


def plan_cuts(atoms: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(keys of atoms with a shard of their own, first keys of the other shards but the first)."""
    view = HashRanges(atoms)
    while True:
        large = isolate_large([(k, v[1]) for k, v in view.ranges.items()], sum(v[1] for v in view.ranges.values()), shards)
        if not view.refine(large):
            break
    rest_shards = shards - len(large)
    alone = set(large)
    while True:
        order = sorted(k for k in view.ranges if k not in alone)
        sizes = [view.ranges[k][1] for k in order]
        if not order:
            return large, []
        capacity = smallest_capacity(sizes, rest_shards)
        prefix = [0]
        for size in sizes:
            prefix.append(prefix[-1] + size)
        # The true capacity lies between the mean and this one. Its j-th cut is not before the
        # j-th cut of a sweep at the mean, nor after j times this capacity.
        least, near, early = -(-prefix[-1] // rest_shards), set(), 0
        for j in range(1, rest_shards):
            early = max(bisect_right(prefix, prefix[early] + least) - 1, early)
            near.update(range(max(early - 1, 0), min(bisect_right(prefix, j * capacity), len(order))))
        if not view.refine([order[i] for i in sorted(near)]):
            cuts = greedy_cuts(prefix, capacity, rest_shards)
            return large, [order[c] for c in cuts[:-1]]


def shard(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` as (doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key).

    Slots are gapless from 0 within each shard. See the module for the method and the cases.
    """
    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    atoms = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-atoms")
    large, firsts = plan_cuts(atoms, shards)
    number = F.lit(len(large))
    if firsts:
        number = number + F.size(F.filter(F.array(*[F.lit(k) for k in firsts]), lambda first: first <= F.col("key")))
    for i, key in enumerate(large):
        number = F.when(F.col("key") == key, i).otherwise(number)
    rows = rows.withColumn("shard", number.cast("int")).withColumn("run", F.pmod(F.xxhash64("doc_id", "key"), F.lit(RUNS)).cast("int"))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))  # shards * RUNS rows at most
    before = counts.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "key", "size"))
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(before), ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("key").alias("group_key"))
    )
