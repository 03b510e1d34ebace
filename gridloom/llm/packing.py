"""Packing token sequences by minimum bin slack.

A document's ids, with an end id, are cut into full pieces and a rest shorter than a sequence.
The rests are a multiset of lengths below the capacity, held as at most ``capacity`` counts
whatever the corpus. The largest length left opens a sequence; a bitset subset-sum dynamic
program over the lengths left finds the multiset that fills its window closest to capacity;
backtracking through the stages gives the count of each length; and the pattern is repeated
while its counts last. Pieces get their places from their rank among pieces of equal length.

Null texts count as empty: one piece that holds only the end id. Repeated rows are packed
each for itself; ties between equal pieces are broken by doc_id and start, and then don't matter. Texts of any
length are cut whole. An empty table gives an empty result. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.bpe import default_path, encoder
from gridloom.llm.common import materialize, slices, text_array

#: Independent runs that number the pieces of one length; full pieces are the most frequent.
RUNS, FULL_RUNS = 64, 4096

Pattern = list[tuple[int, int]]


def fill_window(window: int, counts: dict[int, int]) -> Pattern:
    """(length, copies) whose sum comes closest to the window without passing it."""
    mask = (1 << (window + 1)) - 1
    stages: list[tuple[int, int, int]] = []  # length, copies at most, sums reachable before
    sums = 1
    for length in sorted(counts, reverse=True):
        copies = min(counts[length], window // length)
        if copies <= 0:
            continue
        stages.append((length, copies, sums))
        step, left = 1, copies
        while left:  # copies split into powers of two
            take = min(step, left)
            sums |= (sums << (take * length)) & mask
            left, step = left - take, step * 2
        if sums >> window & 1:
            break
    target, chosen = sums.bit_length() - 1, []
    for length, copies, before in reversed(stages):
        used = next(k for k in range(copies + 1) if target >= k * length and before >> (target - k * length) & 1)
        if used:
            chosen.append((length, used))
            target -= used * length
    return chosen


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of (length, copies), each with how many sequences follow it, until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        opener = max(left)
        rest = dict(left)
        rest[opener] -= 1
        pattern = dict(fill_window(capacity - opener, {k: v for k, v in rest.items() if v}))
        pattern[opener] = pattern.get(opener, 0) + 1
        times = min(left[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        out.append((sorted(pattern.items(), reverse=True), times))
    return out


def places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset) sorted by the first two."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(capacity: int, end_id: int, path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_path())
        for batch in slices(batches):
            lengths, crcs, starts, rows, totals = [], [], [], [], []
            for row, text in enumerate(text_array(batch).to_pylist()):
                ids = bpe.encode_ids(text)
                n, raw = len(ids) + 1, ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                for start in range(0, n, capacity):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(min(capacity, n - start))
                    crcs.append(zlib.crc32(raw[4 * start : 4 * (start + capacity)]))
                    totals.append(n)
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return apply


def place(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = (table[:, 0] << 48) + table[:, 1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            which = rank - row[:, 1]
            sequence, offset = row[:, 2] + which // row[:, 3], row[:, 4] + which % row[:, 3] * length
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return apply


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    pieces = docs.select("doc_id", "text").mapInArrow(cut(capacity, end_id, path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    runs = F.when(F.col("length") == capacity, FULL_RUNS).otherwise(RUNS)
    pieces = materialize(pieces.withColumn("run", F.pmod(F.xxhash64("doc_id", "start"), runs)), "pack-pieces")
    cells = pieces.groupBy("length", "run").agg(F.count("*").alias("n"))  # capacity * RUNS + FULL_RUNS rows at most
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = cells.select("length", "run", (F.sum("n").over(W.partitionBy("length").orderBy("run")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "run").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(before, ["length", "run"]).withColumn("rank", (F.col("before") + F.col("within") - 1).cast("long"))
    table = places(plan_patterns(counts, capacity)) if counts else np.zeros((1, 5), np.int64)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place(table), schema)
