"""Exact n-gram Jaccard join with set-relation skipping.

A text's set is its distinct word shingles. All shingles follow one order, rare ones first by a
fixed-size count of the whole corpus; two sets that link share shingles in their prefixes under
it. Equal sets are joined as one. Shingles of prefixes are dealt out once, to find those that two sets
share; sets that share too few for any link are done.

Answers of similar sets: for a few random orders of shingles, sets with the same least shingle meet the one
of them that shares most of its prefix, the hub. Hubs' pairs are compared on whole texts; sets that link
take over each other's component. Then an inverted index over the shared shingles, its lists sorted by
size, is read in blocks: a block is skipped by its sizes, by the unshared shingles of its sets, and an entry by
its position (how many shared shingles come before it, and how many shingles after). Pairs within a component need no
comparison. For pairs of other components whose counts leave a link possible, the answer is derived
from the overlap of their hubs and the known differences between a set and its hub; where that doesn't
decide, the whole texts are compared. No pair that could join two components is lost.

Candidates come from 64-bit hashes and 32-bit parts of them, where equal hashes of different shingles only
add candidates. Links are decided on words: the hashes of a comparison are checked against
the bytes. Sets are told apart by 128 bits.

Null and empty texts, and texts without words, have empty sets and link with nothing. Fewer words
than a shingle make one shingle. Repeated rows have equal sets. A null doc_id takes no part in the
smallest id of its component; a component of such rows alone has none. Very long texts are read whole, in
slices of their own. An empty table gives no rows. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, slices, small_batches, text_array, utf8_parts
from gridloom.llm.ngrams import SPACES, mix64, span_hashes, spans
from gridloom.operators.graph import connected_components

WORDS, PERCENT = 5, 80
#: Longer prefixes by this part of a set, so that sharing a passage alone doesn't make a candidate.
EXTRA = 5
#: Slots of the count of shingles (its size doesn't grow with the corpus) and parts it is summed in.
SLOT_BITS, PARTS = 20, 64
#: Entries that a bucket of lists holds about, ids that are broadcast at most, entries of a block.
BUCKET_ENTRIES, BROADCAST_IDS, BLOCK = 500_000, 1_000_000, 256
#: Entries of a list that one task reads; longer lists are dealt as pairs of chunks of this size.
LIST = 20_000
#: Distinct pairs that a task holds before it writes what it has counted of them.
HELD_PAIRS = 2_000_000
#: Random orders of shingles in each of two rounds.
SEEDS, ROUNDS = 3, 2
#: Sets are numbered in blocks of so many bits.
SET_BITS = 12

#: Lower case of A-Z alone.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if len(sorted_) else np.zeros(1, np.int64)


def _split(raw: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary parts of an array, from cut to cut."""
    data, cut = raw.tobytes(), np.asarray(cut) * raw.dtype.itemsize
    return pa.array([data[a:b] for a, b in zip(cut, cut[1:])], pa.binary())


def shingle_words(strings: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(row, first word, number of words, hash) of each shingle in order, and (bytes, start, end, hash) of the words."""
    data, offsets = utf8_parts(strings)
    start, end, row = spans(data, offsets, SPACES)
    data = _LOWER[data]
    h = span_hashes(data, start, end)
    count = np.bincount(row, minlength=len(strings))
    first, length = np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        size = len(h) - words + 1
        hashes = np.zeros(0, np.uint64)
        if size > 0:
            total = np.zeros(size, np.uint64)
            for k in range(words):
                total += h[k : k + size] * _STEPS[k]
            first = np.flatnonzero(row[:size] == row[words - 1 :])
            hashes, length = mix64(total[first]), np.full(len(first), words)
        few = np.flatnonzero((count > 0) & (count < words))
        if len(few):
            begin = np.searchsorted(row, few)
            short = [mix64(np.array([(h[f : f + count[r]] * _STEPS[: count[r]]).sum() + np.uint64(count[r])], np.uint64))[0] for r, f in zip(few, begin)]
            first, hashes, length = np.append(first, begin), np.append(hashes, np.array(short, np.uint64)), np.append(length, count[few])
    return row[first], first, length, hashes, (data, start, end, h)


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def shingle_sets(strings: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by both."""
    rows, _, _, hashes, _ = shingle_words(strings, words)
    return distinct(rows, hashes)


def faithful(first: np.ndarray, length: np.ndarray, hashes: np.ndarray, words: tuple) -> bool:
    """Whether equal hashes stand for equal words, and for equal shingles, throughout."""
    data, start, end, h = words
    if not len(h):
        return True
    _, leader, code = np.unique(h, return_index=True, return_inverse=True)
    size, like = end - start, leader[code]
    if not np.array_equal(size, size[like]):
        return False
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    if not np.array_equal(data[within + np.repeat(start, size)], data[within + np.repeat(start[like], size)]):
        return False
    _, leader, place = np.unique(hashes, return_index=True, return_inverse=True)
    if not np.array_equal(length, length[leader[place]]):
        return False
    code = np.append(code, np.full(WORDS, -1))
    return all(np.array_equal(np.where(k < length, code[first + k], -1), np.where(k < length, code[first[leader[place]] + k], -1)) for k in range(WORDS))


def exact_sets(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() by words: codes that are equal only for equal shingles within this call."""
    rows, first, length, hashes, words = shingle_words(strings)
    if not faithful(first, length, hashes, words):  # two words or shingles with one hash: number them one by one
        data, start, end, _ = words
        raw, codes = data.tobytes(), {}
        hashes = np.array([codes.setdefault(tuple(raw[start[w] : end[w]] for w in range(f, f + k)), len(codes)) for f, k in zip(first, length)], np.uint64)
    return distinct(rows, hashes)


def set_ids(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, id, second id) of each row's set; 0, 0, 0 for an empty one."""
    size = np.bincount(rows, minlength=n)
    out = np.zeros((2, n), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x5851F42D4C957F2D, 0x9FB21C651E98DF25)):
                sums = np.add.reduceat(mix64(hashes ^ np.uint64(salt)), np.searchsorted(rows, some))
                out[k, some] = mix64(sums + size[some].astype(np.uint64))
    return size, out[0].view(np.int64), out[1].view(np.int64)


def least_shared(n):
    """How many indexed shingles two linked sets share at least, if the larger one has n.

    They have 0.8 n in common; at most n less 0.8 n of a prefix are not among them.
    """
    return 1 + EXTRA * n // 100


def prefix_length(n):
    """Shingles of a set that are indexed: enough for two linked sets to share least_shared() of them."""
    return np.where(n > 0, n - (PERCENT * n + 99) // 100 + least_shared(n), 0)


def needed(a, b):
    """The least overlap of two linked sets: the smallest i with 100 i >= 80 (a + b - i)."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def after(n: str) -> str:
    """Shingles of a set beyond its prefix.

    Common shingles up to the earlier end of two prefixes are in both of them; beyond it, the set
    whose prefix ends there has only these. So two sets have at most as many in common as their
    prefixes do, and the larger of these two numbers.
    """
    return f"(({PERCENT} * {n} + 99) DIV 100 - 1 - ({EXTRA} * {n}) DIV 100)"


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in slices(batches):
        _, hashes = shingle_sets(text_array(batch))
        counts += np.bincount((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
    parts = counts.reshape(PARTS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """Class of each slot by its count over all documents: 0 for usual ones, more for frequent shingles."""
    schema = "part int, counts binary"
    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count_slots, schema).repartition(PARTS, "part").mapInArrow(sum_slots, schema).collect()  # PARTS rows
    counts = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), np.int64)
    for r in rows:
        counts[r.part] += np.frombuffer(r.counts, np.int64)
    chance = 4 * np.sqrt(counts.mean()) + 4  # a slot of rare shingles alone stays within this of the mean
    excess = (counts.ravel() - counts.mean()) / chance
    return np.where(excess > 1, 1 + np.floor(2 * np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)


def prefixes(classes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, hashes = shingle_sets(text_array(batch))
            size, *ids = set_ids(rows, hashes, batch.num_rows)
            kind = classes[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            order = np.lexsort((hashes, kind, rows))
            place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < np.repeat(prefix_length(size), size)
            binary = _split(hashes[order][keep], np.concatenate([[0], np.cumsum(prefix_length(size))]))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 2, 3)] + [pa.array(size, pa.int64()), *map(pa.array, ids), binary], ["doc_id", "d1", "d2", "n", "sid", "sid2", "prefix"])

    return apply


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 8192, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Larger batches, of so many rows or bytes about."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


#: Stands in a list for entries of other tasks that are known to be shared.
WITNESS = np.uint16(0xFFFF)
ENTRIES = "bucket int, block long, own binary, pos binary, hash binary"


def dealt(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deal the shingles of (set, prefix) into buckets; a row holds a block's part of one bucket.

    Shingles that a batch has in two sets are known to be shared. They go to any task, with one witness
    for each of them in the bucket, so that a shingle of very many sets fills no bucket.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            sets, prefix = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            length = np.array([len(p) // 8 for p in prefix], np.int64)
            hashes, owner = mix64(np.frombuffer(b"".join(prefix), "<u8")), np.repeat(np.arange(len(prefix)), length)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            order = np.argsort(hashes, kind="stable")
            edge = _runs(hashes[order])
            known = np.zeros(len(hashes), bool)
            known[order] = np.repeat(np.diff(edge) > 1, np.diff(edge))
            witness = order[edge[:-1][np.diff(edge) > 1]]
            e = {"hash": np.append(hashes, hashes[witness]), "own": np.append((sets & ((1 << SET_BITS) - 1))[owner], np.full(len(witness), WITNESS)).astype("<u2"), "pos": np.append(pos, np.zeros(len(witness), int)).astype("<u4")}
            e["block"], e["known"] = np.append((sets >> SET_BITS)[owner], np.full(len(witness), -1)), np.append(known, np.zeros(len(witness), bool))
            e["bucket"] = ((e["hash"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((e["block"], e["bucket"], e["known"]))
            e = {k: v[order] for k, v in e.items()}
            step = (np.diff(e["block"]) != 0) | (np.diff(e["bucket"]) != 0) | (np.diff(e["known"].astype(int)) != 0)
            cut = np.concatenate([[0], np.flatnonzero(step) + 1, [len(order)]]) if len(order) else np.zeros(1, int)
            at = cut[:-1]
            anywhere = (mix64(e["block"][at].astype(np.uint64) * np.uint64(buckets) + e["bucket"][at].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            heads = [pa.array(np.where(e["known"][at], anywhere, e["bucket"][at]), pa.int32()), pa.array(e["known"][at]), pa.array(e["bucket"][at], pa.int32()), pa.array(e["block"][at])]
            yield pa.RecordBatch.from_arrays(heads + [_split(v, cut) for v in (e["own"], e["pos"], (e["hash"] & np.uint64(0xFFFFFFFF)).astype("<u4"))], ["deal", "known", "bucket", "block", "own", "pos", "hash"])

    return apply


def _column(table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def shared_entries(table: pa.Table) -> pa.Table:
    """The entries whose shingle another set has too."""
    known = table.filter(table.column("known")).select(["bucket", "block", "own", "pos", "hash"])
    open_ = table.filter(pc.invert(table.column("known")))
    own, pos, h = _column(open_, "own", "<u2"), _column(open_, "pos", "<u4"), _column(open_, "hash", "<u4")
    size = np.array([len(x) // 2 for x in open_.column("own").to_pylist()], np.int64)
    block = np.repeat(open_.column("block").to_numpy(), size)
    order = np.argsort(h, kind="stable")
    edge = _runs(h[order])
    kept = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
    kept = kept[own[kept] != WITNESS]
    kept = kept[np.argsort(block[kept], kind="stable")]
    cut = _runs(block[kept])
    at = block[kept][cut[:-1]]
    bucket = np.full(len(at), open_.column("bucket")[0].as_py() if open_.num_rows else 0)
    found = pa.table([pa.array(bucket, pa.int32()), pa.array(at, pa.int64()), *(_split(v[kept], cut) for v in (own, pos, h))], names=known.column_names)
    return pa.concat_tables([found, known.cast(found.schema)])


def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, 1 << 16, 16 << 20):  # counts of a task's part are summed here
        raw = batch.column(1).to_pylist()
        sets = np.repeat(batch.column(0).to_numpy() << SET_BITS, [len(r) // 2 for r in raw]) + np.frombuffer(b"".join(raw), "<u2")
        found, times = np.unique(sets, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["set", "shared"])


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the ids of their sets and the least shingle of these in each random order."""
    for batch in slices(batches):
        rows, hashes = shingle_sets(text_array(batch))
        size, *ids = set_ids(rows, hashes, batch.num_rows)
        some = np.flatnonzero(size)
        least = np.zeros((batch.num_rows, SEEDS * ROUNDS), np.uint64)
        for k in range(SEEDS * ROUNDS):
            if len(some):
                least[some, k] = np.minimum.reduceat(mix64(hashes ^ mix64(np.array([k + 1], np.uint64))), np.searchsorted(rows, some))
        cut = pa.array(np.arange(batch.num_rows + 1) * SEEDS * ROUNDS, pa.int32())
        yield pa.RecordBatch.from_arrays([*map(pa.array, ids), batch.column(0).cast(pa.string()), pa.ListArray.from_arrays(cut, pa.array(least.ravel().view(np.int64)))], ["sid", "sid2", "text", "least"])


def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, common) of pairs with the texts x of a and y of b."""
    for wide in slices(batches, "x"):
        for batch in slices(iter([wide]), "y"):
            sides = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")]
            ids, place = np.unique(np.concatenate([s.to_numpy() for s in sides]), return_index=True)
            both = pa.concat_arrays([text_array(batch, "x"), text_array(batch, "y")]).take(pa.array(place))
            rows, codes = exact_sets(both)
            edge = np.searchsorted(rows, np.arange(len(ids) + 1))
            common = [len(np.intersect1d(codes[edge[x] : edge[x + 1]], codes[edge[y] : edge[y + 1]], assume_unique=True)) for x, y in zip(*(np.searchsorted(ids, s.to_numpy()) for s in sides))]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(common, pa.int64())], ["a", "b", "common"])


def compared(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """pairs (a, b, ...) with how many shingles they have in common, by the whole texts (set, text).

    A set in very many pairs is dealt over several keys.
    """
    pairs = materialize(pairs, f"{name}-pairs")
    many = max(512, pairs.count() // 50_000)
    sides = pairs.select("a", "b")
    for key, other, text in (("a", "b", "x"), ("b", "a", "y")):
        hot = F.broadcast(pairs.groupBy(key).count().where(F.col("count") > many).select(F.col(key).alias("set"), F.ceil(F.col("count") / many).cast("int").alias("parts")))  # 50,000 rows at most
        part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
        sides = sides.withColumnRenamed(key, "set").join(hot, "set", "left").withColumn("part", part).drop("parts")
        dealt_ = texts.select("set", F.col("text").alias(text)).join(hot, "set", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        sides = sides.join(dealt_, ["set", "part"]).drop("part").withColumnRenamed("set", key)
    found = sides.select("a", "b", "x", "y").mapInArrow(overlap, "a long, b long, common long")
    return materialize(pairs.join(found, ["a", "b"]), name)


def linked(common: str = "common") -> Column:
    return F.expr(f"100 * {common} >= {PERCENT} * (na + nb - {common})")


def proposals(sets: DataFrame, seed: int) -> DataFrame:
    """(a, b, na, nb, hub): in each of SEEDS orders, sets (one of each label) with their least shingle's hub, if labels differ."""
    least = sets.select("set", "n", "label", (F.col("cap") / F.col("n")).alias("part"), F.posexplode(F.slice("least", seed + 1, SEEDS)).alias("order", "sig"))
    rank = F.struct("part", (-F.col("set")).alias("first"), "n", "label")
    own = least.groupBy("order", "sig", "label").agg(F.max(rank).alias("own"))
    hubs = own.groupBy("order", "sig").agg(F.max("own").alias("hub"), F.count("*").alias("size")).where("size > 1").select("order", "sig", "hub", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    met = own.withColumn("salt", F.pmod(F.xxhash64("label"), F.lit(8)).cast("int")).join(hubs, ["order", "sig", "salt"]).where("own.label <> hub.label")
    a, b = -F.col("own.first"), -F.col("hub.first")
    met = met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(a < b, F.col("own.n")).otherwise(F.col("hub.n")).alias("na"), F.when(a < b, F.col("hub.n")).otherwise(F.col("own.n")).alias("nb"), b.alias("hub"))
    return met.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").groupBy("a", "b", "na", "nb").agg(F.max("hub").alias("hub"))


LISTS = "deal int, part int, parts int, block long, heads binary, own binary, key binary, rank binary, rest binary"
HEAD = np.dtype([("set", "<i8"), ("label", "<i8"), ("n", "<i4"), ("cap", "<i4")])


def list_entries(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Entries of a block's open sets, with the numbers of shared shingles before and of all shingles after, dealt into buckets."""

    def apply(entries: pa.Table, sets: pa.Table) -> pa.Table:
        head = np.zeros(sets.num_rows, HEAD)
        for name in HEAD.names:
            head[name] = sets.column(name).to_numpy()
        head = np.sort(head, order="set")
        size = [len(x) // 2 for x in entries.column("own").to_pylist()]
        own, pos, h = (_column(entries, c, t) for c, t in (("own", "<u2"), ("pos", "<u4"), ("hash", "<u4")))
        key = (np.repeat(entries.column("bucket").to_numpy().astype(np.uint64), size) << np.uint64(32)) | h
        set_ = np.repeat(entries.column("block").to_numpy() << SET_BITS, size) + own
        place = np.searchsorted(head["set"], set_)
        keep = place < len(head)
        keep[keep] = head["set"][place[keep]] == set_[keep]
        order = np.flatnonzero(keep)[np.lexsort((pos[keep], place[keep]))]
        place, pos, key = place[order], pos[order].astype(np.int64), key[order]
        edge = _runs(place)
        rank = np.arange(len(place)) - np.repeat(edge[:-1], np.diff(edge))
        rest = head["n"][place] - 1 - pos
        keep = 100 * (rank + 1 + rest) >= PERCENT * head["n"][place]  # no link shares an entry after too many unshared ones
        place, key, rank, rest = place[keep], key[keep], rank[keep], rest[keep]
        deal = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        place, key, rank, rest, cut = place[order], key[order], rank[order], rest[order], _runs(deal[order])
        rows = []
        for a, b in zip(cut, cut[1:]):
            used, local = np.unique(place[a:b], return_inverse=True)
            rows.append((int(deal[order[a]]), 0, 1, int(head["set"][0] >> SET_BITS), head[used].tobytes(), local.astype("<u2").tobytes(), key[a:b].astype("<u8").tobytes(), rank[a:b].astype("<u4").tobytes(), rest[a:b].astype("<u4").tobytes()))
        names = [f.split()[0] for f in LISTS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return apply


def _entries(batch) -> dict[str, np.ndarray]:
    """Columns of the entries of rows of LISTS."""
    heads = [np.frombuffer(h, HEAD) for h in batch.column("heads").to_pylist()]
    own = batch.column("own").to_pylist()
    before = np.cumsum([0, *map(len, heads)])[:-1]
    place = np.frombuffer(b"".join(own), "<u2").astype(np.int64) + np.repeat(before, [len(o) // 2 for o in own])
    head = np.concatenate([np.zeros(0, HEAD), *heads])
    return {"key": _column(batch, "key", "<u8"), "rank": _column(batch, "rank", "<u4").astype(np.int64), "rest": _column(batch, "rest", "<u4").astype(np.int64)} | {k: head[k][place].astype(np.int64) for k in HEAD.names}


def list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, size, least label, greatest label) of the lists, batch by batch."""
    for batch in gathered(batches):
        e = _entries(batch)
        order = np.argsort(e["key"], kind="stable")
        label, edge = e["label"][order], _runs(e["key"][order])
        at = edge[:-1]
        least, most = (f.reduceat(label, at) if len(at) else label for f in (np.minimum, np.maximum))
        yield pa.RecordBatch.from_arrays([pa.array(e["key"][order][at].view(np.int64)), pa.array(np.diff(edge)), pa.array(least), pa.array(most)], ["key", "size", "least", "most"])


def chunked(long_: dict[int, tuple[int, int]], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deal the entries of long lists as pairs of chunks; long_: (number, chunks) of each one's key, no chunks if it has one label."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(long_), np.uint64)
        for batch in batches:
            out = []
            for row in pa.Table.from_batches([batch]).to_pylist():
                own, key, rank, rest = (np.frombuffer(row[c], t) for c, t in (("own", "<u2"), ("key", "<u8"), ("rank", "<u4"), ("rest", "<u4")))
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hot = keys[at] == key
                part = lambda m, **other: row | {c: v[m].tobytes() for c, v in (("own", own), ("key", key), ("rank", rank), ("rest", rest))} | other
                out.append(part(~hot))
                sets = np.frombuffer(row["heads"], HEAD)["set"][own]
                for k in np.unique(at[hot]):
                    number, chunks = long_[int(keys[k])]
                    chunk = (mix64(sets.view(np.uint64)) % np.uint64(max(chunks, 1))).astype(np.int64)
                    for c in range(chunks):
                        mine = hot & (at == k) & (chunk == c)
                        if mine.any():
                            out += [part(mine, deal=buckets + number, part=min(c, d) * chunks + max(c, d), parts=chunks) for d in range(chunks)]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return apply


CANDIDATES = "a long, b long, na long, nb long, shared long"


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets with different labels that share a list, and how many lists, as far as a link is possible by
    sizes, unshared shingles and positions. In a chunk pair of a long list, only pairs between the chunks."""
    tables = [_entries(b) | {"part": np.full(1, b.column("part")[0].as_py()), "parts": np.full(1, b.column("parts")[0].as_py())} for b in batches if b.num_rows]
    if not tables:
        return
    part, parts = int(tables[0]["part"][0]), int(tables[0]["parts"][0])
    e = {k: np.concatenate([t[k] for t in tables]) for k in tables[0] if k not in ("part", "parts")}
    order = np.lexsort((e["set"], e["n"], e["key"]))
    e = {k: v[order] for k, v in e.items()}
    first, second = divmod(part, parts)
    side = (mix64(e["set"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    known, own = np.unique(e["set"], return_inverse=True)
    size = np.zeros(len(known), np.int64)
    size[own] = e["n"]
    held: dict[str, np.ndarray] = {"codes": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    fresh: list[np.ndarray] = []

    def possible(x: np.ndarray, y: np.ndarray) -> None:
        """Count the pairs (x, y) of entries of a list, x with the smaller set."""
        least = needed(e["n"][x], e["n"][y])
        ok = (e["label"][x] != e["label"][y]) & (100 * e["n"][x] >= PERCENT * e["n"][y]) & (np.minimum(e["cap"][x], e["cap"][y]) >= least)
        ok &= np.minimum(e["rank"][x], e["rank"][y]) + 1 + np.minimum(e["rest"][x], e["rest"][y]) >= least
        if first != second:
            ok &= side[x] != side[y]
        x, y = own[x[ok]], own[y[ok]]
        fresh.append(np.minimum(x, y) * len(known) + np.maximum(x, y))

    def settle() -> None:
        new, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *fresh]), return_counts=True)
        fresh.clear()
        codes, where = np.unique(np.concatenate([held["codes"], new]), return_inverse=True)
        held["codes"], held["times"] = codes, np.bincount(where, np.concatenate([held["times"], counts]), len(codes)).astype(np.int64)

    def written() -> pa.RecordBatch:
        a, b = held["codes"] // len(known), held["codes"] % len(known)
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (known[a], known[b], size[a], size[b], held["times"])], [c.split()[0] for c in CANDIDATES.split(", ")])
        held["codes"] = held["times"] = np.zeros(0, np.int64)
        return batch

    edge = _runs(e["key"])
    start, end = edge[:-1], edge[1:]
    mixed = np.minimum.reduceat(e["label"], start) != np.maximum.reduceat(e["label"], start)
    short = mixed & (end - start <= BLOCK)
    stop = np.repeat(np.where(short, end, 0), end - start)  # of each entry of a short list
    at = np.flatnonzero(stop)
    for step in range(1, BLOCK):
        at = at[at + step < stop[at]]
        if not len(at):
            break
        possible(at, at + step)
        if sum(map(len, fresh)) > 1_000_000:
            settle()
            if len(held["codes"]) > HELD_PAIRS:
                yield written()
    for f, t in zip(start[mixed & ~short], end[mixed & ~short]):
        blocks = np.append(np.arange(f, t, BLOCK), t)
        lows, highs = e["n"][blocks[:-1]], e["n"][blocks[1:] - 1]
        caps = np.maximum.reduceat(e["cap"][f:t], blocks[:-1] - f)
        reach = np.maximum.reduceat(e["rank"][f:t], blocks[:-1] - f) + 1 + np.maximum.reduceat(e["rest"][f:t], blocks[:-1] - f)
        for i in range(len(lows)):
            for j in range(i, len(lows)):
                if 100 * highs[i] < PERCENT * lows[j]:
                    break  # this block and all after it hold sets too large
                if min(caps[i], caps[j], reach[i], reach[j]) < needed(lows[i], lows[j]):
                    continue  # no set of these sizes has enough shared shingles left
                x, y = np.meshgrid(np.arange(blocks[i], blocks[i + 1]), np.arange(blocks[j], blocks[j + 1]), indexing="ij")
                ok = x < y
                possible(x[ok], y[ok])
                if sum(map(len, fresh)) > 1_000_000:
                    settle()
                    if len(held["codes"]) > HELD_PAIRS:
                        yield written()
    settle()
    yield written()


def derived(pairs: DataFrame, hubs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among pairs (a, b, na, nb), from the overlaps of their hubs (set, hub, n_hub, common) and, where these leave it open, the texts."""
    for side in "ab":
        mine = hubs.select(F.col("set").alias(side), F.col("hub").alias(f"h{side}"), F.col("n_hub").alias(f"nh{side}"), F.col("common").alias(f"c{side}"))
        pairs = pairs.join(mine, side, "left")
        for c, own in (("h", side), ("nh", f"n{side}"), ("c", f"n{side}")):
            pairs = pairs.withColumn(c + side, F.coalesce(c + side, own))
    turned = F.col("ha") > F.col("hb")
    pairs = materialize(pairs, "jaccard-derive")
    met = pairs.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"), F.when(turned, F.col("nhb")).otherwise(F.col("nha")).alias("na"), F.when(turned, F.col("nha")).otherwise(F.col("nhb")).alias("nb")).distinct()
    met = compared(met, texts, "jaccard-hubs").select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("common").alias("between"))
    known = pairs.join(met, (F.least("ha", "hb") == F.col("p")) & (F.greatest("ha", "hb") == F.col("q")))
    known = known.withColumn("most", F.expr("least(na, nb, between + (na - ca) + (nb - cb))")).withColumn("least", F.expr("greatest(0, between - (nha - ca) - (nhb - cb))"))
    sure = linked("least")
    known = materialize(known.where(linked("most")).select("a", "b", "na", "nb", sure.alias("sure")), "jaccard-derived")
    rest = compared(known.where("NOT sure").select("a", "b", "na", "nb"), texts, "jaccard-last").where(linked())
    return known.where("sure").select("a", "b").unionByName(rest.select("a", "b"))


def join_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, d1, d2, root) of every document.

    d1, d2: hashes of the text; root: number of the component's first set, null for an empty set. With
    doc_id they tell rows apart whose doc_id is repeated or null.
    """
    docs = docs.select("doc_id", "text")
    classes = frequency_classes(docs)
    hashed = docs.withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(1), "text"))
    rows = materialize(hashed.mapInArrow(prefixes(classes), "doc_id long, d1 long, d2 long, n long, sid long, sid2 long, prefix binary"), "jaccard-prefixes")
    groups = rows.where("n > 0").groupBy("sid", "sid2", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"))
    groups = materialize(groups.withColumn("set", F.monotonically_increasing_id()), "jaccard-groups")
    volume = groups.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    buckets = int(volume // BUCKET_ENTRIES) + 1
    shared = groups.select("set", "prefix").mapInArrow(dealt(buckets), f"deal int, known boolean, {ENTRIES}").groupBy("deal").applyInArrow(shared_entries, ENTRIES)
    shared = materialize(shared, "jaccard-shared")
    counts = shared.select("block", "own").mapInArrow(count_shared, "set long, shared long").groupBy("set").agg(F.sum("shared").alias("shared"))
    cap = F.expr(f"{after('n')} + shared")
    open_ = materialize(groups.drop("prefix", "copies").join(counts, "set").withColumn("cap", cap).where(f"100 * cap >= {PERCENT} * n").drop("shared"), "jaccard-open")
    ids = open_.select(F.col("doc_id").alias("holder")).distinct()
    ids = F.broadcast(ids) if open_.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, docs.doc_id.eqNullSafe(F.col("holder")), "left_semi").select("text").mapInArrow(described, "sid long, sid2 long, text string, least array<long>")
    texts = texts.groupBy("sid", "sid2").agg(F.first(F.struct("text", "least")).alias("t")).join(open_.drop("doc_id"), ["sid", "sid2"])
    texts = materialize(texts.select("set", "n", "cap", "t.text", "t.least"), "jaccard-texts")
    sets = texts.select("set", "n", "cap", "least").withColumn("label", F.col("set"))
    found = links = None
    for round_ in range(ROUNDS):
        pairs = proposals(sets, round_ * SEEDS)
        if found is not None:
            pairs = pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")
        new = compared(pairs, texts, "jaccard-near")
        found = new if found is None else found.unionByName(new)
        links = found.where(linked()).select("a", "b")
        labels = connected_components(links, "a", "b").select(F.col("node").alias("set"), F.col("component").alias("c"))
        sets = materialize(sets.drop("label").join(labels, "set", "left").withColumn("label", F.coalesce("c", "set")).drop("c"), "jaccard-labelled")
    hub = F.when(F.col("a") == F.col("hub"), F.struct("common", "b", F.col("a").alias("hub"), F.col("na").alias("n_hub"))).otherwise(F.struct("common", F.col("a").alias("b"), F.col("b").alias("hub"), F.col("nb").alias("n_hub")))
    hubs = found.where(linked()).select(hub.alias("best")).groupBy(F.col("best.b").alias("set")).agg(F.max("best").alias("best")).select("set", "best.hub", "best.n_hub", "best.common")
    hubs = materialize(hubs, "jaccard-hub")

    entries = shared.agg(F.sum(F.length("own") / 2)).first()[0] or 0
    buckets = int(entries // BUCKET_ENTRIES) + 1
    blocks = sets.select("set", "n", "cap", "label", F.shiftright("set", SET_BITS).alias("block"))
    lists = materialize(shared.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(list_entries(buckets), LISTS), "jaccard-lists")
    if sets.count() > LIST:  # else no list is longer
        sizes = lists.mapInArrow(list_sizes, "key long, size long, least long, most long").groupBy("key").agg(F.sum("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most"))
        long_ = sizes.where(F.col("size") > LIST).collect()  # at most one for LIST entries
        if long_:
            plan = {r.key % (1 << 64): (k, 0 if r.least == r.most else -(-r.size // LIST)) for k, r in enumerate(long_)}
            lists = lists.mapInArrow(chunked(plan, buckets), LISTS)
    more = lists.groupBy("deal", "part").applyInArrow(across, CANDIDATES).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    possible = F.expr(f"shared + greatest({after('na')}, {after('nb')}) >= ({PERCENT} * (na + nb) + {99 + PERCENT}) DIV {100 + PERCENT}")
    more = materialize(more.where(possible).drop("shared").join(found.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-more")
    links = links.unionByName(derived(more, hubs, texts))

    roots = connected_components(links, "a", "b")
    placed = groups.drop("prefix", "n").join(roots.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("root", F.coalesce("component", "set"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("members")).where("members > 1").drop("members")
    many = F.greatest(F.lit(10_000), F.lit(rows.count() // 50_000))  # so fewer than 50,000 rows are broadcast
    names = materialize(placed.join(smallest, "root", "left").select("sid", "sid2", F.struct("component_id", "root").alias("known"), (F.col("copies") > many).alias("hot")), "jaccard-names")
    rows = rows.select("doc_id", "d1", "d2", "n", "sid", "sid2").join(F.broadcast(names.where("hot").select("sid", "sid2", F.col("known").alias("hot"))), ["sid", "sid2"], "left")
    usual = rows.where("hot IS NULL").join(names.where("NOT hot").select("sid", "sid2", "known"), ["sid", "sid2"], "left").drop("hot")
    every = rows.where("hot IS NOT NULL").withColumnRenamed("hot", "known").select(*usual.columns).unionByName(usual)
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("known.component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "d1", "d2", F.when(F.col("n") > 0, F.col("known.root")).alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest doc_id (nulls last); rows without a word all stay.

    Rows are told apart by doc_id and 128 bits of their text; of rows equal in both, one stays.
    """
    key = ["__null", "__id", "__d1", "__d2"]
    row = lambda df, d1, d2: df.withColumn("__null", F.col("doc_id").isNull()).withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__d1", d1).withColumn("__d2", d2)
    found = row(join_sets(docs).where("root IS NOT NULL"), F.col("d1"), F.col("d2"))
    found = materialize(found.groupBy("root", *key).agg(F.count("*").alias("times")), "jaccard-rows")
    best = found.groupBy("root").agg(F.min(F.struct(*key)).alias("best"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    gone = found.join(best, "root").where(F.struct(*key) != F.col("best")).select(*key)
    twice = found.where("times > 1").select(*key)
    changed = materialize(gone.withColumn("gone", F.lit(True)).unionByName(twice.withColumn("gone", F.lit(False))).groupBy(*key).agg(F.max("gone").alias("gone")), "jaccard-gone")
    small = changed.count() <= BROADCAST_IDS
    side = lambda df: F.broadcast(df) if small else df
    rows = row(docs, F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    once = rows.join(side(changed.select(*key)), key, "left_anti")
    one = rows.join(side(changed.where("NOT gone").select(*key)), key, "left_semi").dropDuplicates(key)
    return once.select(*docs.columns).unionByName(one.select(*docs.columns))


#: doc_id, n_shingles and component_id in DuckDB SQL, by brute force over shared shingles.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, c) USING KEY (id) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, min(r.c) FROM r JOIN e ON e.a = r.id JOIN recurring.r q ON q.id = e.b GROUP BY e.b, q.c HAVING min(r.c) < q.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id
"""
