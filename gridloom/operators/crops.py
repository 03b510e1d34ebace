"""Crops of a sparsely annotated mask: blocks with anchors, a split of the blocks, and a schedule of crops.

A mask is cut into blocks; each connected piece of foreground within a scan tile of a block is one candidate, whatever its size, and a
block keeps ``ANCHORS`` of them by a bottom-k sample (the smallest keyed hashes), of which those of a task's scan tile are kept there already.
Crops are placed by a schedule of draws: every other one around an anchor, the rest beside anchors or anywhere, drawn again until a window
holds no foreground. All attempts of a crop are rows; windows are judged by summed-area tables of tiles.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.components import label_tile
from gridloom.operators.rects import touched_cells
from gridloom.plans.shared import materialize

#: Anchors of a block, side of a scan tile, smallest side of a block, seed of splits and of validation crops. Fixed values.
ANCHORS, SCAN, LEAST_SIDE, HOLDOUT_SEED = 16, 2048, 512, 42
#: Attempts for a crop without foreground, and how many of them stay near an anchor. Fixed values.
ATTEMPTS, NEAR_ATTEMPTS = 64, 32
#: Steps from an anchor to nearby background, and their least and further length in crops. Fixed values.
DIRECTIONS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)]
STEP, STEP_RANGE = 0.8, 0.6
#: Attempts that are judged together, for crops that are still without a window.
WAVES = [0, 4, 16, ATTEMPTS]
#: Side of a summed-area table, and windows that one task judges with it.
TABLE, WINDOWS = 256, 50_000


def block_counts(height: int, width: int, crop: int, least: int = LEAST_SIDE) -> tuple[int, int]:
    """Rows and columns of blocks: sides of twice the crop, ``least`` at least, half of the longer axis at most."""
    side = min(max(least, 2 * crop), max(height, width) // 2)
    return max(1, height // side), max(1, width // side)


def edge(k: Column | int, extent: int, parts: int) -> Column:
    """Start of the k-th of equal parts of an extent, in whole pixels."""
    return F.when(F.lit(k) == parts, F.lit(extent)).otherwise(F.floor(F.lit(k) * F.lit(extent / parts))).cast("long")


def part_of(at: Column, extent: int, parts: int) -> Column:
    """The part in which a pixel lies: the quotient, moved by one where rounding made it miss."""
    k = F.least(F.floor(at / F.lit(extent / parts)), F.lit(parts - 1)).cast("long")
    return (k + (edge(k + 1, extent, parts) <= at).cast("long") - (edge(k, extent, parts) > at).cast("long")).cast("long")


def blocks_of(spark, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """(block, y0, x0, y1, x1), numbered row by row."""
    n = spark.range(rows * cols).select(F.col("id").alias("block"), F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    return n.select("block", edge(F.col("r"), height, rows).alias("y0"), edge(F.col("c"), width, cols).alias("x0"), edge(F.col("r") + 1, height, rows).alias("y1"), edge(F.col("c") + 1, width, cols).alias("x1"))


def ticket(seed: str, y: int, x: int) -> str:
    return hashlib.md5(f"{seed}:{y}:{x}".encode()).hexdigest()


def _middles(seed: str):
    """(block, y, x, ticket, seen) of a scan tile: the middle pixel in reading order of each piece, those with the smallest tickets, and how many there are."""

    def apply(table: pa.Table) -> pa.Table:
        found = label_tile(table.select(["y", "x", "v"]))
        y, x, piece = (found.column(c).to_numpy() for c in ("y", "x", "component"))
        order = np.lexsort((x, y, piece))
        first = np.flatnonzero(np.diff(piece[order], prepend=-1))
        middle = order[first + np.diff([*first, len(piece)]) // 2]
        kept = heapq.nsmallest(ANCHORS, ((ticket(seed, a, b), a, b) for a, b in zip(y[middle].tolist(), x[middle].tolist())))
        return pa.table({"block": [table.column("block")[0].as_py()] * len(kept), "y": [k[1] for k in kept], "x": [k[2] for k in kept], "ticket": [k[0] for k in kept], "seen": pa.array([len(first), *[0] * (len(kept) - 1)], pa.int64())})

    return apply


def anchors(mask: DataFrame, height: int, width: int, rows: int, cols: int, seed: str, scan: int = SCAN) -> DataFrame:
    """(block, y, x, ticket, seen): up to ANCHORS pieces of foreground of each block, one pixel each; ``seen`` sums up to all pieces."""
    y0, x0 = (edge(part_of(F.col(c), n, k), n, k) for c, n, k in (("y", height, rows), ("x", width, cols)))
    block = part_of(F.col("y"), height, rows) * cols + part_of(F.col("x"), width, cols)
    rows_of = mask.where("v <> 0").select(block.alias("block"), F.floor((F.col("y") - y0) / scan).alias("sy"), F.floor((F.col("x") - x0) / scan).alias("sx"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.lit(1).cast("long").alias("v"))
    found = rows_of.groupBy("block", "sy", "sx").applyInArrow(_middles(seed), "block long, y long, x long, ticket string, seen long")
    rank = F.row_number().over(W.partitionBy("block").orderBy("ticket", "y", "x"))
    whole = F.sum("seen").over(W.partitionBy("block"))
    return found.withColumn("_r", rank).withColumn("seen", whole).where(F.col("_r") <= ANCHORS).select("block", "y", "x", "ticket", "seen", F.col("_r").alias("rank"))


def split_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """blocks with their anchors (array), split and place among the positive blocks and all blocks of the split.

    Validation gets a quarter of the blocks with anchors, one at least, and a quarter of the others, by an order that no seed of a run changes.
    """
    held = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rank", "y", "x"))).alias("anchors"), F.max("seen").alias("seen"))  # ANCHORS at most
    every = blocks.join(held, "block", "left").withColumn("positive", F.col("anchors").isNotNull())
    order = F.md5(F.concat_ws(":", F.lit(str(HOLDOUT_SEED)), F.col("block").cast("string")))
    kind = W.partitionBy("positive")
    n, rank = F.count("*").over(kind), F.row_number().over(kind.orderBy(order))
    quarter = F.floor(n / 4)
    most = F.when(F.col("positive"), F.greatest(F.lit(1), quarter)).otherwise(quarter)
    every = every.withColumn("split", F.when(rank <= most, "validation").otherwise("training"))
    return every.withColumn("pool", F.row_number().over(W.partitionBy("split").orderBy("block")) - 1).withColumn("place", F.row_number().over(W.partitionBy("split", "positive").orderBy(order)) - 1)


def draw(what: str, seed: Column) -> Column:
    """A number below 2 ** 32 for a crop's attempt, the same in any SQL engine."""
    key = F.concat_ws(":", seed, F.lit(what), "split", F.col("i").cast("string"), F.col("attempt").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def window_counts(mask: DataFrame, windows: DataFrame, tile: int = TABLE) -> DataFrame:
    """windows (window, y0, x0, y1, x1, ..) with ``foreground``, the pixels of the mask in them.

    A tile's pixels make one summed-area table, from which each of its windows takes four numbers. A tile with many windows is read by several tasks.
    """
    pieces = touched_cells(windows.select("window", "y0", "x0", "y1", "x1"), tile)
    parts = pieces.groupBy("row", "col").agg(F.ceil(F.count("*") / WINDOWS).cast("int").alias("parts"))
    asked = pieces.join(parts, ["row", "col"]).withColumn("part", F.pmod(F.xxhash64("window"), F.col("parts")).cast("int"))
    held = mask.where("v <> 0").select(F.floor(F.col("y") / tile).alias("row"), F.floor(F.col("x") / tile).alias("col"), "y", "x").join(parts, ["row", "col"])
    held = held.select("row", "col", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "y", "x")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"window": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        top, low = left.column("row")[0].as_py() * tile, left.column("col")[0].as_py() * tile
        table = np.zeros((tile + 1, tile + 1), np.int64)
        table[right.column("y").to_numpy() - top + 1, right.column("x").to_numpy() - low + 1] = 1
        table = table.cumsum(axis=0).cumsum(axis=1)
        y0, x0, y1, x1 = (np.clip(left.column(c).to_numpy() - at, 0, tile) for c, at in (("y0", top), ("x0", low), ("y1", top), ("x1", low)))
        return pa.table({"window": left.column("window"), "n": table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]})

    keys = ["row", "col", "part"]
    found = asked.select(*keys, "window", "y0", "x0", "y1", "x1").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(count, "window long, n long")
    total = found.groupBy("window").agg(F.sum("n").alias("foreground"))
    return windows.join(total, "window", "left").withColumn("foreground", F.coalesce("foreground", F.lit(0).cast("long")))


def _clip(at: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(at, low), high)


def attempts(wanted: DataFrame, blocks: DataFrame, size: int, seed: str, first: int, last: int) -> DataFrame:
    """(split, i, requested, attempt, kind, block, y0, x0) of some attempts for wanted (split, i, requested)."""
    sizes = blocks.groupBy("split").agg(F.count("*").alias("n_pool"), F.count_if("positive").alias("n_positive"))  # two rows
    own = F.when(F.col("split") == "training", F.lit(seed)).otherwise(F.lit(str(HOLDOUT_SEED)))
    rows = wanted.join(F.broadcast(sizes), "split").withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    rows = rows.where("requested <> 'positive' OR attempt = 0")
    near = (F.col("requested") == "nearby background") & (F.col("attempt") < NEAR_ATTEMPTS)
    around = (F.col("requested") == "positive") | near
    place = F.when(F.col("requested") == "positive", F.floor(F.col("i") / 2) % F.col("n_positive")).when(near, draw("block", own) % F.col("n_positive")).otherwise(draw("block", own) % F.col("n_pool"))
    rows = rows.select("split", "i", "requested", "attempt", around.alias("around"), near.alias("near"), place.alias("at"), *[draw(w, own).alias(w) for w in ("anchor", "y", "x", "direction", "step")])
    spread = blocks.select("split", F.col("block"), "y0", "x0", "y1", "x1", "anchors", F.explode(F.array(F.struct(F.lit(False).alias("around"), F.col("pool").cast("long").alias("at")), F.when(F.col("positive"), F.struct(F.lit(True).alias("around"), F.col("place").cast("long").alias("at"))))).alias("k"))
    spread = spread.where("k IS NOT NULL").select("split", "k.around", "k.at", "block", F.col("y0").alias("b_y0"), F.col("x0").alias("b_x0"), F.col("y1").alias("b_y1"), F.col("x1").alias("b_x1"), "anchors")
    rows = rows.join(spread, ["split", "around", "at"]).withColumn("a", F.expr("anchors[CAST(anchor % size(anchors) AS INT)]"))
    step = (F.lit(STEP) + F.lit(STEP_RANGE) * (F.col("step") / F.lit(4294967296.0))) * size
    corner = {}
    for k, c in enumerate("yx"):
        low, high = F.col(f"b_{c}0"), F.col(f"b_{c}1") - size
        jitter = F.col(c) % (size // 4 + -(-size // 4) + 1) - -(-size // 4)
        toward = F.element_at(F.array(*[F.lit(d[k]) for d in DIRECTIONS]), (F.col("direction") % len(DIRECTIONS) + 1).cast("int"))
        beside = F.floor(_clip(F.col(f"a.{c}") + toward * step - size / 2, low.cast("double"), high.cast("double"))).cast("long")
        inside = _clip(F.col(f"a.{c}") - size // 2 + jitter, low, high)
        corner[f"{c}0"] = F.when(F.col("near"), beside).when(F.col("around"), inside).otherwise(low + F.col(c) % (high - low + 1)).cast("long")
    kind = F.when(F.col("requested") == "positive", "positive").when(F.col("near"), "nearby background").otherwise("background")
    return rows.select("split", "i", "requested", "attempt", kind.alias("kind"), "block", *[v.alias(k) for k, v in corner.items()])


def sample_crops(mask: DataFrame, height: int, width: int, crop: int, samples: int, seed: str, least: int = LEAST_SIDE, scan: int = SCAN) -> DataFrame:
    """(split, i, requested, kind, block, y0, x0, size, foreground, attempt) of ``samples`` crops, a quarter of them (two at least) for validation.

    A crop without foreground that isn't found in ATTEMPTS draws stays where the last one put it, as mixed context. Fewer than two blocks with
    foreground, or an image too small for two areas, are errors.
    """
    size = min(crop, height, width, max(height, width) // 2)
    if size < 32:
        raise ValueError("crops need 32 pixels on each axis and 64 on one")
    rows, cols = block_counts(height, width, size, least)
    spark = mask.sparkSession
    blocks = materialize(split_blocks(blocks_of(spark, height, width, rows, cols), anchors(mask, height, width, rows, cols, seed, scan)), "crop-blocks")
    if (annotated := blocks.where("positive").count()) < 2:
        raise ValueError("no foreground in the mask" if not annotated else "foreground lies in one block only; take smaller crops")
    held_out = max(2, samples // 4)
    i = F.col("id")
    requested = F.when(i % 2 == 0, "positive").when(i % 4 == 1, "nearby background").otherwise("background")
    left, out = None, None
    for split, n in (("training", samples - held_out), ("validation", held_out)):
        part = spark.range(n).select(F.lit(split).alias("split"), i.alias("i"), requested.alias("requested"))
        left = part if left is None else left.unionByName(part)
    for first, last in zip(WAVES, WAVES[1:]):
        tried = attempts(left, blocks, size, seed, first, last)
        number = (F.when(F.col("split") == "training", 0).otherwise(1) * F.lit(samples) + F.col("i")) * ATTEMPTS + F.col("attempt")
        tried = materialize(tried.select("*", number.cast("long").alias("window"), (F.col("y0") + size).alias("y1"), (F.col("x0") + size).alias("x1")), "crop-attempts")
        judged = window_counts(mask, tried)
        good = (F.col("requested") == "positive") | (F.col("foreground") == 0)
        best = judged.withColumn("_good", good).withColumn("_r", F.row_number().over(W.partitionBy("split", "i").orderBy(F.desc("_good"), F.when(good, F.col("attempt")).otherwise(-F.col("attempt"))))).where("_r = 1")
        best = materialize(best, "crop-wave")
        done = best if last == ATTEMPTS else best.where("_good")
        out = done if out is None else out.unionByName(done)
        left = best.where("NOT _good").select("split", "i", "requested")
    kind = F.when((F.col("requested") != "positive") & (F.col("foreground") > 0), "mixed context").otherwise(F.col("kind"))
    return out.select("split", "i", "requested", kind.alias("kind"), "block", "y0", "x0", F.lit(size).cast("long").alias("size"), "foreground", "attempt")

