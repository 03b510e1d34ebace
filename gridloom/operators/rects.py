"""Algebra of half-open rectangles [y0, x0, y1, x1), grids and coverage."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ["y0", "x0", "y1", "x1"]


def box(y0, x0, y1, x1) -> Column:
    return F.struct(y0.alias("y0"), x0.alias("x0"), y1.alias("y1"), x1.alias("x1"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["y0"] < b["y1"]) & (b["y0"] < a["y1"]) & (a["x0"] < b["x1"]) & (b["x0"] < a["x1"])


def subtract(area: Column, cut: Column) -> Column:
    """Up to four disjoint pieces of an area outside a cut: above, below, left, right."""
    top, bottom = F.greatest(area["y0"], cut["y0"]), F.least(area["y1"], cut["y1"])
    left, right = F.greatest(area["x0"], cut["x0"]), F.least(area["x1"], cut["x1"])
    pieces = F.array(
        box(area["y0"], area["x0"], top, area["x1"]), box(bottom, area["x0"], area["y1"], area["x1"]),
        box(top, area["x0"], bottom, left), box(top, right, bottom, area["x1"]),
    )
    kept = F.filter(pieces, lambda p: (p["y0"] < p["y1"]) & (p["x0"] < p["x1"]))
    return F.when(overlaps(area, cut), kept).otherwise(F.array(box(area["y0"], area["x0"], area["y1"], area["x1"])))


def subtract_all(areas: Column, cuts: Column) -> Column:
    """Areas without any of the cuts, folded over the cuts."""
    return F.aggregate(cuts, areas, lambda left, cut: F.flatten(F.transform(left, lambda a: subtract(a, cut))))


def covered(area: Column, rects: Column) -> Column:
    """Whether the rectangles cover the whole area."""
    return F.size(subtract_all(F.array(area), rects)) == 0


def touched_cells(df: DataFrame, step_y: int, step_x: int | None = None) -> DataFrame:
    """Rows with (row, col) of each grid cell that their rectangle touches, made a row of the grid at a time, without an array of all cells."""
    ends = [[F.floor(v / step).cast("long") for v in (F.col(f"{c}0"), F.col(f"{c}1") - 1)] for c, step in (("y", step_y), ("x", step_x or step_y))]
    return df.where("y0 < y1 AND x0 < x1").withColumn("row", F.explode(F.sequence(*ends[0]))).withColumn("col", F.explode(F.sequence(*ends[1])))


def overlap_join(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """Pairs of rows whose boxes overlap: an equi-join on a hierarchy of grids, each pair once.

    A box lies in the level whose cells (``bucket`` times a power of two) are about its size, so it touches a few of them however large it is;
    it also stands in the cells of those higher levels at which the other side has boxes. A pair meets at the higher of its
    levels, in the cell of the first corner that both touch. Columns of the left are prefixed with l_, of the right with r_.
    """
    def leveled(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(p + c) for c in df.columns])
        side = F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(1))
        return named.where((F.col(f"{p}y0") < F.col(f"{p}y1")) & (F.col(f"{p}x0") < F.col(f"{p}x1"))).withColumn(f"_{p}level", F.greatest(F.lit(0), F.ceil(F.log2(side / bucket))).cast("int"))

    def spread(df: DataFrame, p: str, others: list[int]) -> DataFrame:
        own = F.col(f"_{p}level")
        levels = F.array_union(F.array(own), F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > own))
        df = df.withColumn("_level", F.explode(levels)).withColumn("_size", F.expr(f"shiftleft(CAST({bucket} AS BIGINT), _level)"))
        for axis in "yx":
            ends = [F.expr(f"CAST(floor({c} / _size) AS BIGINT)") for c in (f"{p}{axis}0", f"({p}{axis}1 - 1)")]
            df = df.withColumn(f"_{axis}", F.explode(F.sequence(*ends)))
        return df

    a, b = leveled(left, "l_"), leveled(right, "r_")
    levels = [sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((a, "_l_level"), (b, "_r_level"))]  # powers of two: a few dozen at most
    pairs = spread(a, "l_", levels[1]).join(spread(b, "r_", levels[0]).drop("_size"), ["_level", "_y", "_x"])
    low = lambda c: F.floor(F.greatest(f"l_{c}", f"r_{c}") / F.col("_size"))
    hit = (F.col("l_y0") < F.col("r_y1")) & (F.col("r_y0") < F.col("l_y1")) & (F.col("l_x0") < F.col("r_x1")) & (F.col("r_x0") < F.col("l_x1"))
    meets = (F.col("_level") == F.greatest("_l_level", "_r_level")) & (F.col("_y") == low("y0")) & (F.col("_x") == low("x0"))
    return pairs.where(hit & meets).drop("_level", "_y", "_x", "_size", "_l_level", "_r_level")


def _runs(free: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Disjoint boxes of the free fields between edges: runs of free columns, as long as the rows below have the same."""
    open_, out = {}, []
    for r in range(len(ys)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free[r].astype(np.int8) if r < len(free) else np.zeros(len(xs) - 1, np.int8), [0]])))
        runs = {(int(xs[i]), int(xs[j])) for i, j in zip(edges[::2], edges[1::2])}
        out += [(open_.pop(k), k[0], int(ys[r]), k[1]) for k in [*open_] if k not in runs]
        for k in runs:
            open_.setdefault(k, int(ys[r]))
    return out


def _pieces(bucket: int) -> Callable[[pa.Table], pa.Table]:
    """Disjoint rectangles of a bucket's part of an area outside its cuts: runs of open columns, as long as the rows below have the same."""

    def apply(table: pa.Table) -> pa.Table:
        y0, x0, y1, x1, cut = (table.column(c).to_numpy() for c in (*BOX, "cut"))
        row, col, area = (table.column(c)[0].as_py() for c in ("row", "col", "rect_id"))
        own = np.flatnonzero(~cut)[0]
        top, low = max(row * bucket, y0[own]), max(col * bucket, x0[own])
        bottom, high = min((row + 1) * bucket, y1[own]), min((col + 1) * bucket, x1[own])
        y0, y1, x0, x1 = np.clip(y0[cut], top, bottom), np.clip(y1[cut], top, bottom), np.clip(x0[cut], low, high), np.clip(x1[cut], low, high)
        ys, xs = np.unique(np.concatenate([y0, y1, [top, bottom]])), np.unique(np.concatenate([x0, x1, [low, high]]))
        change = np.zeros((len(ys), len(xs)), np.int64)
        a, b, c, d = (np.searchsorted(s, v) for s, v in ((ys, y0), (ys, y1), (xs, x0), (xs, x1)))
        for at, sign in (((a, c), 1), ((b, d), 1), ((a, d), -1), ((b, c), -1)):
            np.add.at(change, at, sign)
        free = change.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] == 0
        out = _runs(free, ys, xs)
        return pa.table({"rect_id": pa.array([area] * len(out), pa.int64()), **{c: pa.array([p[i] for p in out], pa.int64()) for i, c in enumerate(BOX)}})

    return apply


def areas_less_cuts(areas: DataFrame, cuts: DataFrame, bucket: int) -> DataFrame:
    """(rect_id, box): disjoint pieces of areas (rect_id, box) outside all cuts (box), none beyond a cell of ``bucket`` pixels.

    A task takes an area's part in one cell with the cuts there, so an area of any size with any number of cuts is worked on in bounded parts.
    """
    wide = [F.col(c).cast("long").alias(c) for c in BOX]
    parts = touched_cells(areas.select(F.col("rect_id").cast("long").alias("rect_id"), *wide, F.lit(False).alias("cut")), bucket)
    here = touched_cells(cuts.select(*wide, F.lit(True).alias("cut")), bucket).distinct()
    met = parts.select("rect_id", "row", "col").join(here, ["row", "col"]).select("rect_id", *BOX, "cut", "row", "col")
    both = parts.select("rect_id", *BOX, "cut", "row", "col").unionByName(met)
    return both.groupBy("rect_id", "row", "col").applyInArrow(_pieces(bucket), "rect_id long, y0 long, x0 long, y1 long, x1 long")


#: Rectangles of a cell that one task lays over each other.
LAYERS = 50_000


def _visible(whole: bool) -> Callable[[pa.Table], pa.Table]:
    """The rectangles of a cell that are seen somewhere outside those of a smaller rank, whole or as disjoint pieces."""

    def apply(table: pa.Table) -> pa.Table:
        rank, y0, x0, y1, x1 = (table.column(c).to_numpy() for c in ("rank", *BOX))
        ys, xs = np.unique(np.concatenate([y0, y1])), np.unique(np.concatenate([x0, x1]))
        a, b, c, d = (np.searchsorted(s, v).tolist() for s, v in ((ys, y0), (ys, y1), (xs, x0), (xs, x1)))
        hidden = np.zeros((len(ys) - 1, len(xs) - 1), bool)
        order = np.argsort(rank, kind="stable")
        kept, boxes = [], []
        for same in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1):  # equal ranks don't hide each other
            same = same.tolist()
            for k in same:
                free = ~hidden[a[k] : b[k], c[k] : d[k]]
                if free.any():
                    found = [(y0[k], x0[k], y1[k], x1[k])] if whole else _runs(free, ys[a[k] : b[k] + 1], xs[c[k] : d[k] + 1])
                    kept += [k] * len(found)
                    boxes += found
            for k in same:
                hidden[a[k] : b[k], c[k] : d[k]] = True
            if hidden.all():
                break
        out = table.select([n for n in table.column_names if n not in BOX]).take(pa.array(kept, pa.int64()))
        for i, n in enumerate(BOX):
            out = out.append_column(n, pa.array([box_[i] for box_ in boxes], pa.int64()))
        return out.select(table.column_names)

    return apply


def uppermost(rects: DataFrame, bucket: int) -> DataFrame:
    """(region_id, box): disjoint pieces of rectangles (region_id, rank, box) outside all those of a smaller rank, none beyond a cell of ``bucket`` pixels.

    A cell's rectangles are dealt to tasks of about LAYERS; what stays hidden there is hidden, and what is left, in number at most the cell's
    pixels for each task, is laid over each other once more. No pairs of rectangles are made, however many overlap.
    """
    given = rects.select("region_id", F.col("rank").cast("long").alias("rank"), *[F.col(c).cast("long").alias(c) for c in BOX])
    cells = touched_cells(given, bucket)
    here = [F.greatest(f"{c}0", F.col(g) * bucket).alias(f"{c}0") for c, g in (("y", "row"), ("x", "col"))] + [F.least(f"{c}1", (F.col(g) + 1) * bucket).alias(f"{c}1") for c, g in (("y", "row"), ("x", "col"))]
    cells = cells.select("region_id", "rank", "row", "col", *here)
    parts = cells.groupBy("row", "col").agg(F.ceil(F.count("*") / LAYERS).alias("parts"))
    dealt = cells.join(parts, ["row", "col"]).withColumn("part", F.pmod(F.xxhash64("region_id"), F.col("parts")))
    dealt = dealt.select("region_id", "rank", "row", "col", "part", *BOX)
    some = dealt.groupBy("row", "col", "part").applyInArrow(_visible(True), dealt.schema)
    return some.groupBy("row", "col").applyInArrow(_visible(False), dealt.schema).select("region_id", *BOX)


def grid_cells(spark, height: int, width: int, step_y: int, step_x: int) -> DataFrame:
    """(row, col, y0, x0, y1, x1) of every cell, clipped at the edge."""
    rows, cols = -(-height // step_y), -(-width // step_x)
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    return cells.select("row", "col", (F.col("row") * step_y).alias("y0"), (F.col("col") * step_x).alias("x0"), F.least((F.col("row") + 1) * step_y, F.lit(height)).cast("long").alias("y1"), F.least((F.col("col") + 1) * step_x, F.lit(width)).cast("long").alias("x1"))


def grid_lines(spark, height: int, width: int, step_y: int, step_x: int) -> DataFrame:
    """(axis, at) of grid lines, with the closing edge also where the step doesn't divide the size."""
    out = None
    for axis, size, step in (("y", height, step_y), ("x", width, step_x)):
        if step <= 0:
            raise ValueError("grid steps must be positive")
        df = spark.range(-(-size // step) + 1).select(F.lit(axis).alias("axis"), F.least(F.col("id") * step, F.lit(size)).cast("long").alias("at"))
        out = df if out is None else out.unionByName(df)
    return out


#: Columns of cells that a task decides at once.
CELL_BLOCK = 64


def _block_coverage(step_y: int, step_x: int) -> Callable[[pa.Table], pa.Table]:
    """Which cells of a row's block its rectangles cover and touch, less those that cut, on the grid of all their edges."""

    def apply(table: pa.Table) -> pa.Table:
        row, first = (table.column(c)[0].as_py() for c in ("row", "first"))
        cut = table.column("cut").to_numpy()
        y0, x0, y1, x1, height, width = (table.column(c).to_numpy() for c in (*BOX, "height", "width"))
        top, bottom = row * step_y, min((row + 1) * step_y, height[0])
        edges = np.minimum(np.arange(first, first + CELL_BLOCK + 1) * step_x, width[0])
        edges = edges[: np.searchsorted(edges, width[0]) + 1]
        y0, y1, x0, x1 = (np.clip(v, *ends) for v, ends in ((y0, (top, bottom)), (y1, (top, bottom)), (x0, (edges[0], edges[-1])), (x1, (edges[0], edges[-1]))))
        ys, xs = np.unique(np.concatenate([y0, y1, [top, bottom]])), np.unique(np.concatenate([x0, x1, edges]))
        change = np.zeros((2, len(ys), len(xs)), np.int64)
        a, b, c, d = (np.searchsorted(s, v) for s, v in ((ys, y0), (ys, y1), (xs, x0), (xs, x1)))
        for at, sign in (((a, c), 1), ((b, d), 1), ((a, d), -1), ((b, c), -1)):
            np.add.at(change, (cut.astype(int), *at), sign)
        there = change.cumsum(axis=1).cumsum(axis=2)[:, :-1, :-1] > 0
        held = there[0] & ~there[1]
        cells = np.searchsorted(xs, edges[:-1])
        covered, touched = np.logical_and.reduceat(held.all(axis=0), cells), np.logical_or.reduceat(held.any(axis=0), cells)
        n = len(cells)
        return pa.table({"row": np.full(n, row), "col": first + np.arange(n), "covered": covered, "touched": touched})

    return apply


def cell_coverage(rects: DataFrame, height: int, width: int, step_y: int, step_x: int, cuts: DataFrame | None = None) -> DataFrame:
    """(row, col, covered, touched) of every grid cell by rectangles, less cuts; edges of rectangles decide, no pixel is scanned.

    A task sweeps one block of cells of a row over both sets at once, in time and memory that grow with their edges there, at most its
    pixels; no area is ever cut into pieces.
    """
    both = rects.select(*BOX, F.lit(False).alias("cut"))
    both = both if cuts is None else both.unionByName(cuts.select(*BOX, F.lit(True).alias("cut")))
    inside = both.select("cut", F.greatest("y0", F.lit(0)).alias("y0"), F.greatest("x0", F.lit(0)).alias("x0"), F.least("y1", F.lit(height)).alias("y1"), F.least("x1", F.lit(width)).alias("x1")).where("y0 < y1 AND x0 < x1")
    blocks = touched_cells(inside, step_y, step_x * CELL_BLOCK)
    dealt = blocks.select(*[F.col(c).cast("long").alias(c) for c in BOX], "cut", "row", (F.col("col") * CELL_BLOCK).alias("first"), F.lit(height).cast("long").alias("height"), F.lit(width).cast("long").alias("width")).distinct()
    found = dealt.groupBy("row", "first").applyInArrow(_block_coverage(step_y, step_x), "row long, col long, covered boolean, touched boolean")
    cells = grid_cells(rects.sparkSession, height, width, step_y, step_x).select("row", "col")
    no = F.lit(False)
    return cells.join(found, ["row", "col"], "left").select("row", "col", F.coalesce("covered", no).alias("covered"), F.coalesce("touched", no).alias("touched"))


def next_uncovered(coverage: DataFrame, columns: int, start: int) -> DataFrame:
    """The first cell not covered after a place in row-major order, going round."""
    index = F.col("row") * columns + F.col("col")
    return coverage.where("NOT covered").orderBy(F.when(index > start, 0).otherwise(1), index).limit(1).select("row", "col")


def visible_stride(pixels_per_cell: float) -> int | None:
    """Labels are drawn for each, each second or each fifth cell by their size on screen, or for none. Fixed values."""
    for least, stride in ((70, 1), (40, 2), (22, 5)):
        if pixels_per_cell >= least:
            return stride
    return None


def multiples(start: int, stop: int, stride: int) -> int:
    """How many multiples of a stride lie from start to stop, both included."""
    return max(0, stop // stride + (-start) // stride + 1) if stop >= start else 0


def visible_labels(spark, shape: tuple[int, int], step: tuple[int, int], center: tuple[float, float], viewport: tuple[float, float], zoom: float, scale: tuple[float, float] = (1.0, 1.0), most: int = 150) -> DataFrame:
    """(label, y, x) of the grid cells that are named in a viewport of screen pixels.

    The stride follows the size of a cell on screen and grows until no more than ``most`` labels are left.
    """
    empty = spark.createDataFrame([], "label string, y double, x double")
    if min(*shape, *step, *viewport, zoom, *(abs(s) for s in scale)) <= 0:
        return empty
    stride = visible_stride(min(n * abs(s) * zoom for n, s in zip(step, scale)))
    if stride is None:
        return empty
    ends = []
    for n, k, c, v, s in zip(shape, step, center, viewport, scale):
        half = v / (2 * zoom * abs(s))
        ends.append((max(0, math.floor((c - half) / k) - 1), min(-(-n // k) - 1, math.floor((c + half) / k) + 1)))
    while math.prod(multiples(a, b, stride) for a, b in ends) > most:
        stride += 1
    axes = []
    for name, (a, b), k, n in zip(("row", "col"), ends, step, shape):
        at = F.least(F.col(name) * k + k / 2, F.lit(n - 1.0))
        axes.append(spark.range(-(-a // stride) * stride, b + 1, stride).select(F.col("id").alias(name)).withColumn("y" if name == "row" else "x", at))
    return axes[0].join(F.broadcast(axes[1])).select(F.format_string("R%02dC%02d", "row", "col").alias("label"), "y", "x")  # ``most`` rows at most


def cell_box(row: int, col: int, shape: tuple[int, int], step: tuple[int, int]) -> tuple[int, int, int, int]:
    """The box of a grid cell, cut at the edges; a cell outside is an error."""
    if row < 0 or col < 0 or row * step[0] >= shape[0] or col * step[1] >= shape[1]:
        raise ValueError(f"there is no cell R{row:02d}C{col:02d}")
    return row * step[0], col * step[1], min((row + 1) * step[0], shape[0]), min((col + 1) * step[1], shape[1])
