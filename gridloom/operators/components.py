"""Connected components of a mask: equal values that touch up, down, left or right.

Tiles are labelled first, each in one task; the graph then has a node for each tile's part of a component
that touches a seam, not for each pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.numbering import number_rows
from gridloom.operators.graph import connected_components, roots
from gridloom.plans.shared import dealt, few, materialize

#: Positions are y * STRIDE + x.
STRIDE = 1 << 32
#: Side of the tiles that a task labels: a million pixels at most.
TILE = 1024


def position(y: str = "y", x: str = "x") -> Column:
    return F.col(y) * STRIDE + F.col(x)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def label_tile(table: pa.Table) -> pa.Table:
    """(y, x, v, component) of a tile's pixels: the smallest position of those that touch it within the tile."""
    y, x, v = _columns(table, "y", "x", "v")
    at = y * STRIDE + x
    order = np.argsort(at)
    at, y, x, v = at[order], y[order], x[order], v[order]
    edges = []
    for step in (1, STRIDE):  # to the right, and down
        other = np.minimum(np.searchsorted(at, at + step), len(at) - 1)
        a = np.flatnonzero((at[other] == at + step) & (v[other] == v))
        edges.append((a, other[a]))
    (a, b), (c, d) = edges
    root = roots(len(at), np.concatenate([a, c]), np.concatenate([b, d]))
    return pa.table({"y": y, "x": x, "v": v, "component": at[root]})


def label_pixels(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """(y, x, v, component): component is the smallest position in it."""
    tiles = mask.where("v <> 0").select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))
    tiles = materialize(tiles.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)}), "component-mask")
    tiles = dealt(tiles, "ty", "tx").groupBy("ty", "tx").applyInArrow(label_tile, "y long, x long, v long, component long")
    pixels = materialize(tiles, "component-tiles")
    seams = None
    for c, o in ("yx", "xy"):
        side = lambda at: pixels.where(F.pmod(F.col(c), F.lit(tile)) == at)  # noqa: B023, E731
        before = side(tile - 1).select((F.col(c) + 1).alias(c), o, "v", F.col("component").alias("u"))
        met = before.join(side(0).select(c, o, "v", F.col("component").alias("w")), ["y", "x", "v"]).select("u", "w").distinct()
        seams = met if seams is None else seams.unionByName(met)
    moved = materialize(connected_components(seams, "u", "w").where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("_root")), "component-moved")
    return pixels.join(few(moved), "component", "left").select("y", "x", "v", F.coalesce("_root", "component").alias("component"))


def measure(pixels: DataFrame) -> DataFrame:
    """component, label, area, centroid and half-open box of labelled pixels."""
    return pixels.groupBy("component").agg(
        F.min("v").alias("label_value"), F.count("*").alias("area"),
        (F.sum("y") / F.count("*")).alias("centroid_y"), (F.sum("x") / F.count("*")).alias("centroid_x"),
        F.min("y").alias("bbox_y0"), F.min("x").alias("bbox_x0"), (F.max("y") + 1).alias("bbox_y1"), (F.max("x") + 1).alias("bbox_x1"),
    )


def component_table(pixels: DataFrame) -> DataFrame:
    """measure() with component_id, numbered by label, box corner and first position."""
    return number_rows(measure(pixels), ["label_value", "bbox_y0", "bbox_x0", "component"], "component_id")


def grid_address(df: DataFrame, step_y: float | None, step_x: float | None) -> DataFrame:
    """grid_row, grid_col and grid_id of the centroid; null without steps."""
    if step_y is None or step_x is None:
        return df.withColumns({"grid_row": F.lit(None).cast("long"), "grid_col": F.lit(None).cast("long"), "grid_id": F.lit(None).cast("string")})
    if step_y <= 0 or step_x <= 0:
        raise ValueError("grid steps must be positive")
    row, col = (F.greatest(F.floor(F.col(c) / s), F.lit(0)).cast("long") for c, s in (("centroid_y", step_y), ("centroid_x", step_x)))
    return df.withColumns({"grid_row": row, "grid_col": col}).withColumn("grid_id", F.format_string("R%02dC%02d", "grid_row", "grid_col"))


def euler_tile(table: pa.Table, tile: int) -> pa.Table:
    """(component, quarter): sums of the weights of the 2 x 2 windows that begin in a tile."""
    ty, tx, y, x, component = _columns(table, "ty", "tx", "y", "x", "component")
    wy, wx, bit, own = [], [], [], []
    for dy in (0, 1):
        for dx in (0, 1):
            inside = ((y - dy) // tile == ty) & ((x - dx) // tile == tx)
            wy.append((y - dy)[inside])
            wx.append((x - dx)[inside])
            own.append(component[inside])
            bit.append(np.full(inside.sum(), 1 << (2 * dy + dx)))
    wy, wx, bit, own = map(np.concatenate, (wy, wx, bit, own))
    order = np.lexsort((wx, wy, own))
    wy, wx, bit, own = wy[order], wx[order], bit[order], own[order]
    if not len(own):
        return pa.table({"component": own, "quarter": own})
    first = np.flatnonzero(np.concatenate([[True], (np.diff(wy) != 0) | (np.diff(wx) != 0) | (np.diff(own) != 0)]))
    weight = np.zeros(16, np.int64)
    weight[[1, 2, 4, 8]], weight[[7, 11, 13, 14]], weight[[6, 9]] = 1, -1, -2
    ids, place = np.unique(own[first], return_inverse=True)
    return pa.table({"component": ids, "quarter": np.bincount(place, weight[np.add.reduceat(bit, first)]).astype(np.int64)})


def euler(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(component, euler): 8-connected Euler number of each component, from the weights of all 2 x 2 windows.

    A window with one pixel of the component counts 1, with three -1, with two on a diagonal -2; the sum is four times the
    number. A pixel goes to the tiles in which its four windows begin: to one, but for those on seams.
    """
    owners = F.array_distinct(F.array(*[F.struct(F.floor((F.col("y") - dy) / tile).alias("ty"), F.floor((F.col("x") - dx) / tile).alias("tx")) for dy in (0, 1) for dx in (0, 1)]))
    windows = pixels.select("y", "x", "component", F.explode(owners).alias("t")).select("t.ty", "t.tx", "y", "x", "component")
    rows = pixels.count()
    parts = dealt(windows, "ty", "tx", rows=rows).groupBy("ty", "tx").applyInArrow(lambda table: euler_tile(table, tile), "component long, quarter long")
    return dealt(parts, "component", rows=rows).groupBy("component").agg((F.sum("quarter") / 4).cast("long").alias("euler"))


def delete_components(pixels: DataFrame, ids: DataFrame) -> DataFrame:
    """Pixels of components that are not in ids(component)."""
    return pixels.join(ids.select("component"), "component", "left_anti")


def small_components(table: DataFrame, threshold: int = 2) -> DataFrame:
    return table.where(F.col("area") < threshold)


def copy_components(pixels: DataFrame, ids: DataFrame, target: DataFrame, dy: int = 0, dx: int = 0) -> DataFrame:
    """Target mask (y, x, v) with the named components written over it, moved by an integer offset."""
    source = pixels.join(ids.select("component"), "component", "left_semi").select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("v").alias("source_v"))
    return target.join(source, ["y", "x"], "full").select("y", "x", F.coalesce("source_v", "v").alias("v"))


def _row_digest() -> Column:
    return F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("x")), lambda x: x.cast("string"))), 256)


def _digest_of_rows() -> Column:
    return F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("y", "d"))), lambda s: F.concat_ws(":", s["y"].cast("string"), s["d"]))), 256)


def fingerprints(pixels: DataFrame) -> DataFrame:
    """(component, fingerprint): digest of the footprint, by rows of digests so that no component is held whole."""
    rows = pixels.groupBy("component", "y").agg(_row_digest().alias("d"))
    return rows.groupBy("component").agg(_digest_of_rows().alias("fingerprint"))


def footprints(pixels: DataFrame) -> DataFrame:
    """measure() with the fingerprint, both from the rows of each component: pixels that lie together by component are dealt no more."""
    rows = pixels.groupBy("component", "y").agg(F.min("v").alias("v"), F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("x0"), F.max("x").alias("x1"), _row_digest().alias("d"))
    return rows.groupBy("component").agg(
        F.min("v").alias("label_value"), F.sum("n").alias("area"),
        (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("centroid_y"), (F.sum("s") / F.sum("n")).alias("centroid_x"),
        F.min("y").alias("bbox_y0"), F.min("x0").alias("bbox_x0"), (F.max("y") + 1).alias("bbox_y1"), (F.max("x1") + 1).alias("bbox_x1"), _digest_of_rows().alias("fingerprint"),
    )


KEY = ["label_value", "area", "bbox_y0", "bbox_x0", "bbox_y1", "bbox_x1"]


def restore_selection(table: DataFrame, saved: DataFrame, context: str | None = None) -> DataFrame:
    """Saved rows (six-part key, fingerprint) with the component they name, and whether they were restored.

    The key must name exactly one component, and its footprint must be the same. With the context (shape and transform) of the
    mask, rows whose own ``context`` is another one aren't restored, whatever they hold.
    """
    found = table.withColumn("_twins", F.count("*").over(W.partitionBy(*KEY))).where("_twins = 1").select(*KEY, "component", F.col("fingerprint").alias("_now"))
    both = saved.join(found, KEY, "left")
    ok = F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False))
    if context is not None:
        ok = ok & F.col("context").eqNullSafe(F.lit(context))
    return both.select(*KEY, F.when(ok, F.col("component")).alias("component"), ok.alias("restored"))


def restore_deleted(current: DataFrame, deleted: DataFrame) -> DataFrame:
    """(y, x, v, restored) of deleted pixels: restored only where the mask is still empty."""
    now = current.select("y", "x", F.col("v").alias("_now"))
    return deleted.join(now, ["y", "x"], "left").select("y", "x", "v", F.col("_now").isNull().alias("restored"))


def grayscale_windows(pixels: DataFrame, size: int = 256, most: int = 64) -> DataFrame:
    """(wy, wx, n_values, looks_gray) of sample windows: more distinct values than labels have mean an image."""
    windows = pixels.groupBy(F.floor(F.col("y") / size).cast("long").alias("wy"), F.floor(F.col("x") / size).cast("long").alias("wx"))
    return windows.agg(F.countDistinct("value").alias("n_values")).withColumn("looks_gray", F.col("n_values") > most)


def component_at(pixels: DataFrame, points: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """points(y, x) with the component there; null on background, outside and for deleted ones."""
    found = pixels if deleted is None else delete_components(pixels, deleted)
    return points.join(found.select("y", "x", "component"), ["y", "x"], "left")


def component_tiles(pixels: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(ty, tx, component, pixels) of the tiles that hold the components named."""
    held = pixels.join(ids.select("component").distinct(), "component", "left_semi")
    return held.groupBy(F.floor(F.col("y") / size).cast("long").alias("ty"), F.floor(F.col("x") / size).cast("long").alias("tx"), "component").agg(F.count("*").alias("pixels"))


def page(table: DataFrame, number: int, rows: int = 1000) -> DataFrame:
    """One page of a numbered component table."""
    first = number * rows + 1
    return table.where((F.col("component_id") >= first) & (F.col("component_id") < first + rows))


def toggle(selection: DataFrame, picked: DataFrame) -> DataFrame:
    """A selection (component) with the picked ones switched: in or out."""
    a, b = selection.select("component").distinct(), picked.select("component").distinct()
    return a.join(b, "component", "left_anti").unionByName(b.join(a, "component", "left_anti"))


def outline_boxes(table: DataFrame) -> DataFrame:
    """Boxes moved by half a pixel, as they are drawn."""
    return table.select("component", *[(F.col(f"bbox_{c}") - 0.5).alias(c) for c in ("y0", "x0", "y1", "x1")])


def active_records(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Records that aren't deleted, by component_id."""
    return table.join(deleted.select("component_id").distinct(), "component_id", "left_anti").orderBy("component_id")


def component_mask(pixels: DataFrame, component: int, bounds: tuple[int, int, int, int]) -> DataFrame:
    """(y, x) of a component's pixels within a window, counted from its corner."""
    y0, x0, y1, x1 = bounds
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return pixels.where((F.col("component") == component) & inside).select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"))


def deletion_counts(pixels: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: components found of those named, and pixels that deleting them changes."""
    held = pixels.join(ids.select("component").distinct(), "component", "left_semi")
    return held.agg(F.countDistinct("component").alias("components"), F.count("*").alias("changed"))


def checked_copy(pixels: DataFrame, ids: DataFrame, target: DataFrame, shape: tuple[int, int], limits: tuple[int, int], dy: int = 0, dx: int = 0) -> DataFrame:
    """copy_components() into a target of a shape and a range of ids; what doesn't fit fails the query."""
    y, x = F.col("y") + dy, F.col("x") + dx
    outside = (y < 0) | (x < 0) | (y >= shape[0]) | (x >= shape[1])
    wide = (F.col("v") < limits[0]) | (F.col("v") > limits[1])
    v = F.when(outside, F.raise_error(F.lit("a component lies outside the destination"))).when(wide, F.raise_error(F.lit("a label is out of the destination's range"))).otherwise(F.col("v"))
    return copy_components(pixels.join(ids.select("component").distinct(), "component", "left_semi").withColumn("v", v), ids, target, dy, dx)


def matching_destination(target: DataFrame, shape: tuple[int, int], dy: int, dx: int) -> DataFrame:
    """A destination of the source's shape that keeps what of the old one overlaps it, moved by an integer offset."""
    y, x = F.col("y") - dy, F.col("x") - dx
    return target.select(y.alias("y"), x.alias("x"), "v").where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < shape[0]) & (F.col("x") < shape[1]))


def copy_work(pixels: DataFrame, ids: DataFrame, size: int, dy: int = 0, dx: int = 0) -> DataFrame:
    """(ty, tx, y0, x0, y1, x1, pixels): tiles of the destination that a copy writes, with the box of what it writes there."""
    held = pixels.join(ids.select("component").distinct(), "component", "left_semi").select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
    tiles = held.groupBy(F.floor(F.col("y") / size).cast("long").alias("ty"), F.floor(F.col("x") / size).cast("long").alias("tx"))
    return tiles.agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"), F.count("*").alias("pixels"))


def copy_tiles(target: DataFrame, source: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """The target (y, x, v) after a copy that was stopped: only tiles named as done (ty, tx) are written over."""
    part = source.withColumn("ty", F.floor(F.col("y") / size).cast("long")).withColumn("tx", F.floor(F.col("x") / size).cast("long")).join(done.select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
    return target.join(part.select("y", "x", F.col("v").alias("_new")), ["y", "x"], "full").select("y", "x", F.coalesce("_new", "v").alias("v"))


def selection_states(picks: DataFrame, most: int = 20) -> DataFrame:
    """(user, component) of each user's selection after their picks (user, seq, action, component).

    replace keeps the pick alone, toggle switches it, clear keeps none; undo takes back the last change that isn't
    taken back yet, of the last ``most`` ones.
    """
    def step(state, e):
        sets, now = state["history"], F.element_at(state["history"], -1)["ids"]
        one = F.array(e["component"])
        changed = F.when(e["action"] == "replace", one).when(e["action"] == "clear", F.array().cast("array<long>"))
        changed = changed.when(F.array_contains(now, e["component"]), F.array_remove(now, e["component"])).otherwise(F.concat(now, one))
        longer = F.concat(sets, F.array(F.struct(changed.alias("ids"))))
        kept = F.slice(longer, F.greatest(F.size(longer) - most, F.lit(1)), most + 1)
        back = F.when(F.size(sets) > 1, F.slice(sets, F.lit(1), F.greatest(F.size(sets) - 1, F.lit(1)))).otherwise(sets)
        return F.struct(F.when(e["action"] == "undo", back).otherwise(kept).alias("history"))

    empty = F.expr("named_struct('history', array(named_struct('ids', cast(array() as array<bigint>))))")
    events = picks.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("seq", "action", F.col("component").cast("long").alias("component")))).alias("events"))
    last = F.aggregate("events", empty, step)["history"]
    return events.select("user", F.explode(F.element_at(last, -1)["ids"]).alias("component"))


def grayscale_verdict(pixels: DataFrame, height: int, width: int, size: int = 256, most: int = 64) -> DataFrame:
    """One row, looks_gray: whether one of five windows, in the corners and the middle, holds more distinct values than labels have."""
    h, w = min(size, height), min(size, width)
    corners = {(0, 0), (0, width - w), (height - h, 0), (height - h, width - w), ((height - h) // 2, (width - w) // 2)}
    windows = F.array_compact(F.array(*[F.when((F.col("y") >= y) & (F.col("y") < y + h) & (F.col("x") >= x) & (F.col("x") < x + w), k) for k, (y, x) in enumerate(sorted(corners))]))
    held = pixels.select("value", F.explode(windows).alias("window")).groupBy("window").agg(F.countDistinct("value").alias("n"))
    return held.agg(F.coalesce(F.max("n") > most, F.lit(False)).alias("looks_gray"))


def world_position(table: DataFrame, affine) -> DataFrame:
    """component with the world coordinates (wy, wx) of its centroid under a 3 x 3 affine."""
    at = lambda k: F.lit(float(affine[k][0])) * F.col("centroid_y") + F.lit(float(affine[k][1])) * F.col("centroid_x") + F.lit(float(affine[k][2]))
    return table.select("component", at(0).alias("wy"), at(1).alias("wx"))


def final_ids(local: DataFrame, table: DataFrame) -> DataFrame:
    """Tile pixels (y, x, component) with the component_id of the global table."""
    return local.join(table.select("component", "component_id"), "component").select("y", "x", "component_id")
