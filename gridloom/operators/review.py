"""Review of an image in rectangles: approval, invalidation by edits, the state of cells, and what review writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.rects import BOX, areas_less_cuts, cell_coverage, overlap_join, overlaps, subtract_all, touched_cells, uppermost
from gridloom.plans.shared import materialize

RECTS = "array<struct<y0:bigint,x0:bigint,y1:bigint,x1:bigint>>"


def _appended(rects: Column, rect: Column) -> Column:
    return F.when(F.array_contains(rects, rect), rects).otherwise(F.array_append(rects, rect))


def _after(state: Column, event: Column) -> Column:
    """The state (areas, invalid, cells) after one event."""
    rect = F.struct(*[event[c].alias(c) for c in BOX])
    areas, invalid, cells, action = state["areas"], state["invalid"], state["cells"], event["action"]
    one = F.array(rect)
    touched = F.filter(cells, lambda c: overlaps(c, rect))
    return F.struct(
        F.when(action == "approve", _appended(areas, rect)).when(action == "revoke", subtract_all(areas, one)).otherwise(subtract_all(areas, touched)).alias("areas"),
        F.when(action == "approve", subtract_all(invalid, one)).when(action == "revoke", invalid).otherwise(F.array_union(invalid, touched)).alias("invalid"),
        F.when(action == "approve", _appended(cells, rect)).when(action == "revoke", subtract_all(cells, one)).otherwise(cells).alias("cells"),
    )


def review_states(events: DataFrame) -> DataFrame:
    """(mask, areas, invalid, cells) after events (mask, seq, action, box) in order.

    approve adds a rectangle to the areas and the review cells and takes it from the invalid ones; revoke takes it from
    areas and cells; edit takes every review cell that it touches, whole, from the areas and remembers it
    as invalid once. A mask's events are metadata: one row holds them.
    """
    box = [F.col(c).cast("long").alias(c) for c in BOX]
    ordered = events.where(F.col("action").isin("approve", "revoke", "edit")).groupBy("mask").agg(F.array_sort(F.collect_list(F.struct("seq", "action", *box))).alias("events"))
    empty = F.struct(*[F.array().cast(RECTS).alias(c) for c in ("areas", "invalid", "cells")])
    return ordered.select("mask", F.aggregate("events", empty, _after).alias("s")).select("mask", "s.*")


def covered_pixels(rows: DataFrame, rects: str, *keys: str) -> DataFrame:
    """(keys, pixels): how many pixels lie in any rectangle of a row's array; without pixels there is no row. Keys name rows.

    Between two edges along y a band has the same intervals of x throughout, so arrays' lengths alone decide the work, not the pixels.
    """
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(rects, lambda r: F.array(r["y0"], r["y1"])))))
    bands = rows.select(*keys, rects, F.explode(F.arrays_zip(edges.alias("y0"), F.slice(edges, 2, 1 << 30).alias("y1"))).alias("_b"))
    inside = F.filter(rects, lambda r: (r["y0"] <= F.col("_b.y0")) & (r["y1"] >= F.col("_b.y1")) & (r["x0"] < r["x1"]))
    runs = F.array_sort(F.transform(inside, lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"))))
    none = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    longer = lambda s, r: F.struct(F.greatest(s["end"], r["x1"]).alias("end"), (s["n"] + F.greatest(r["x1"] - F.greatest(r["x0"], s["end"]), F.lit(0))).cast("long").alias("n"))
    wide = bands.where("_b.y1 IS NOT NULL").select(*keys, ((F.col("_b.y1") - F.col("_b.y0")) * F.aggregate(runs, none, longer)["n"]).alias("_n"))
    return wide.groupBy(*keys).agg(F.sum("_n").alias("pixels")).where("pixels > 0")


def effective_areas(areas: DataFrame, cuts: DataFrame, bucket: int) -> DataFrame:
    """Pieces of areas (rect_id, box) outside all cuts (box), as cutting one after the other leaves them; an area's cuts are folded in one row, so many of them need areas_less_cuts()."""
    met = overlap_join(areas, cuts.select(*BOX), bucket).groupBy("l_rect_id").agg(F.collect_set(F.struct(*[F.col(f"r_{c}").alias(c) for c in BOX])).alias("cuts"))
    own = areas.join(met, F.col("rect_id") == F.col("l_rect_id"), "left")
    left = subtract_all(F.array(F.struct(*[F.col(c).cast("long").alias(c) for c in BOX])), F.coalesce("cuts", F.array().cast(RECTS)))
    return own.select("rect_id", F.explode(left).alias("p")).select("rect_id", "p.*")


def cell_states(areas: DataFrame, invalid: DataFrame, used: DataFrame, shape: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """(row, col, status, training) of every grid cell.

    stale if an invalid rectangle touches it, else confirmed if the areas without invalid ones cover it, else not;
    training use is full, part or none by the rectangles trained on.
    """
    confirmed = cell_coverage(areas, *shape, *step, cuts=invalid).select("row", "col", F.col("covered").alias("_ok"))
    stale = cell_coverage(invalid, *shape, *step).select("row", "col", F.col("touched").alias("_stale"))
    seen = cell_coverage(used, *shape, *step).withColumnsRenamed({"covered": "_full", "touched": "_part"})
    status = F.when(F.col("_stale"), "stale").when(F.col("_ok"), "confirmed").otherwise("not")
    training = F.when(F.col("_full"), "full").when(F.col("_part"), "part").otherwise("none")
    return confirmed.join(stale, ["row", "col"]).join(seen, ["row", "col"]).select("row", "col", status.alias("status"), training.alias("training"))


def _inside(box: tuple[int, int, int, int]) -> Column:
    y0, x0, y1, x1 = box
    return (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)


def write_area(mask: DataFrame, box: tuple[int, int, int, int], value: int) -> DataFrame:
    """A mask with one value in a box; 0 empties it."""
    rest = mask.where(~_inside(box)).select("y", "x", "v")
    y0, x0, y1, x1 = box
    if not value or y0 >= y1 or x0 >= x1:
        return rest
    width = x1 - x0
    filled = mask.sparkSession.range((y1 - y0) * width).select((F.floor(F.col("id") / width) + y0).cast("long").alias("y"), (F.col("id") % width + x0).alias("x"), F.lit(value).cast("long").alias("v"))
    return rest.unionByName(filled)


def merge_trusted(annotations: DataFrame, truth: DataFrame, box: tuple[int, int, int, int], approved: bool = True) -> DataFrame:
    """Binary annotations (y, x, v) with the truth's foreground in a box when it is approved, and nothing there when it is revoked."""
    rest = annotations.where(~_inside(box)).select("y", "x", "v")
    if not approved:
        return rest
    return rest.unionByName(truth.where(_inside(box) & (F.col("v") > 0)).select("y", "x", F.lit(1).cast("long").alias("v")))


def preview(truth: DataFrame, coverage: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Labels of a box where it is covered."""
    return truth.where(_inside(box)).join(coverage.where("v <> 0").select("y", "x").distinct(), ["y", "x"], "left_semi").select("y", "x", "v")


def restrict_to(valid: DataFrame, regions: DataFrame, bucket: int = 512) -> DataFrame:
    """Valid pixels (y, x) inside any of a batch's regions; a batch without regions supervises nothing."""
    points = valid.select("y", "x").distinct().select(F.col("y").alias("y0"), F.col("x").alias("x0"), (F.col("y") + 1).alias("y1"), (F.col("x") + 1).alias("x1"))
    return overlap_join(points, regions.select(*BOX), bucket).select(F.col("l_y0").alias("y"), F.col("l_x0").alias("x")).distinct()


def display_regions(regions: DataFrame, areas: DataFrame, bucket: int) -> DataFrame:
    """(region_id, ready, box) of what is drawn of regions (region_id, rank, box): each without those of a smaller rank.

    Ranks put the active batch first, then newer batches before older ones. A region is ready if areas cover it. Both are decided in
    cells of ``bucket`` pixels, so the work grows with the regions and areas, not with the pairs that overlap.
    """
    drawn = materialize(uppermost(regions, bucket), "drawn-regions")
    shown = regions.select("region_id", *[F.col(c).cast("long").alias(c) for c in BOX]).join(drawn.select("region_id").distinct(), "region_id", "left_semi")
    parts = touched_cells(shown, bucket).select("region_id", "row", "col", *[F.col(c).alias(f"_{c}") for c in BOX])
    cell = [(F.col("row") * bucket).alias("y0"), (F.col("col") * bucket).alias("x0"), ((F.col("row") + 1) * bucket).alias("y1"), ((F.col("col") + 1) * bucket).alias("x1")]
    cells = parts.select("row", "col").distinct().select(F.xxhash64("row", "col").alias("rect_id"), *cell)
    gaps = areas_less_cuts(cells, areas.select(*BOX).distinct(), bucket).withColumns({"row": F.floor(F.col("y0") / bucket), "col": F.floor(F.col("x0") / bucket)})
    meets = (F.col("_y0") < F.col("y1")) & (F.col("y0") < F.col("_y1")) & (F.col("_x0") < F.col("x1")) & (F.col("x0") < F.col("_x1"))
    open_ = parts.join(gaps.select("row", "col", *BOX), ["row", "col"]).where(meets).select("region_id").distinct().withColumn("_open", F.lit(True))
    return drawn.join(open_, "region_id", "left").select("region_id", F.col("_open").isNull().alias("ready"), *BOX)
