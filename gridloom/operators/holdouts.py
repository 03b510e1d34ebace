"""Holdouts that last: what earlier runs held out for validation stays reserved when another dataset is prepared.

Earlier runs leave rectangles (patches they trained or validated on) and names of whole blocks they held out. Both become cells of
the patch grid, with the side they were on. Blocks of the new dataset that share an object are one group, in which a single side can be
taken: validation, if any block of it is held out now or touches a reserved cell. A group that touches cells of both sides can't be
judged without bias; it is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import connected_components
from gridloom.operators.rects import touched_cells

#: Parts a node's text from the next.
SEPARATOR = "\u0001"


def span(extent: Column, size: Column | int) -> Column:
    """Patches of a block on an axis: two where the axis has four or more, else one."""
    return F.when(F.ceil(extent / F.lit(size)) >= 4, 2).otherwise(1)


def held_out_rects(blocks: DataFrame) -> DataFrame:
    """(image_id, split, box) of whole blocks (image_id, block, crop, height, width) of earlier runs, each with its own crop; names that aren't row:column are left out."""
    named = blocks.where(F.col("block").rlike(r"^[0-9]+:[0-9]+$")).withColumn("_at", F.transform(F.split("block", ":"), lambda v: v.cast("long")))
    sides = {c: span(F.col(n), F.col("crop")) * F.col("crop") for c, n in (("y", "height"), ("x", "width"))}
    low = {c: F.col("_at")[k] * sides[c] for k, c in enumerate("yx")}
    high = {c: F.least(low[c] + sides[c], F.col(n)) for c, n in (("y", "height"), ("x", "width"))}
    return named.select("image_id", F.lit("validation").alias("split"), *[low[c].cast("long").alias(f"{c}0") for c in "yx"], *[high[c].cast("long").alias(f"{c}1") for c in "yx"])


def history_cells(rects: DataFrame, size: int) -> DataFrame:
    """(image_id, row, col, reserved, trained): cells of the patch grid that rectangles (image_id, split, box) of earlier runs touch; those without an image are left out."""
    inside = rects.where("image_id IS NOT NULL").select("image_id", "split", F.greatest("y0", F.lit(0)).alias("y0"), F.greatest("x0", F.lit(0)).alias("x0"), "y1", "x1")
    return touched_cells(inside, size).groupBy("image_id", "row", "col").agg(F.bool_or(F.col("split") == "validation").alias("reserved"), F.bool_or(F.col("split") != "validation").alias("trained"))


def node(block: str) -> Column:
    return F.concat(F.col("image_id").cast("string"), F.lit(SEPARATOR), F.col(block))


def keep_holdouts(patches: DataFrame, shared: DataFrame, cells: DataFrame, size: int, reserved_images: DataFrame | None = None) -> DataFrame:
    """(image_id, block, merged, split, kept, conflict) of the blocks of patches (image_id, block, y0, x0, split).

    shared: (image_id, u, w), blocks that share an object. reserved_images: (image_id) that an earlier run held out whole. ``kept`` tells
    a group that earlier runs reserve, ``conflict`` one that they trained on as well.
    """
    edges = shared.select(node("u").alias("u"), node("w").alias("w"))
    merged = connected_components(edges, "u", "w").select(F.col("node").alias("_node"), F.col("component").alias("_merged"))
    at = patches.select("image_id", "block", "split", F.floor(F.col("y0") / size).alias("row"), F.floor(F.col("x0") / size).alias("col"))
    at = at.join(cells, ["image_id", "row", "col"], "left")
    if reserved_images is not None:
        whole = reserved_images.select("image_id", F.lit(True).alias("_whole")).distinct()
        at = at.join(whole, "image_id", "left").withColumn("reserved", F.coalesce("reserved", F.lit(False)) | F.coalesce("_whole", F.lit(False)))
    held = at.groupBy("image_id", "block").agg(F.bool_or(F.col("split") == "validation").alias("now"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("reserved", "trained")])
    held = held.withColumn("_node", node("block")).join(merged, "_node", "left").withColumn("_merged", F.coalesce("_merged", "_node"))
    group = held.groupBy("_merged").agg(F.bool_or(F.col("now") | F.col("reserved")).alias("_held"), F.bool_or("reserved").alias("kept"), F.bool_or("trained").alias("_trained"))
    split = F.when(F.col("_held"), "validation").otherwise("train").alias("split")
    return held.join(group, "_merged").select("image_id", "block", F.element_at(F.split("_merged", SEPARATOR), 2).alias("merged"), split, "kept", (F.col("kept") & F.col("_trained")).alias("conflict"))


def seen_before(patches: DataFrame, cells: DataFrame, shapes: DataFrame, size: int) -> DataFrame:
    """(image_id, y0, x0) of validation patches in a block of which an earlier run trained on any cell. shapes: (image_id, height, width)."""
    trained = cells.where("trained").join(shapes, "image_id")
    blocks = trained.select("image_id", *[F.floor(F.col(c) / span(F.col(n), size)).alias(f"_{c}") for c, n in (("row", "height"), ("col", "width"))]).distinct()
    held = patches.where("split = 'validation'").join(shapes, "image_id")
    held = held.select("image_id", "y0", "x0", *[F.floor(F.col(c) / (span(F.col(n), size) * size)).alias(k) for k, c, n in (("_row", "y0", "height"), ("_col", "x0", "width"))])
    return held.join(blocks, ["image_id", "_row", "_col"], "left_semi").select("image_id", "y0", "x0")
