"""Pyramids of labels and intensities over sparse rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_shapes(height: int, width: int, most: int = 7) -> list[tuple[int, int]]:
    """Level k has each side divided by 2 ** k, rounded up; the last one is of one pixel, or the last of so many."""
    levels = min(most, 1 + max(height - 1, width - 1, 0).bit_length())
    return [(math.ceil(height / 2**k), math.ceil(width / 2**k)) for k in range(levels)]


def halve_labels(mask: DataFrame) -> DataFrame:
    """The first label of each 2 x 2 block in reading order; labels are never mixed."""
    half = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in "yx"]
    return mask.where("v <> 0").groupBy(*half).agg(F.min_by("v", (F.col("y") % 2) * 2 + F.col("x") % 2).alias("v"))


def label_pyramid(mask: DataFrame, levels: int) -> DataFrame:
    """(level, y, x, v)."""
    out = mask.where("v <> 0").select(F.lit(0).cast("long").alias("level"), "y", "x", "v")
    now = mask
    for k in range(1, levels):
        now = halve_labels(now)
        out = out.unionByName(now.select(F.lit(k).cast("long").alias("level"), "y", "x", "v"))
    return out


def halve_image(pixels: DataFrame, height: int, width: int, limits: tuple[int, int] | None = None) -> DataFrame:
    """Mean of each 2 x 2 block of a dense image; odd edges are doubled; with the limits of an integer type it is rounded half to even and cut to them."""
    copies = lambda c, n: F.when((F.lit(n % 2) == 1) & (F.col(c) == n - 1), 2).otherwise(1)
    weight = copies("y", height) * copies("x", width)
    half = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in "yx"]
    mean = F.sum(F.col("value") * weight) / F.sum(weight)
    if limits is not None:
        mean = F.least(F.greatest(F.rint(mean), F.lit(float(limits[0]))), F.lit(float(limits[1])))
    return pixels.groupBy(*half).agg(mean.alias("value"))


def needs_image_pyramid(height: int, width: int, axis: int = 32_768) -> bool:
    return max(height, width) > axis


def image_pyramid(pixels: DataFrame, height: int, width: int, limits: tuple[int, int] | None = None, axis: int = 2048) -> DataFrame:
    """(level, y, x, value): each level halves the one before, until no side is above ``axis``."""
    out, now, level = pixels.select(F.lit(0).cast("long").alias("level"), "y", "x", "value"), pixels, 0
    while max(height, width) > axis:
        now, level = halve_image(now, height, width, limits), level + 1
        height, width = -(-height // 2), -(-width // 2)
        out = out.unionByName(now.select(F.lit(level).cast("long").alias("level"), "y", "x", "value"))
    return out


def level_problems(levels: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(level, problem) of stored levels (level, y, x, ...): levels that are missing, unknown, or have pixels outside their shape."""
    known = levels.sparkSession.createDataFrame([(k, h, w) for k, (h, w) in enumerate(shapes)], "level long, h long, w long")
    held = levels.groupBy("level").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    both = held.join(known, "level", "full")
    problem = F.when(F.col("h").isNull(), "unknown level").when(F.col("y0").isNull(), "missing level").when((F.col("y0") < 0) | (F.col("x0") < 0) | (F.col("y1") >= F.col("h")) | (F.col("x1") >= F.col("w")), "pixels outside")
    return both.select("level", problem.alias("problem")).where("problem IS NOT NULL")


def overview_without(levels: DataFrame, level: int, window: tuple[int, int, int, int]) -> DataFrame:
    """A level with the pixels of an edit window (in full pixels) left out, as the editor draws them itself."""
    n = 1 << level
    y0, x0, y1, x1 = window[0] // n, window[1] // n, -(-window[2] // n), -(-window[3] // n)
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return levels.where((F.col("level") == level) & ~inside)


def shown_scale(shapes: list[tuple[int, int]], level: int) -> tuple[float, float]:
    """Full pixels of a pixel of a level on both axes, by which its transform is scaled."""
    return shapes[0][0] / shapes[level][0], shapes[0][1] / shapes[level][1]


def refresh_pyramid(mask: DataFrame, levels: DataFrame, rects: DataFrame, most: int) -> DataFrame:
    """All levels (level, y, x, v) after edits within rectangles: each is computed anew only in its part of their bounding box."""
    box = rects.agg(F.min("y0"), F.min("x0"), F.max("y1"), F.max("x1")).first()
    if box[0] is None:
        return levels
    y0, x0, y1, x1 = box
    now, out = mask.where("v <> 0").select("y", "x", "v"), mask.where("v <> 0").select(F.lit(0).cast("long").alias("level"), "y", "x", "v")
    for k in range(1, most):
        old = levels.where(F.col("level") == k).select("y", "x", "v")
        now = rebuild(now, old, (y0, x0, y1, x1))
        y0, x0, y1, x1 = y0 // 2, x0 // 2, -(-y1 // 2), -(-x1 // 2)
        out = out.unionByName(now.select(F.lit(k).cast("long").alias("level"), "y", "x", "v"))
    return out


def rebuild(mask: DataFrame, old_level: DataFrame, dirty: tuple[int, int, int, int]) -> DataFrame:
    """One halved level, computed anew only within a dirty rectangle of the level above."""
    y0, x0, y1, x1 = dirty[0] // 2, dirty[1] // 2, -(-dirty[2] // 2), -(-dirty[3] // 2)
    within = lambda df, a, b, c, d: df.where((F.col("y") >= a) & (F.col("y") < c) & (F.col("x") >= b) & (F.col("x") < d))
    new = halve_labels(within(mask, 2 * y0, 2 * x0, 2 * y1, 2 * x1))
    outside = (F.col("y") < y0) | (F.col("y") >= y1) | (F.col("x") < x0) | (F.col("x") >= x1)
    return old_level.where(outside).unionByName(new.select(*old_level.columns))


def plan_overview(shapes: list[tuple[int, int]], axis: int = 4096, pixels: int = 1 << 24, size: int = 64 << 20, bytes_per_pixel: int = 4) -> int | None:
    """The first level small enough to show whole."""
    for k, (h, w) in enumerate(shapes):
        if max(h, w) <= axis and h * w <= pixels and h * w * bytes_per_pixel <= size:
            return k
    return None
