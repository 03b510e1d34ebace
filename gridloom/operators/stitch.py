"""Tiled inference: overlapping tiles scored by a pluggable function and blended by a ramp."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scorers by name: a function of a float image that returns an image of probabilities.
SCORERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def register_scorer(name: str, scorer: Callable[[np.ndarray], np.ndarray]) -> None:
    if name in SCORERS:
        raise ValueError(f"scorer {name} is registered already")
    SCORERS[name] = scorer


def tile_range(size: int, tile: int, low: int, high: int) -> tuple[range, int]:
    """Starts of all tiles but the last, and of the last one."""
    tile = min(tile, size)
    first = min(low, size - tile)
    last = max(first, min(high - tile, size - tile))
    return range(first, last, max(1, tile * 3 // 4)), last


def tile_starts(size: int, tile: int, low: int = 0, high: int | None = None) -> list[int]:
    """Starts of tiles that cover low to high on an axis, at three quarters of a tile, the last one moved back to the edge; a tile is no longer than the axis."""
    regular, last = tile_range(size, tile, low, size if high is None else high)
    return [*regular, last]


def ramp(at: Column, tile: int) -> Column:
    """Raised cosine from edge to edge with a floor of 0.05."""
    return F.greatest(0.5 - 0.5 * F.cos(2 * math.pi * at / (tile - 1)) if tile > 1 else F.lit(1.0), F.lit(0.05))


def tiles_of(pixels: DataFrame, height: int, width: int, tile: int, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels in each tile that holds them: (ty, tx, y, x, value), ty and tx the tile's corner."""
    y0, x0, y1, x1 = bounds or (0, 0, height, width)

    def corners(c: str, size: int, low: int, high: int) -> Column:
        regular, last = tile_range(size, tile, low, high)
        at, none = F.col(c).cast("long"), F.array().cast("array<bigint>")
        # places of the two or three regular tiles around a pixel, however long the axis
        a = F.greatest(F.ceil((at - tile + 1 - regular.start) / regular.step), F.lit(0)).cast("long")
        b = F.least(F.floor((at - regular.start) / regular.step), F.lit(len(regular) - 1)).cast("long")
        around = F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda k: k * regular.step + regular.start)).otherwise(none)
        end = F.when((at >= last) & (at < last + tile), F.array(F.lit(last).cast("long"))).otherwise(none)
        return F.explode(F.concat(around, end)).alias(f"t{c}")

    picks = [corners("y", height, y0, y1), corners("x", width, x0, x1)]
    return pixels.select("y", "x", "value", picks[0]).select("y", "x", "value", "ty", picks[1])


def blend(scored: DataFrame, tile: int) -> DataFrame:
    """(y, x, p): weighted mean of the tiles' scores (ty, tx, y, x, p)."""
    weight = ramp(F.col("y") - F.col("ty"), tile) * ramp(F.col("x") - F.col("tx"), tile)
    return scored.withColumn("_w", weight).groupBy("y", "x").agg((F.sum(F.col("p") * F.col("_w")) / F.sum("_w")).alias("p"))


def normalized(image: np.ndarray) -> np.ndarray:
    """Scaled so that the 1st and 99th percentile become 0 and 1, and cut there."""
    low, high = np.percentile(image, (1, 99))
    return np.clip((image - low) / max(high - low, 1e-6), 0, 1)


def resized(image: np.ndarray, side: int) -> np.ndarray:
    """Area mean to fewer pixels, nearest pixel to more, along both axes."""
    for axis in (0, 1):
        n = image.shape[axis]
        if side < n:
            edges = np.linspace(0, n, side + 1).astype(int)
            image = np.add.reduceat(image, edges[:-1], axis=axis) / np.diff(edges).reshape([-1, 1] if axis == 0 else [1, -1])
        elif side > n:
            image = np.take(image, np.minimum(((np.arange(side) + 0.5) * n / side).astype(int), n - 1), axis=axis)
    return image


def predict(pixels: DataFrame, height: int, width: int, tile: int, scorer: str, bounds: tuple[int, int, int, int] | None = None, input_pixels: int | None = None, prepare: bool = True) -> DataFrame:
    """(y, x, p) of a dense image, or of the box that bounds it, by a registered scorer; a task holds one tile.

    A tile is no larger than the image. With ``prepare`` it is normalised; it is brought to the scorer's input size and
    back if that is given. Scores are cut to 0 to 1.
    """
    run, tile = SCORERS[scorer], min(tile, height, width)
    if bounds is not None:
        y0, x0, y1, x1 = max(0, bounds[0]), max(0, bounds[1]), min(height, bounds[2]), min(width, bounds[3])
        if y0 >= y1 or x0 >= x1:
            raise ValueError("the box doesn't overlap the image")
        bounds = (y0, x0, y1, x1)

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((tile, tile))
        dy, dx = (frame["y"] - frame["ty"]).to_numpy(), (frame["x"] - frame["tx"]).to_numpy()
        image[dy, dx] = frame["value"]
        image = normalized(image) if prepare else image
        if input_pixels is not None:
            image = resized(image, input_pixels)
        p = np.asarray(run(image), float)
        p = np.clip(p if p.shape == (tile, tile) else resized(p, tile), 0, 1)
        return frame[["ty", "tx", "y", "x"]].assign(p=p[dy, dx])

    scored = tiles_of(pixels, height, width, tile, bounds).groupBy("ty", "tx").applyInPandas(score, "ty long, tx long, y long, x long, p double")
    if bounds is not None:
        scored = scored.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return blend(scored, tile)


def area_bounds(center: tuple[int, int], tile: int, height: int, width: int) -> tuple[int, int, int, int]:
    """The box of one tile around a centre, moved inside the image: what is read to score a single area."""
    tile = min(tile, height, width)
    y, x = (max(0, min(c - tile // 2, n - tile)) for c, n in zip(center, (height, width)))
    return y, x, y + tile, x + tile
