"""Combination of label layers pixel by pixel: (layer, y, x, v) in, (y, x, v) out. Only v > 0 counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(layers: DataFrame) -> DataFrame:
    return layers.where("v > 0").select("y", "x").distinct().withColumn("v", F.lit(1).cast("long"))


def on_background(mask: DataFrame, background: int, shape: tuple[int, int] | None) -> DataFrame:
    """The mask with a background value at all of a shape's other pixels; sparse where that is 0."""
    if not background:
        return mask.where("v <> 0")
    if shape is None:
        raise ValueError("a background value needs the mask's shape")
    every = mask.sparkSession.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).cast("long").alias("y"), (F.col("id") % shape[1]).alias("x"))
    return every.join(mask, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(background)).cast("long").alias("v"))


def merge_same(layers: DataFrame, value: int, background: int = 0, shape: tuple[int, int] | None = None) -> DataFrame:
    """One value wherever any layer has one, a background value elsewhere."""
    return on_background(union(layers).withColumn("v", F.lit(value).cast("long")), background, shape)


def compose_last_wins(layers: DataFrame, values: list[int] | None = None, background: int = 0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Class k, or the k-th of the values, for the k-th layer; where layers overlap the last one stands. The values and the background must differ."""
    last = layers.where("v > 0").groupBy("y", "x").agg(F.max("layer").cast("long").alias("v"))
    if values is None:
        return on_background(last, background, shape)
    if len(values) < 2 or len({background, *values}) <= len(values):
        raise ValueError("give two layers or more a value each, all different and none of the background's")
    named = F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("v").cast("int"))
    return on_background(last.withColumn("v", named), background, shape)


def votes(layers: DataFrame) -> DataFrame:
    return layers.where("v > 0").groupBy("y", "x").agg(F.countDistinct("layer").alias("v"))


def consensus(layers: DataFrame, least: int, value: int, n_layers: int) -> DataFrame:
    if not 1 <= least <= n_layers:
        raise ValueError("votes must be between 1 and the number of layers")
    return votes(layers).where(F.col("v") >= least).withColumn("v", F.lit(value).cast("long"))


def reassign(mask: DataFrame, new: int, source: int | None = None) -> DataFrame:
    """Give one value another; without a source the mask must hold a single value, else the query fails."""
    if source is not None:
        return mask.withColumn("v", F.when(F.col("v") == source, new).otherwise(F.col("v")).cast("long"))
    found = mask.agg(F.min("v").alias("low"), F.max("v").alias("high")).select(F.assert_true(F.col("low") == F.col("high"), "the mask holds several values").alias("_ok"))
    return mask.join(F.broadcast(found), F.col("_ok").isNull()).withColumn("v", F.lit(new).cast("long")).select(*mask.columns)  # found: one row


def check_layers(shapes: list[tuple[int, int]], transforms: list[tuple[float, ...]], least: int) -> None:
    """Raise unless there are enough layers of one shape and registration."""
    if len(shapes) < least:
        raise ValueError(f"at least {least} layers are needed")
    if len(set(shapes)) > 1:
        raise ValueError("layers differ in shape")
    if len(set(transforms)) > 1:
        raise ValueError("layers differ in registration")


def output_layer(names: list[str], mode: str, overwrite: bool) -> tuple[str, bool]:
    """(name of the layer that a result is written to, whether it replaces that layer): the first one, unless a new one is asked for; votes never replace a mask."""
    from gridloom.operators.catalog import unique_name

    if overwrite and mode != "votes":
        return names[0], True
    return unique_name(f"{names[0]} {mode}", set(names)), False
