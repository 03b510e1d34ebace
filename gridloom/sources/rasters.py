"""Rasters as sparse tables (y, x, v) with v <> 0, and encodings of business tables as rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.shared import dealt

#: Seconds of a column of the event raster; its first column starts at this day.
SLOT_SECONDS, FIRST_SLOT = 21_600, 78_892  # 2024-01-01
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FLAGS = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(column: str, names: list[str]) -> Column:
    """1-based place of a name in a list."""
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0)).cast("long")


def epoch_seconds(column: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, t, value) of each event: user, quarter of a day, code of the type."""
    events = table(spark, sf_dir, "events")
    x = F.floor(epoch_seconds("ts") / SLOT_SECONDS).cast("long") - FIRST_SLOT
    return events.select(F.col("user_id").alias("y"), x.alias("x"), code("event_type", EVENT_TYPES).alias("t"), "value")


def event_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: the smallest type code of each cell."""
    return event_cells(spark, sf_dir).groupBy("y", "x").agg(F.min("t").alias("v"))


def part_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: parts by twenties against suppliers, the smallest flag of each cell."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.floor(F.col("l_partkey") / 20).cast("long").alias("y"), F.col("l_suppkey").alias("x"), code("l_returnflag", FLAGS).alias("t"))
    return dealt(cells, "y", "x").groupBy("y", "x").agg(F.min("t").alias("v"))


def event_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1..L5: (layer, y, x, v), one layer for each event type."""
    return event_cells(spark, sf_dir).select(F.col("t").alias("layer"), "y", "x", F.col("t").alias("v")).distinct()


def vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4: (y, x, value), vectors as rows of an image."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select("y", F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))


#: The encodings in DuckDB SQL, as common table expressions.
EVENT_CELLS_SQL = "cells AS (SELECT user_id AS y, floor(epoch(ts) / 21600)::BIGINT - 78892 AS x, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT AS t, value FROM events)"
EVENT_MASK_SQL = f"{EVENT_CELLS_SQL}, mask AS (SELECT y, x, min(t) AS v FROM cells GROUP BY y, x)"
PART_MASK_SQL = "mask AS (SELECT l_partkey // 20 AS y, l_suppkey AS x, min(list_position(['A', 'N', 'R'], l_returnflag))::BIGINT AS v FROM lineitem GROUP BY 1, 2)"
LAYERS_SQL = f"{EVENT_CELLS_SQL}, layers AS (SELECT DISTINCT t AS layer, y, x, t AS v FROM cells)"
PIXELS_SQL = "pixels AS (SELECT vec_id AS y, unnest(range(len(embedding)))::BIGINT AS x, unnest(embedding)::DOUBLE AS value FROM embeddings)"
