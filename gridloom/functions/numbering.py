"""Gapless numbers in a total order, without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.plans.shared import materialize


def number_rows(df: DataFrame, order: list[str], name: str = "n", first: int = 1) -> DataFrame:
    """``df`` with its place in the order: ranges are numbered each for itself and moved by the rows before them."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_within") - 1 + first).cast("long")).drop("_part", "_within", "_before")
