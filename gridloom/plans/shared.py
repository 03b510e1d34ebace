"""Tables in the folder that all executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/gridloom-checkpoints"
    return f"{root}/gridloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table there and read it back."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a small table that every executor may hold whole.
FEW_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A stored table of numbers as a side of a join: sent to all executors if it has FEW_ROWS at most, shuffled beyond."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


#: Rows that one task takes at once where they are dealt by keys, on average.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """A stored table's rows dealt by keys to as many tasks as they need, so that a task's memory doesn't grow with the table. Counting them
    reads the files' footers alone; ``rows`` is their number where it is known."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // TASK_ROWS))
    return df.repartition(tasks, *keys)


def release(spark: SparkSession) -> None:
    """Delete this application's tables; results made from them are gone after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
