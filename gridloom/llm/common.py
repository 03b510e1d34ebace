"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans import shared
from gridloom.plans.shared import release  # noqa: F401

#: Rows of the Arrow batches of plans that are run here.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside send small batches to Python workers, to hold less beside the heap; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder in small batches and read it back."""
    with small_batches(df.sparkSession):
        return shared.materialize(df, name)


#: Bytes of text that a kernel works on at once (a longer text alone).
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of so many bytes of a column at most, or of one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        reach, first = np.cumsum(length), 0
        while first < batch.num_rows:
            done = reach[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(reach, done + size, side="right")))
            yield batch.slice(first, end - first)
            first = end


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def text_array(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The strings of a batch, nulls as empty strings, in one array with 64-bit offsets."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return pc.fill_null(column, "")


def utf8_parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, n + 1 offsets from 0) of an array without nulls."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + n + 1]
    if strings.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, n + 1 offsets into them)."""
    data, offsets = utf8_parts(strings)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, starts[offsets]
