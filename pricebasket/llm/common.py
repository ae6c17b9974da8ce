"""What the training-data operators share: tables in the shared folder, Arrow batches, memory handed back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricebasket.session import new_path, ship_package, stored

#: Rows in one Arrow batch sent to Python. Documents differ much in length; small batches bound a worker's memory.
ARROW_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


Batches = Iterable[pa.RecordBatch]


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make this package known to workers, and keep Arrow batches small, so that a worker never holds thousands of long texts
    at once. The session keeps that setting, since it counts when a frame is run, not when it is made."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Hand freed memory back to the system; a worker is reused by later tasks and would keep it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Batches], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow in small batches. What a task has built up is freed with the task."""
    bound_batches(df.sparkSession)

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def whole_text(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
