"""What the operators share on Spark's side."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.session import settled, shipped

__all__ = ["documents", "frugal", "released", "remainder", "shipped", "written"]

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The table, written below `spark.checkpoint.dir` and read back: later steps don't compute it again, lost executors or not."""
    return settled(df, f"llm-{purpose}", **options)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; -1 for a null id, which so is in no held-out part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def released() -> None:
    """Hands memory that this process has freed, but its allocators still hold, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def frugal(step: Step) -> Step:
    """The step of a task, before each batch and after the last of which freed memory goes back.

    A Python worker lives on from task to task and stage to stage; what its allocators hold would add up beside the executor's heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                released()
                yield batch

        yield from step(handed())
        released()

    return run
