"""Helpers that several operators share: table access, written intermediate tables, workers' imports."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from ..session import prepare as _prepare

#: Rows of an Arrow batch: some MB of text, so that a worker's memory does not depend on the partition's size.
BATCH_ROWS = 1500

__all__ = ["arrow_map", "bounded_broadcast", "give_back", "materialize", "prepare", "ship_package", "table", "words_of"]


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings, and small Arrow batches for columns of whole texts."""
    _prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """At the end of a task: an idle worker gives back what it can of the memory it has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; the package is importable in the workers."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
        give_back()
    return df.mapInArrow(run, schema)


def bounded_broadcast(df: DataFrame, rows: int = 20_000) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint only if a count shows at most ``rows`` rows (narrow rows only)."""
    n = df.limit(rows + 1).count()
    return (F.broadcast(df), True) if n <= rows else (df, False)


def words_of(text):
    """Native number of words ``[^\\x20\\x09-\\x0D]+`` of a text column; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1)
    n = F.size(parts)
    blank = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + \
        F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (n - blank).cast("long")
