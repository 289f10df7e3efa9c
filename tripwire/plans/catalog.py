"""Registry of named queries: a Spark plan and (when SQL-expressible) its DuckDB oracle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, section: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, section)
        return fn
    return deco


def add(name: str, fn, sql: str | None = None, section: str = ""):
    register(name, sql, section)(fn)


def finalize(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places (as round(x * 1e6) / 1e6, the same steps as the oracle), integers widened to BIGINT (the oracle does the same)."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            r = F.round(col.cast("double") * 1e6) / 1e6
            out.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name))  # no -0.0
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            out.append(col.cast("bigint").alias(f.name))
        else:
            out.append(col)
    return df.select(out)
