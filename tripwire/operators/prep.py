"""Model-input preparation: projection, imputation, one-hot, scalers (statistics distributed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordering import exact_quantiles

# fixed values: raw columns never given to a model
DROP_FOR_ML = ["ip", "login_ts", "login_us", "rtt_ms", "user_id", "is_attack_ip", "subnet", "device", "asn",
               "asn_key", "country", "country_key", "os_name", "browser", "event_id"]


def ml_project(df: DataFrame, label: str = "is_ato", keep_categorical=("device_type",)) -> DataFrame:
    """Numeric columns + listed categoricals, minus keys / raw text / helper (``h_``) columns."""
    cols = []
    for f in df.schema.fields:
        if f.name in DROP_FOR_ML or f.name.startswith("h_") or f.name == label:
            continue
        if isinstance(f.dataType, T.NumericType) or f.name in keep_categorical:
            cols.append(f.name)
    return df.select(*cols, label)


def impute(df: DataFrame, text_fill: str = "Unknown") -> DataFrame:
    """Numeric nulls to 0, text nulls to 'Unknown'."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    txt = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(0, num).na.fill(text_fill, txt)


def one_hot(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """0/1 column per known category (unknown or null gives all zeros). Categories come from
    training data: a small, bounded vocabulary (e.g. device types)."""
    return df.select("*", *[(F.col(col) == c).cast("int").alias(f"{col}_{c}") for c in categories])


def vocabulary(df: DataFrame, col: str, max_size: int = 1000) -> list[str]:
    """Distinct values of a low-cardinality column (size-checked before it reaches the driver)."""
    vals = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(max_size + 1).collect()
    if len(vals) > max_size:
        raise ValueError(f"{col} has more than {max_size} categories")
    return [r[0] for r in vals]


def standard_scale(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(x - mean) / population std, std 0 -> 1. ``stats`` (one row) can come from training data."""
    if stats is None:
        stats = df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                       *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])
    x = df.withColumn("_j", F.lit(1)).join(  # one-row statistics
        F.broadcast(stats.withColumn("_j", F.lit(1))), "_j")
    out = x.select(*df.columns, *[((F.col(c) - F.col(f"{c}__mean")) /
                                   F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std")))
                                  .alias(f"{c}_std") for c in cols])
    return out, stats


def robust_scale(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(x - median) / IQR with exact quantiles; IQR 0 -> 1."""
    if stats is None:
        long = df.unpivot([], cols, "feature", "value")
        q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature"])
        q = q.groupBy("feature").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
        stats = q.select("feature", F.col("`0.5`").alias("median"),
                         (F.col("`0.75`") - F.col("`0.25`")).alias("iqr"))
        stats = stats.agg(*[F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"{c}__{k}")
                            for c in cols for k in ("median", "iqr")])
    x = df.withColumn("_j", F.lit(1)).join(F.broadcast(stats.withColumn("_j", F.lit(1))), "_j")
    out = x.select(*df.columns, *[((F.col(c) - F.col(f"{c}__median")) /
                                   F.when(F.col(f"{c}__iqr") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__iqr")))
                                  .alias(f"{c}_rob") for c in cols])
    return out, stats
