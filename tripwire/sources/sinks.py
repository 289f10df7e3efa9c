"""Sinks and report readers: tables (Parquet / CSV), JSON reports, alert lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logins import RAW_HEADER_MAP


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_raw_logins_csv(df: DataFrame, path: str) -> str:
    """Logins in our schema written with the raw log's headers (the input format of the reference)."""
    inv = {v: k for k, v in RAW_HEADER_MAP.items()}
    out = df.select(*[F.col(c).cast("string").alias(inv[c]) for c in RAW_HEADER_MAP.values()])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


# fixed values: the header of the raw log, in its order
RAW_HEADER = ["IP Address", "Country", "Region", "City", "ASN", "User Agent String", "OS Name and Version",
              "Browser Name and Version", "Device Type", "User ID", "Login Timestamp", "Round-Trip Time [ms]",
              "Login Successful", "Is Attack IP", "Is Account Takeover"]


def write_full_log_csv(df: DataFrame, path: str, epoch_seconds: bool = False) -> str:
    """Logins as a raw log with all its columns, in its order; those we do not hold are empty."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', login_ts)")
    seconds = (us.cast("decimal(26,6)") / 1_000_000).cast("decimal(20,6)").cast("string")
    cols = []
    for h in RAW_HEADER:
        c = RAW_HEADER_MAP.get(h)
        value = F.lit(None) if c is None else seconds if c == "login_ts" and epoch_seconds else F.col(c)
        cols.append(value.cast("string").alias(h))
    df.select(cols).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json_report(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_alerts(spark: SparkSession, path: str, score: str = "final_score", top: int = 100) -> DataFrame:
    """First ``top`` alerts by score with nulls filled with 0 (numbers) / '' (text)."""
    df = spark.read.parquet(path)
    return df.orderBy(F.col(score).desc(), F.col("event_id")).limit(top).na.fill(0).na.fill("")
