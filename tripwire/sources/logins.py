"""Login event sources: the fixed login schema, raw readers, and the normalise step.

Every later operator assumes the *prepared* frame returned by :func:`prepare_logins`.
Total order of events is ``(login_us, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

LOGIN_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("login_ts", T.TimestampNTZType()),
    T.StructField("ip", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("asn", T.LongType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("os_name", T.StringType()),
    T.StructField("browser", T.StringType()),
    T.StructField("success", T.IntegerType()),
    T.StructField("rtt_ms", T.DoubleType()),
    T.StructField("is_attack_ip", T.IntegerType()),
    T.StructField("is_ato", T.IntegerType()),
])

# fixed values: column headers of the raw login CSV and the names they map to
RAW_HEADER_MAP = {
    "User ID": "user_id",
    "Login Timestamp": "login_ts",
    "IP Address": "ip",
    "Country": "country",
    "ASN": "asn",
    "Device Type": "device_type",
    "OS Name and Version": "os_name",
    "Browser Name and Version": "browser",
    "Login Successful": "success",
    "Round-Trip Time [ms]": "rtt_ms",
    "Is Attack IP": "is_attack_ip",
    "Is Account Takeover": "is_ato",
}

FIXTURE_EPOCH_US = 1704067200000000  # 2024-01-01 00:00:00 UTC


# fixed values: columns that a raw log may lack
OPTIONAL_HEADERS = {"Login Successful", "Is Account Takeover"}


def read_logins(spark: SparkSession, path: str, fmt: str = "csv", limit: int | None = None,
                id_col: str | None = None) -> DataFrame:
    """Read a raw login log (CSV with the log's headers in any order, or Parquet in our schema).

    CSV columns are found by their header; extra columns stay out, a missing one is an error
    (``OPTIONAL_HEADERS`` become null). All columns are read as strings (no inference pass over
    100 TB) and cast one by one; the timestamp may be a date and time or epoch seconds.
    ``event_id`` is ``id_col``, or else a hash of the file's name, the row's content and, where rows of
    a file are equal in every column, their number among these, which does not depend on how files are split. Equal
    rows are counted (combined on the map side) and unfolded again, so that none is gathered.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = parse_raw(spark.read.option("header", True).csv(path), id_col)
    df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGIN_SCHEMA.fields])
    return df.limit(limit) if limit else df


#: Copies of one row that are unfolded at once.
UNFOLD = 100_000


def parse_raw(raw: DataFrame, id_col: str | None = None, repeats_share_id: bool = False) -> DataFrame:
    """Raw string columns under the log's headers -> the login schema.

    A stream cannot number equal rows of a file: it needs ``id_col``, or the word that they may share an id."""
    missing = [h for h in RAW_HEADER_MAP if h not in raw.columns and h not in OPTIONAL_HEADERS]
    if missing:
        raise ValueError(f"the log lacks the columns {missing}")
    if raw.isStreaming and not id_col and not repeats_share_id:
        raise ValueError("a stream of logs needs id_col, or repeats_share_id=True where no two rows of a file are equal")
    if id_col:
        event_id = F.col(f"`{id_col}`").cast("bigint")
    else:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        event_id = F.xxhash64(name, *[F.col(f"`{c}`") for c in raw.columns])
    x = raw.select(event_id.alias("event_id"), *[
        (F.col(f"`{h}`") if h in raw.columns else F.lit(None)).cast("string").alias(c) for h, c in RAW_HEADER_MAP.items()])
    if not id_col and not repeats_share_id:
        names = x.columns
        x = x.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        x = x.withColumn("_b", F.explode(F.expr(f"sequence(0L, (_n - 1) div {UNFOLD})"))).withColumn(
            "_k", F.explode(F.expr(f"sequence(_b * {UNFOLD} + 1, least(_n, (_b + 1) * {UNFOLD}))")))
        x = x.select(F.when(F.col("_k") == 1, F.col("event_id")).otherwise(F.xxhash64("event_id", "_k")).alias("event_id"), *names[1:])
    ts = F.trim("login_ts")
    epoch = ts.rlike("^[0-9]+([.][0-9]*)?$")
    us = (F.when(epoch, ts).cast("decimal(26,6)") * 1_000_000).cast("bigint")
    return x.select(
        "event_id",
        F.col("user_id").cast("bigint").alias("user_id"),
        F.when(epoch, S.from_epoch_us(us)).otherwise(F.try_to_timestamp(F.when(~epoch, ts)).cast("timestamp_ntz")).alias("login_ts"),
        "ip", "country",
        F.col("asn").cast("bigint").alias("asn"),
        "device_type", "os_name", "browser",
        _bool_int("success").alias("success"),
        F.col("rtt_ms").cast("double").alias("rtt_ms"),
        _bool_int("is_attack_ip").alias("is_attack_ip"),
        _bool_int("is_ato").alias("is_ato"),
    )


def _bool_int(c: str):
    v = F.lower(F.trim(F.col(c)))
    return (F.when(v.isin("true", "1", "1.0", "yes"), 1)
            .when(v.isin("false", "0", "0.0", "no"), 0))


def fixture_logins(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The ``logins`` / ``logins_dense`` fixture: a fixed projection of ``events``.

    ``dense`` divides the time offset by 240 so that 30 days become 3 hours and the
    10-minute / 1-hour windows are well filled.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = ev.selectExpr("event_id", "user_id", "event_type", "value",
                      "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
                      f"timestampdiff(MICROSECOND, {S.EPOCH_NTZ}, ts) - {FIXTURE_EPOCH_US} AS us")
    off = "us div 240" if dense else "us"
    out = e.selectExpr(
        "event_id", "user_id",
        f"timestampadd(MICROSECOND, {FIXTURE_EPOCH_US} + {off}, {S.EPOCH_NTZ}) AS login_ts",
        "CASE WHEN k = 19 THEN NULL ELSE concat('10.', CAST(user_id % 4 AS STRING), '.', "
        "CAST(CASE WHEN k < 60 THEN user_id % 16 ELSE (user_id + k) % 16 END AS STRING), '.', CAST(k AS STRING)) END AS ip",
        "CASE WHEN k = 13 THEN NULL WHEN k < 80 THEN concat('C', CAST(user_id % 6 AS STRING)) "
        "ELSE concat('C', CAST((user_id + k) % 6 AS STRING)) END AS country",
        "CASE WHEN k = 17 THEN NULL WHEN k < 70 THEN 1000 + user_id % 12 ELSE 1000 + (user_id + k) % 12 END AS asn",
        "CASE WHEN k < 75 THEN 'desktop' WHEN k < 90 THEN 'mobile' ELSE 'tablet' END AS device_type",
        "concat('OS', CAST(CASE WHEN k < 75 THEN user_id % 3 ELSE k % 5 END AS STRING)) AS os_name",
        "CASE WHEN k = 23 THEN NULL ELSE concat('B', CAST(CASE WHEN k < 75 THEN user_id % 4 "
        "ELSE (user_id + k) % 4 END AS STRING)) END AS browser",
        "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success",
        "value AS rtt_ms",
        "CASE WHEN k >= 95 THEN 1 ELSE 0 END AS is_attack_ip",
        "CASE WHEN k >= 97 AND event_type = 'purchase' THEN 1 ELSE 0 END AS is_ato",
    )
    return out.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in LOGIN_SCHEMA.fields])


def prepare_logins(df: DataFrame, keep_rejects: bool = False) -> DataFrame:
    """Normalise raw logins: entity keys, flags, calendar columns, integer time.

    Rows without a timestamp cannot be placed in time; they are removed here
    (use :func:`rejected_logins` to see them).
    """
    out = df.where("login_ts IS NOT NULL") if not keep_rejects else df
    u = S.UNKNOWN
    return out.selectExpr(
        "event_id", "user_id", "login_ts",
        f"timestampdiff(MICROSECOND, {S.EPOCH_NTZ}, login_ts) AS login_us",
        "ip", "country", "asn", "device_type", "os_name", "browser", "rtt_ms",
        "coalesce(CAST(success AS INT), 1) AS success",
        "1 - coalesce(CAST(success AS INT), 1) AS fail",
        "coalesce(CAST(is_attack_ip AS INT), 0) AS is_attack_ip",
        "coalesce(CAST(is_ato AS INT), 0) AS is_ato",
        f"coalesce(CAST(country AS STRING), '{u}') AS country_key",
        f"coalesce(CAST(asn AS STRING), '{u}') AS asn_key",
        f"CASE WHEN ip IS NULL OR instr(ip, '.') = 0 THEN '{u}' ELSE substring_index(ip, '.', 3) END AS subnet",
        f"concat_ws('-', coalesce(device_type, '{u}'), coalesce(os_name, '{u}'), coalesce(browser, '{u}')) AS device",
        "CAST(country IS NULL AS INT) AS missing_country",
        "CAST(asn IS NULL AS INT) AS missing_asn",
        "CAST(device_type IS NULL OR os_name IS NULL OR browser IS NULL AS INT) AS missing_device_info",
        "hour(login_ts) AS hour",
        "weekday(login_ts) AS dow",
        "CAST(weekday(login_ts) >= 5 AS INT) AS is_weekend",
    )


def rejected_logins(df: DataFrame) -> DataFrame:
    return df.where(F.col("login_ts").isNull())


def load_fixture(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return prepare_logins(fixture_logins(spark, sf_dir, dense=dense))
