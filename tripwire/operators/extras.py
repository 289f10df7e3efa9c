"""Operators the reference describes in its report without code (definitions are ours)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import before, cut_rows
from .shifts import hour_zscore, sequence_shifts  # noqa: F401
from .sweep import DEFAULT_BUCKET_US, Kind, entity_sweep

HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US


def ip_velocity_and_device_spread(hist: DataFrame, ip_window_us: int = HOUR_US, device_window_us: int = DAY_US,
                                  bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``ip_velocity_1h``: prior events on the same IP within the window (inclusive);
    ``distinct_device_count_24h``: distinct devices of the user in the trailing window.
    Both through the skew-safe sweep (a hot IP or a very active user is split by time)."""
    kinds = [Kind("ip", "coalesce(ip, 'Unknown')", windows={"events": ip_window_us}),
             Kind("userdev", "user_id", windows={"devices": device_window_us},
                  next_us="h_next_device_us", next_eid="h_next_device_eid")]
    x = hist.select("event_id", "user_id", "login_us", "ip", "h_next_device_us", "h_next_device_eid")
    r = entity_sweep(x, kinds, bucket_us)
    return r.select("event_id", F.col("ip_events").alias("ip_velocity_1h"),
                    F.col("userdev_devices").alias("distinct_device_count_24h"))


def subnet_entropy(df: DataFrame) -> DataFrame:
    """Shannon entropy (nats) of the users' share of events on each subnet."""
    per = df.groupBy("subnet", "user_id").agg(F.count(F.lit(1)).alias("c"))
    tot = per.groupBy("subnet").agg(F.sum("c").alias("t"))
    x = per.join(tot, "subnet").select("subnet", (F.col("c") / F.col("t")).alias("p"))
    return x.groupBy("subnet").agg((-F.sum(F.col("p") * F.log(F.col("p")))).alias("user_entropy"),
                                   F.count(F.lit(1)).alias("users"))


def geo_anomalous_density(df: DataFrame) -> DataFrame:
    """Share of failed or attack-IP events per country."""
    bad = ((F.col("fail") == 1) | (F.col("is_attack_ip") == 1)).cast("int")
    return df.groupBy("country_key").agg(F.avg(bad).alias("anomalous_share"), F.count(F.lit(1)).alias("events"))


def global_device_sharing(df: DataFrame) -> DataFrame:
    return df.groupBy("device").agg(F.countDistinct("user_id").alias("users"))


def percent_tiers(df: DataFrame, score: str, cuts=(0.001, 0.005)) -> DataFrame:
    """Top 0.1 % / 0.5 % of rows by score (ties: lower event_id): a few cut rows of a narrow projection decide."""
    s = F.col(score).cast("double")
    # ascending: NaN first (the largest), null last
    x = df.withColumn("_down", F.when(s.isNull(), float("inf")).when(F.isnan(s), float("-inf")).otherwise(-s))
    order, n = ["_down", "event_id"], df.count()
    tier = None
    for c, cut in zip(sorted(cuts), cut_rows(x, order, [math.ceil(n * c) for c in sorted(cuts)]), strict=True):
        name = f"top_{c * 100:g}pct"
        tier = F.when(before(order, cut), name) if tier is None else tier.when(before(order, cut), name)
    return x.select(*df.columns, tier.alias("tier")).where(F.col("tier").isNotNull())
