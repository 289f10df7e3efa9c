"""Feature drift between early and late parts of the log, and per time block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import before, cut_rows, exact_quantiles

# fixed values: features watched for drift
DRIFT_FEATURES = ["user_login_count_prior", "user_country_count_prior", "user_asn_count_prior",
                  "user_subnet_count_prior", "user_device_combo_count_prior", "fail_count_1hour",
                  "time_gap_deviation_ratio", "user_mean_time_between_logins_prior", "gf_user_drift_score"]
BLOCK_FEATURES = ["user_login_count_prior", "user_country_count_prior", "user_asn_count_prior",
                  "user_subnet_count_prior", "user_device_combo_count_prior", "fail_count_10min",
                  "fail_count_1hour", "time_since_last_login_sec", "user_mean_time_between_logins_prior",
                  "time_gap_deviation_ratio"]
EPS = 1e-9


def _long(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Unpivot features to (keys..., feature, value)."""
    return df.unpivot(keys, features, "feature", "value").select(*keys, "feature", F.col("value").cast("double"))


def _stats(long: DataFrame, keys: list[str]) -> DataFrame:
    basic = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.5, 0.95, 0.99], keys)
    qp = q.groupBy(*keys).pivot("prob", [0.5, 0.95, 0.99]).agg(F.first("quantile"))
    qp = qp.select(*keys, F.col("`0.5`").alias("median"), F.col("`0.95`").alias("p95"), F.col("`0.99`").alias("p99"))
    return basic.join(qp, keys)


def drift_early_late(df: DataFrame, features=DRIFT_FEATURES, edge: int = 100_000, label: str = "is_ato") -> DataFrame:
    """First vs last ``edge`` rows by time: mean, median, p95, p99, max per part and the late/early
    ratios (mean, p99, max); label prevalence as the pseudo-feature ``label_prevalence``."""
    order, n = ["login_us", "event_id"], df.count()
    a, b = cut_rows(df, order, [edge, max(0, n - edge)])
    early = df.where(before(order, a)).withColumn("part", F.lit("early"))
    late = df.where(~before(order, b)).withColumn("part", F.lit("late")) if n else df.limit(0).withColumn("part", F.lit("late"))
    both = early.unionByName(late).select("part", *features, F.col(label).cast("double").alias("label_prevalence"))
    st = _stats(_long(both, list(features) + ["label_prevalence"], ["part"]), ["feature", "part"])
    e = st.where("part = 'early'").drop("part")
    la = st.where("part = 'late'").drop("part")
    cols = ["mean", "median", "p95", "p99", "max"]
    j = e.select("feature", *[F.col(c).alias(f"early_{c}") for c in cols]).join(
        la.select("feature", *[F.col(c).alias(f"late_{c}") for c in cols]), "feature")
    return j.select("*", *[(F.col(f"late_{c}") / (F.col(f"early_{c}") + EPS)).alias(f"ratio_{c}")
                           for c in ("mean", "p99", "max")])


def drift_by_block(df: DataFrame, features=BLOCK_FEATURES, block: int = 100_000, blocks=(0, 25, 49)) -> DataFrame:
    """Per chosen block of ``block`` rows in time order: min, median, p95, p99, max per feature."""
    order = ["login_us", "event_id"]
    cuts = cut_rows(df, order, [k * block for b in blocks for k in (b, b + 1)])
    which = None  # a block whose first row lies beyond the end has no rows
    for b, lo, hi in zip(blocks, cuts[::2], cuts[1::2], strict=True):
        inside = ~before(order, lo) & before(order, hi) if lo is not None else F.lit(False)
        which = F.when(inside, b) if which is None else which.when(inside, b)
    x = df.select(which.cast("bigint").alias("block"), *features).where(F.col("block").isNotNull())
    st = _stats(_long(x, list(features), ["block"]), ["block", "feature"])
    return st.select("block", "feature", "min", "median", "p95", "p99", "max")


def label_prevalence(parts: list[DataFrame], label: str = "is_ato") -> DataFrame:
    return reduce(DataFrame.unionByName, [p.agg(F.avg(label).alias("prevalence")) for p in parts])
