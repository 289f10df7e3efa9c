"""Deterministic rules: the rule score with reasons, the null rules, and the precision booster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import top_k

# fixed values: rule weights, thresholds and reason texts of the SOC rule score
# (the two pressure rules compare log1p(users) > log1p(10) / log1p(5); the raw counts are compared)
RULES = [
    ("subnet_user_count_10min_raw", ">", 10, 0.4, "High Subnet Pressure (10m)"),
    ("device_user_count_10min_raw", ">", 5, 0.3, "Shared Device Anomaly"),
    ("success_after_fail_burst", "==", 1, 0.6, "Post-Burst Login Success"),
    ("mature_account_multi_entity_drift", "==", 1, 0.4, "High-Confidence Account Drift"),
    ("new_country_and_fail_burst", "==", 1, 0.5, "Cross-Border Brute Force"),
    ("is_attack_ip", "==", 1, 0.9, "Known Malicious Infrastructure"),
]
BASELINE_REASON = "Baseline"

# fixed values: precision booster (top-N reranker): condition, weight and tag of each boost
BOOST_TOP_N = 5000
BOOST_WEIGHT = 1.2
BOOSTS = [
    ("success_after_fail_burst = 1", 0.40, "SUCCESS_AFTER_BRUTEFORCE; "),
    ("gf_asn_failure_rate_prior > 0.5 AND asn_user_count_before_raw > 100"
     " AND (fail_count_10min >= 1 OR user_login_hour_deviation > 8)", 0.25, "BOTNET_INFRA_PRESSURE; "),
    ("new_device_and_new_subnet = 1 AND first_time_country = 1 AND h_n > 50", 0.30, "MATURE_GEO_INFRA_MIGRATION; "),
    ("success = 1 AND first_time_country = 1 AND first_time_subnet = 1 AND gf_asn_failure_rate_prior > 0.3",
     0.30, "STEALTH_GEO_PIVOT; "),
]


def fired(rules):
    """(sum of weights, texts that fired, in order) over (condition, weight, text) rows."""
    total, texts = F.lit(0.0), []
    for cond, weight, text in rules:
        hit = F.coalesce(cond if isinstance(cond, Column) else F.expr(cond), F.lit(False))
        total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        texts.append(F.when(hit, F.lit(text)))
    return total, texts


def _cond(col, op, v):
    c = F.coalesce(F.col(col), F.lit(0))
    return c > v if op == ">" else c == v


def rule_score(df: DataFrame) -> DataFrame:
    """``rule_score`` = min(1, sum of fired weights); ``rule_reasons`` = '; '-joined names or 'Baseline'."""
    score, texts = fired([(_cond(col, op, v), w, text) for col, op, v, w, text in RULES])
    reasons = F.concat_ws("; ", *texts)
    return df.select("*", F.least(F.lit(1.0), score).alias("rule_score"),
                     F.when(reasons == "", F.lit(BASELINE_REASON)).otherwise(reasons).alias("rule_reasons"))


def null_rules(df: DataFrame) -> DataFrame:
    return df.select("*", F.lit(0.0).alias("rule_score"), F.lit("").alias("reason_codes"))


def boost_columns():
    """(boost, tags) expressions over feature columns, before the top-N restriction."""
    boost, tags = fired(BOOSTS)
    return boost, F.concat_ws("", *tags)


def precision_boost(df: DataFrame, score_col: str = "model_score", top_n: int = BOOST_TOP_N) -> DataFrame:
    """Boost only the ``top_n`` rows by score (ties: lower ``event_id`` first).

    The top-N ids are a bounded set (``top_n`` rows, exact :func:`top_k`), so they are
    broadcast and written back with a left join on ``event_id``.
    """
    top = top_k(df.select("event_id", score_col), score_col, top_n).select("event_id", F.lit(1).alias("_in_top"))
    boost, tags = boost_columns()
    x = df.join(F.broadcast(top), "event_id", "left")
    in_top = F.col("_in_top").isNotNull()
    x = x.select(*df.columns, F.when(in_top, boost).otherwise(F.lit(0.0)).alias("rule_boost"),
                 F.when(in_top, tags).otherwise(F.lit("")).alias("reason_tags"))
    final = F.least(F.greatest(F.col(score_col) + F.col("rule_boost") * BOOST_WEIGHT, F.lit(0.0)), F.lit(1.0))
    return x.select("*", final.alias("final_score"))
