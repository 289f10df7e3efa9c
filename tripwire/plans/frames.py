"""Shared input frames of the registered queries (all derived from the given tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import user_history
from ..operators.infra import graph_features
from ..operators.rules import precision_boost, rule_score
from ..session import materialize
from ..sources.logins import load_fixture

# a small bucket so the fixture's 3-hour span is cut into many buckets (exercises the carry)
TEST_BUCKET_US = 20 * 60 * 1_000_000


def surrogate_scores(df: DataFrame) -> DataFrame:
    """The fixture's stand-in model / graph / rule scores (fixed formulas, ties on purpose)."""
    e, u = F.col("event_id"), F.col("user_id")
    model = F.least(F.lit(1.0), 0.55 * (((e * 7919 + u * 104729) % 1009).cast("double") / 1009.0)
                    + 0.45 * F.col("is_ato") + 0.2 * F.col("is_attack_ip"))
    graph = ((e * 6007 + u * 31) % 997).cast("double") / 997.0
    rule = ((e * 389 + u * 17) % 11).cast("double") / 10.0
    return df.select("*", model.alias("model_score"), graph.alias("graph_anomaly_score"), rule.alias("rule_score"))


def scored(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return surrogate_scores(load_fixture(spark, sf_dir, dense=dense))


def features(spark: SparkSession, sf_dir: str, dense: bool = True, bucket_us: int = TEST_BUCKET_US) -> DataFrame:
    return graph_features(user_history(load_fixture(spark, sf_dir, dense=dense)), bucket_us=bucket_us)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features + rule score + surrogate model score + precision boost → ``final_score``.

    The feature table is written once to the checkpoint folder: scoring, the top-N boost,
    both tiers and the roll-ups all read it (no recomputation of the window plans)."""
    f = materialize(features(spark, sf_dir))
    e, u = F.col("event_id"), F.col("user_id")
    model = F.least(F.lit(1.0), 0.55 * (((e * 7919 + u * 104729) % 1009).cast("double") / 1009.0)
                    + 0.45 * F.col("is_ato") + 0.2 * F.col("is_attack_ip"))
    graph = ((e * 6007 + u * 31) % 997).cast("double") / 997.0
    x = rule_score(f.select("*", model.alias("model_score"), graph.alias("graph_anomaly_score")))
    # scored + boosted table written once: both tiers and every roll-up read it
    return materialize(precision_boost(x, "model_score"))
