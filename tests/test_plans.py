"""Plan-shape tests: one exchange for the user windows, no single-partition window on
unbounded data, filters and column pruning reach the scan."""

from tripwire.operators.history import user_history
from tripwire.operators.infra import graph_features
from tripwire.plans.frames import featured
from tripwire.sources.logins import load_fixture

from .conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_user_windows_share_one_exchange(spark):
    h = user_history(load_fixture(spark, SF001, True))
    p = h._jdf.queryExecution().sparkPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1, p


def test_no_window_over_the_rows_of_a_user(spark):
    """Windows over logins are keyed by (user, bucket); those keyed by a user run along its buckets."""
    import re
    h = user_history(load_fixture(spark, SF001, True), max_rows=20)
    p = h._jdf.queryExecution().sparkPlan().toString()
    windows = [ln for ln in p.splitlines() if re.search(r"\bWindow \[", ln)]
    assert windows
    for ln in windows:
        assert "_bkt" in ln.rsplit("], [", 2)[-2] or "_bkt" in ln.rsplit("], [", 1)[-1], ln


def test_no_single_partition_window(spark):
    for df in (graph_features(user_history(load_fixture(spark, SF001, True)), checkpoint=False),
               user_history(load_fixture(spark, SF001, True), max_rows=20), featured(spark, SF001)):
        p = df._jdf.queryExecution().sparkPlan().toString()
        assert "SinglePartition" not in p.split("TakeOrderedAndProject")[0] or "Window" not in p, p


def test_scan_prunes_columns(spark):
    df = load_fixture(spark, SF001).select("event_id", "user_id")
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "value" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_top_k_exact_with_hot_ties(spark):
    from pyspark.sql import functions as F

    from tripwire.plans.ordering import top_k
    df = spark.range(0, 60000).select(F.col("id").alias("event_id"),
                                      F.when(F.col("id") % 3 == 0, F.lit(0.9)).otherwise(F.rand(7)).alias("s"))
    df = df.cache()
    ref = sorted(tuple(r) for r in df.orderBy(F.col("s").desc(), "event_id").limit(700).collect())
    for merge_limit in (10, 10 ** 7):  # global-position path and bounded-limit path
        got = sorted(tuple(r) for r in top_k(df, "s", 700, merge_limit=merge_limit).collect())
        assert got == ref


def test_entity_windows_are_split_by_time_bucket(spark):
    import re

    from tripwire.operators.infra import entity_counts
    h = user_history(load_fixture(spark, SF001, True))
    p = entity_counts(h, checkpoint=False)._jdf.queryExecution().sparkPlan().toString()
    # windows keyed by the entity key (_k = kind|entity); the user windows are keyed by user_id
    windows = [ln for ln in p.splitlines() if re.search(r"\bWindow \[", ln) and "_k#" in ln]
    assert windows, p
    for ln in windows:
        assert "_bkt" in ln, ln  # keyed by (key, bucket), or ordered by bucket over the aggregate


def test_quantiles_of_a_value_that_most_rows_share(spark):
    """Equal values are counted before they are dealt out: no task holds a value's rows, and results are exact."""
    import numpy as np

    from tripwire.plans.ordering import exact_quantiles
    df = spark.range(20_000).selectExpr("id % 3 AS g", "IF(id % 50 = 0, id / 7, 0.0D) AS v")
    probs = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    x = df.toPandas()
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in range(3):
        assert np.allclose([got[g, p] for p in probs], np.quantile(x[x.g == g].v, probs))
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", probs).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(x.v, probs))
    zero = df.selectExpr("0.0D AS v")
    assert {r["quantile"] for r in exact_quantiles(zero, "v", probs).collect()} == {0.0}
    assert exact_quantiles(zero.limit(0), "v", probs).collect() == []
