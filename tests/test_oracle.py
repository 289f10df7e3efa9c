"""A fast subset of the registered queries against their DuckDB oracles (sf0.001).
The full set: ``python tools/oracle_check.py /root/testdata/sf0.01``."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest, duck

from .conftest import SF001

FAST = ["behaviour_features", "graph_entity_features", "consecutive_failures", "trailing_fail_windows",
        "fuse_gated_lanes", "user_risk", "roc_auc", "pr_auc", "best_threshold", "precision_recall_at_k",
        "temporal_split", "stratified_split", "score_histogram", "risk_timeline", "ip_velocity_device_spread",
        "hour_zscore_30d", "embedding_features_fixed", "medians_by_label", "critical_tier"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(rel.columns, orows)


def test_contract(spark):
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    out = E.entry(spark)
    assert out.count() >= 0
