"""Registered queries for the entity side of the infrastructure graph (§2.7)."""

from __future__ import annotations

from ..operators.history import user_history
from ..operators.infra import GRAPH_ENTITY_FEATURES, graph_features
from ..sources.logins import load_fixture
from . import oracle as O
from .catalog import add, finalize
from .queries_history import FEW_ROWS

# a small bucket so the fixture's 3-hour span is cut into many buckets (exercises the carry)
TEST_BUCKET_US = 20 * 60 * 1_000_000

INT_COLS = {"gf_subnet_has_high_failure_pressure", "gf_device_has_high_failure_pressure"}

GROUPS = {
    "gf_entity_user_counts": [f"gf_{k}_user_count_before" for k in ("subnet", "asn", "country", "device")],
    "gf_entity_failure_stats": [f"gf_{k}_failure_rate_prior" for k in ("subnet", "asn", "device")]
    + [f"gf_{k}_failed_user_count_before" for k in ("subnet", "asn", "device")],
    "gf_trailing_distinct_users": ["gf_subnet_user_count_10min", "gf_subnet_user_count_1hour",
                                   "gf_asn_user_count_10min", "gf_device_user_count_10min"],
    "gf_failure_pressure": ["gf_subnet_has_high_failure_pressure", "gf_device_has_high_failure_pressure"],
    "graph_entity_features": list(GRAPH_ENTITY_FEATURES),
}


def graph_frame(spark, sf_dir, dense=True):
    return graph_features(user_history(load_fixture(spark, sf_dir, dense=dense), max_rows=FEW_ROWS), bucket_us=TEST_BUCKET_US)


def _spark(cols):
    def q(spark, sf_dir):
        return finalize(graph_frame(spark, sf_dir).select("event_id", *cols))
    return q


def _sql(cols):
    inner = O.with_ctes(O.fixture_ctes(True), O.graph_ctes()) + f"\nSELECT event_id, {', '.join(cols)} FROM GF"
    return O.finalize(inner, doubles=[c for c in cols if c not in INT_COLS],
                      ints=["event_id"] + [c for c in cols if c in INT_COLS])


for _n, _c in GROUPS.items():
    add(_n, _spark(_c), _sql(_c), "2.7")
