"""Registered queries for per-user history (behaviour) and user-side graph features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.history import BEHAVIOUR_FEATURES, user_history
from ..sources.logins import load_fixture
from . import oracle as O
from .catalog import add, finalize

DOUBLE_FEATURES = {
    "user_login_count_prior", "login_hour_sin", "login_hour_cos", "user_weekend_login_rate_prior",
    "user_country_count_prior", "user_asn_count_prior", "user_subnet_count_prior",
    "user_device_combo_count_prior", "user_mean_login_hour_prior", "user_login_hour_deviation",
    "user_mean_time_between_logins_prior", "time_since_last_login_sec", "time_gap_deviation_ratio",
    "user_failure_rate_prior", "recent_fail_success_ratio", "gf_user_drift_score",
} | {f"secs_since_last_{n}_for_user" for n in
     ("country", "asn", "subnet", "device", "country_device", "asn_device", "subnet_device")} \
  | {f"recency_{n}_normalized" for n in ("country", "asn", "subnet", "device")} \
  | {f"{n}_change_rate_prior" for n in ("country", "asn", "subnet", "device")} \
  | {f"gf_user_{n}_count_before" for n in ("subnet", "asn", "country", "device")}

E4 = ("country", "asn", "subnet", "device")

# query name -> (columns, dense fixture?)
GROUPS = {
    "user_login_count_prior": (["user_login_count_prior"], True),
    "user_weekend_rate": (["user_weekend_login_rate_prior", "weekend_behavior_deviation"], False),
    "first_time_entities": (["first_time_country", "first_time_asn", "first_time_subnet",
                             "first_time_device_combo"], True),
    "user_entity_counts_prior": (["user_country_count_prior", "user_asn_count_prior", "user_subnet_count_prior",
                                  "user_device_combo_count_prior"], True),
    "entity_recency": ([f"{p}_{n}{s}" for n in E4 for p, s in
                        (("seen", "_before"), ("secs_since_last", "_for_user"), ("recency", "_normalized"))], True),
    "pair_recency": ([f"{p}_{n}{s}" for n in ("country_device", "asn_device", "subnet_device")
                      for p, s in (("seen", "_before"), ("secs_since_last", "_for_user"))], True),
    "first_time_pairs": (["first_time_country_device_combo", "first_time_asn_device_combo",
                          "first_time_subnet_device_combo", "first_time_country_asn"], True),
    "login_hour_profile": (["user_mean_login_hour_prior", "user_login_hour_deviation"], False),
    "login_gap_profile": (["user_mean_time_between_logins_prior", "time_since_last_login_sec",
                           "time_gap_deviation_ratio"], True),
    "user_fail_counts_prior": (["user_fail_count_prior", "user_success_count_prior", "user_failure_rate_prior"], True),
    "consecutive_failures": (["consecutive_failures_prior", "success_after_consecutive_fails"], True),
    "trailing_fail_windows": (["fail_count_10min", "fail_count_1hour", "success_count_10min",
                               "recent_fail_burst"], True),
    "fail_burst_flags": (["success_after_fail_burst", "recent_fail_success_ratio"], True),
    "new_entity_windows": (["new_entities_10min", "new_entities_1hour", "new_subnets_1hour",
                            "new_device_combos_1hour"], True),
    "entity_change_rates": ([f"{n}_change_rate_prior" for n in E4], True),
    "mature_account_flags": (["mature_account_new_country", "mature_account_new_device",
                              "mature_account_multi_entity_drift"], True),
    "compound_novelty_flags": (["new_device_and_new_subnet", "new_country_and_fail_burst",
                                "new_asn_and_unusual_hour", "success_after_fail_and_new_device"], False),
    "behaviour_features": (list(BEHAVIOUR_FEATURES), True),
    "gf_user_neighbour_counts": ([f"gf_user_{n}_count_before" for n in ("subnet", "asn", "country", "device")],
                                 True),
    "gf_edge_novelty": ([f"gf_edge_user_{n}_new" for n in ("subnet", "asn", "country", "device", "subnet_device",
                                                           "country_device", "asn_device")]
                        + ["gf_new_entity_count", "gf_user_drift_score"], True),
}


#: Rows of a user from which the fixture's users (about 67 rows each) are cut, so that every query runs on split users.
FEW_ROWS = 20


def history_frame(spark, sf_dir, dense=True):
    return user_history(load_fixture(spark, sf_dir, dense=dense), max_rows=FEW_ROWS)


def _spark(cols, dense):
    def q(spark, sf_dir):
        return finalize(history_frame(spark, sf_dir, dense).select("event_id", *cols))
    return q


def _sql(cols, dense):
    inner = O.with_ctes(O.fixture_ctes(dense), O.history_ctes()) + \
        f"\nSELECT event_id, {', '.join(cols)} FROM HF"
    return O.finalize(inner, doubles=[c for c in cols if c in DOUBLE_FEATURES],
                      ints=["event_id"] + [c for c in cols if c not in DOUBLE_FEATURES])


for _name, (_cols, _dense) in GROUPS.items():
    add(_name, _spark(_cols, _dense), _sql(_cols, _dense), "2.6/2.7")


add("behaviour_features_bucketed", lambda spark, sf: finalize(user_history(load_fixture(spark, sf, True), max_rows=5).select(
    "event_id", *BEHAVIOUR_FEATURES)), _sql(list(BEHAVIOUR_FEATURES), True), "2.6")
