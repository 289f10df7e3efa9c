"""Infrastructure-graph history: what each subnet / ASN / country / device saw before.

Runs after :func:`tripwire.operators.history.user_history`, which already gives every row
its first-(user, entity) flag, its first-failure-(user, entity) flag and the time of the
user's next row on the entity. All four entity kinds then go through one skew-safe sweep
(:func:`tripwire.operators.sweep.entity_sweep`): one shuffle keyed by (kind, entity, time
bucket), one pivot back by ``event_id``, one join to the wide history frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import materialize, parts_for
from .history import ONE_HOUR_US, TEN_MIN_US
from .sweep import DEFAULT_BUCKET_US, WIDE_ROWS_OF_A_TASK, Kind, entity_sweep

_FT = {"subnet": "first_time_subnet", "asn": "first_time_asn", "country": "first_time_country",
       "device": "first_time_device_combo"}
_KEY = {"subnet": "subnet", "asn": "asn_key", "country": "country_key", "device": "device"}


def entity_kinds() -> list[Kind]:
    out = []
    for kind in ("subnet", "asn", "country", "device"):
        sums = {"users": _FT[kind]}
        windows = {}
        if kind != "country":
            sums.update({"fails": "fail", "events": "1", "failed_users": f"h_first_fail_{kind}"})
            windows["users_10min"] = TEN_MIN_US
        if kind == "subnet":
            windows["users_1hour"] = ONE_HOUR_US
        out.append(Kind(kind, _KEY[kind], sums, windows, f"h_next_{kind}_us", f"h_next_{kind}_eid"))
    return out


GRAPH_ENTITY_FEATURES = [
    "gf_subnet_user_count_before", "gf_asn_user_count_before", "gf_country_user_count_before",
    "gf_device_user_count_before", "gf_subnet_failure_rate_prior", "gf_asn_failure_rate_prior",
    "gf_device_failure_rate_prior", "gf_subnet_failed_user_count_before", "gf_asn_failed_user_count_before",
    "gf_device_failed_user_count_before", "gf_subnet_user_count_10min", "gf_subnet_user_count_1hour",
    "gf_asn_user_count_10min", "gf_device_user_count_10min", "gf_subnet_has_high_failure_pressure",
    "gf_device_has_high_failure_pressure",
]


def entity_counts(hist: DataFrame, bucket_us: int = DEFAULT_BUCKET_US, checkpoint: bool = True,
                  extra_kinds: list[Kind] | None = None) -> DataFrame:
    """Raw prior counts per entity kind, one row per event (narrow).

    The narrow input is checkpointed: the sweep reads it twice (local prefix and
    per-bucket totals), and a lost executor does not replay the user pass.
    """
    cols = ["event_id", "user_id", "login_us", "fail", "ip", *_KEY.values()]
    for k in _FT:
        cols += [_FT[k], f"h_first_fail_{k}", f"h_next_{k}_us", f"h_next_{k}_eid"]
    x = materialize(hist.select(*cols), checkpoint)
    return entity_sweep(x, entity_kinds() + list(extra_kinds or []), bucket_us)


def graph_features(hist: DataFrame, bucket_us: int = DEFAULT_BUCKET_US, checkpoint: bool = True) -> DataFrame:
    """History frame + the 16 entity-side graph features (+ raw counts used by thresholds).

    The history frame is written once (Parquet, columnar): the sweep reads a few of its
    columns, the final join reads all of them; neither recomputes the window plans."""
    hist = materialize(hist, checkpoint)
    n = entity_counts(hist, bucket_us, checkpoint=False)
    if checkpoint:  # wide rows: as many partitions as the sweep's rows have, so that each holds a bounded number and none is shuffled twice
        hist = hist.repartition(parts_for(hist.sparkSession, hist.count(), WIDE_ROWS_OF_A_TASK), "event_id")
    return hist.join(derived_counts(n), "event_id")


def derived_counts(n: DataFrame, *keep: str) -> DataFrame:
    """Raw prior counts per event -> graph features (shared by the batch and the streaming plan)."""
    def rate(k):
        return f"CASE WHEN {k}_events > 0 THEN {k}_fails / {k}_events ELSE 0.0D END"

    feats = n.selectExpr(
        "event_id", *keep,
        *[f"log1p({k}_users) AS gf_{k}_user_count_before" for k in ("subnet", "asn", "country", "device")],
        *[f"{rate(k)} AS gf_{k}_failure_rate_prior" for k in ("subnet", "asn", "device")],
        *[f"log1p({k}_failed_users) AS gf_{k}_failed_user_count_before" for k in ("subnet", "asn", "device")],
        "log1p(subnet_users_10min) AS gf_subnet_user_count_10min",
        "log1p(subnet_users_1hour) AS gf_subnet_user_count_1hour",
        "log1p(asn_users_10min) AS gf_asn_user_count_10min",
        "log1p(device_users_10min) AS gf_device_user_count_10min",
        # raw (not log-damped) counts, for count thresholds
        "asn_users AS asn_user_count_before_raw",
        "subnet_users_10min AS subnet_user_count_10min_raw",
        "device_users_10min AS device_user_count_10min_raw",
    )
    return feats.selectExpr(
        "*",
        "CAST(gf_subnet_failed_user_count_before > 2.0D AND gf_subnet_failure_rate_prior > 0.5D AS INT)"
        " AS gf_subnet_has_high_failure_pressure",
        "CAST(gf_device_failed_user_count_before > 1.5D AND gf_device_failure_rate_prior > 0.5D AS INT)"
        " AS gf_device_has_high_failure_pressure")
