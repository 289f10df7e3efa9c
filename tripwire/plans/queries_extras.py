"""Registered queries for the report-only operators (§2.16)."""

from __future__ import annotations

from ..operators import extras as X
from ..operators.history import user_history
from ..sources.logins import load_fixture
from . import oracle as O
from .catalog import add, finalize
from .frames import TEST_BUCKET_US, scored

LQ = lambda dense=False: O.with_ctes(O.fixture_ctes(dense))
B = O.BEFORE


def q(name, spark_fn, sql, doubles=(), ints=(), section="2.16"):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


q("ip_velocity_device_spread", lambda s, d: X.ip_velocity_and_device_spread(
    user_history(load_fixture(s, d, False)), bucket_us=TEST_BUCKET_US * 12),
  LQ() + "\nSELECT i.event_id, count(j.event_id) FILTER (WHERE COALESCE(j.ip, 'Unknown') = COALESCE(i.ip, 'Unknown')"
  " AND i.login_us - j.login_us <= 3600000000) AS ip_velocity_1h,"
  " count(DISTINCT j.device) FILTER (WHERE j.user_id = i.user_id AND i.login_us - j.login_us <= 86400000000)"
  " AS distinct_device_count_24h"
  f" FROM L i LEFT JOIN L j ON (j.user_id = i.user_id OR COALESCE(j.ip, 'Unknown') = COALESCE(i.ip, 'Unknown')) AND {B}"
  " GROUP BY i.event_id", [], ["event_id", "ip_velocity_1h", "distinct_device_count_24h"])
q("subnet_entropy", lambda s, d: X.subnet_entropy(load_fixture(s, d)),
  LQ() + ", PU AS (SELECT subnet, user_id, count(*) AS c FROM L GROUP BY subnet, user_id),"
  " PT AS (SELECT subnet, c / sum(c) OVER (PARTITION BY subnet) AS p FROM PU)\n"
  "SELECT subnet, -sum(p * ln(p)) AS user_entropy, count(*) AS users FROM PT GROUP BY subnet",
  ["user_entropy"], ["users"])
q("geo_anomalous_density", lambda s, d: X.geo_anomalous_density(load_fixture(s, d)),
  LQ() + "\nSELECT country_key, avg(CASE WHEN fail = 1 OR is_attack_ip = 1 THEN 1 ELSE 0 END) AS anomalous_share,"
  " count(*) AS events FROM L GROUP BY country_key", ["anomalous_share"], ["events"])
q("global_device_sharing_count", lambda s, d: X.global_device_sharing(load_fixture(s, d)),
  LQ() + "\nSELECT device, count(DISTINCT user_id) AS users FROM L GROUP BY device", [], ["users"])


def _z_sql(days):
    w = days * 86400000000
    return (LQ() + f", Z AS (SELECT i.event_id, i.hour, count(j.event_id) AS c, sum(j.hour) AS s,"
            f" sum(j.hour * j.hour) AS q FROM L i LEFT JOIN L j ON j.user_id = i.user_id AND {B}"
            f" AND i.login_us - j.login_us <= {w} GROUP BY i.event_id, i.hour),"
            " Z2 AS (SELECT *, CASE WHEN c >= 2 THEN s / c END AS m FROM Z),"
            " Z3 AS (SELECT *, CASE WHEN c >= 2 THEN sqrt(greatest(q / c - m * m, 0.0)) END AS sd FROM Z2)\n"
            f"SELECT event_id, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (hour - m) / sd END AS hour_zscore_{days}d"
            " FROM Z3")


for _days in (30, 7):
    q(f"hour_zscore_{_days}d", (lambda dd: lambda s, d: X.hour_zscore(load_fixture(s, d), dd)
                                .select("event_id", f"hour_zscore_{dd}d"))(_days),
      _z_sql(_days), [f"hour_zscore_{_days}d"], ["event_id"])

q("sequence_shifts", lambda s, d: X.sequence_shifts(load_fixture(s, d, True)).select(
    "event_id", "inter_arrival_sec", "session_recency_sec", "asn_pivot", "subnet_shift", "device_drift", "geo_jump"),
  LQ(True) + f", P AS (SELECT i.event_id, i.login_us, i.asn_key, i.subnet, i.device, i.country_key,"
  f" max(j.login_us) AS pu, max(j.login_us) FILTER (WHERE j.success = 1) AS psu FROM L i LEFT JOIN L j"
  f" ON j.user_id = i.user_id AND {B} GROUP BY ALL)\n"
  "SELECT p.event_id, CASE WHEN p.pu IS NULL THEN 0.0 ELSE (p.login_us - p.pu) / 1e6 END AS inter_arrival_sec,"
  " CASE WHEN p.psu IS NULL THEN NULL ELSE (p.login_us - p.psu) / 1e6 END AS session_recency_sec,"
  " CAST(q.asn_key IS NOT NULL AND q.asn_key != p.asn_key AS INTEGER) AS asn_pivot,"
  " CAST(q.subnet IS NOT NULL AND q.subnet != p.subnet AS INTEGER) AS subnet_shift,"
  " CAST(q.device IS NOT NULL AND q.device != p.device AS INTEGER) AS device_drift,"
  " CAST(q.country_key IS NOT NULL AND q.country_key != p.country_key AND p.login_us - p.pu <= 3600000000 AS INTEGER)"
  " AS geo_jump FROM P p LEFT JOIN L q ON q.user_id = (SELECT user_id FROM L WHERE event_id = p.event_id)"
  " AND q.login_us = p.pu AND q.event_id = (SELECT max(event_id) FROM L x WHERE x.login_us = p.pu"
  " AND x.user_id = q.user_id)",
  ["inter_arrival_sec", "session_recency_sec"],
  ["event_id", "asn_pivot", "subnet_shift", "device_drift", "geo_jump"])
q("percent_tiers", lambda s, d: X.percent_tiers(scored(s, d), "model_score", (0.001, 0.005))
  .select("event_id", "tier"),
  O.with_ctes(O.fixture_ctes(False), O.scored_ctes()) + ", P AS (SELECT event_id, row_number() OVER"
  " (ORDER BY model_score DESC, event_id) - 1 AS pos, count(*) OVER () AS total_n FROM SC)\n"
  "SELECT event_id, CASE WHEN pos < ceil(total_n * 0.001) THEN 'top_0.1pct' ELSE 'top_0.5pct' END AS tier FROM P"
  " WHERE pos < ceil(total_n * 0.005)", [], ["event_id"])


# cut into many buckets, checked against the same SQL
def _shifts_b(s, d):
    return X.sequence_shifts(load_fixture(s, d, True), 60, TEST_BUCKET_US).select(
        "event_id", "inter_arrival_sec", "session_recency_sec", "asn_pivot", "subnet_shift", "device_drift", "geo_jump")


def _z_b(s, d):
    return X.hour_zscore(load_fixture(s, d), 30, 6 * 3600 * 1_000_000).select("event_id", "hour_zscore_30d")


from .catalog import REGISTRY as _R  # noqa: E402

q("sequence_shifts_bucketed", _shifts_b, None)
_R["sequence_shifts_bucketed"].sql = _R["sequence_shifts"].sql
q("hour_zscore_30d_bucketed", _z_b, None)
_R["hour_zscore_30d_bucketed"].sql = _R["hour_zscore_30d"].sql
