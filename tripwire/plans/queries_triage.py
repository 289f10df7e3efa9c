"""Registered queries: rules, boost, fusion, tiers, queues and roll-ups (§2.3-2.5, 2.10, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fusion as FU
from ..operators import rules as R
from ..operators import sketches as K
from ..operators import triage as T
from ..session import materialize
from . import oracle as O
from .catalog import add, finalize
from .frames import featured, scored

SC = lambda: O.with_ctes(O.fixture_ctes(False), O.scored_ctes())
FTQ = lambda: O.with_ctes(O.fixture_ctes(True), O.history_ctes(), O.graph_ctes(), O.featured_ctes())
LIN = ("SELECT *, greatest(0.5 * model_score + 0.3 * graph_anomaly_score + 0.2 * rule_score, rule_score * 0.8)"
       " AS final_risk FROM SC")
LIN_SEV = ("CASE WHEN final_risk >= 0.85 THEN 'CRITICAL' WHEN final_risk >= 0.65 THEN 'HIGH' "
           "WHEN final_risk >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END")
GATED = ("SELECT *, least(greatest(greatest(0.8 * model_score"
         " + CASE WHEN graph_anomaly_score > 0.92 AND model_score >= 0.15 AND model_score <= 0.70 THEN 0.15 ELSE 0.0 END"
         " + CASE WHEN graph_anomaly_score > 0.98 THEN 0.10 ELSE 0.0 END, rule_score * 0.7), 0.0), 1.0)"
         " AS final_risk FROM SC")
LANE = ("CASE WHEN rule_score > 0.8 THEN 'CRITICAL - Policy Violation' WHEN model_score > 0.75 THEN "
        "'HIGH - Known ATO Pattern' WHEN graph_anomaly_score > 0.95 AND model_score < 0.3 THEN "
        "'HIGH - Novel Structural Anomaly' WHEN final_risk > 0.5 THEN 'MEDIUM - Behavioral Review' "
        "ELSE 'LOW - Baseline' END")
CRIT = "CR AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, event_id) AS alert_rank FROM FT WHERE final_score > 0.50)"
SUSP = "SU AS (SELECT *, row_number() OVER (ORDER BY model_score DESC, event_id) AS alert_rank FROM FT ORDER BY model_score DESC, event_id LIMIT 1000)"
TOP5K = "TA AS (SELECT * FROM LF WHERE final_risk >= 0.4 ORDER BY final_risk DESC, event_id LIMIT 5000)"


def q(name, spark_fn, sql, doubles=(), ints=(), section=""):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


# ---- rules, boost, fusion -------------------------------------------------------------
q("rule_score_reasons", lambda s, d: featured(s, d).select("event_id", "rule_score", "rule_reasons"),
  FTQ() + "\nSELECT event_id, rule_score, rule_reasons FROM FT", ["rule_score"], ["event_id"], "2.13")
q("null_rules", lambda s, d: R.null_rules(scored(s, d).select("event_id")),
  SC() + "\nSELECT event_id, 0.0 AS rule_score, '' AS reason_codes FROM SC", ["rule_score"], ["event_id"], "2.13")
q("precision_boost", lambda s, d: featured(s, d).select("event_id", "rule_boost", "reason_tags", "final_score"),
  FTQ() + "\nSELECT event_id, rule_boost, reason_tags, final_score FROM FT", ["rule_boost", "final_score"],
  ["event_id"], "2.13")
q("fuse_linear_severity", lambda s, d: FU.fuse(scored(s, d), "linear").select("event_id", "final_risk", "alert_severity"),
  SC() + f", LF AS ({LIN})\nSELECT event_id, final_risk, {LIN_SEV} AS alert_severity FROM LF",
  ["final_risk"], ["event_id"], "2.13")
q("fuse_gated_lanes", lambda s, d: FU.fuse(scored(s, d), "gated").select("event_id", "final_risk", "alert_severity"),
  SC() + f", GF2 AS ({GATED})\nSELECT event_id, final_risk, {LANE} AS alert_severity FROM GF2",
  ["final_risk"], ["event_id"], "2.13")
q("sigmoid_fusion", lambda s, d: scored(s, d).select("event_id", FU.sigmoid_fusion(
    {"model_score": 4.0, "graph_anomaly_score": 2.0, "rule_score": 3.0}, -5.0).alias("risk")),
  SC() + "\nSELECT event_id, 1.0 / (1.0 + exp(-(-5.0 + 4.0 * model_score + 2.0 * graph_anomaly_score"
  " + 3.0 * rule_score))) AS risk FROM SC", ["risk"], ["event_id"], "2.16")

# ---- user roll-ups -----------------------------------------------------------------------
_UR = ("SELECT user_id, max(final_risk) AS max_risk, avg(final_risk) AS avg_risk, count(*) AS alert_count,"
       " max(model_score) AS max_model_score, max(graph_anomaly_score) AS max_graph_score FROM {} GROUP BY user_id")
_URD = ["max_risk", "avg_risk", "max_model_score", "max_graph_score"]
q("user_risk", lambda s, d: T.user_risk(FU.fuse(scored(s, d), "linear")),
  SC() + f", LF AS ({LIN})\n" + _UR.format("LF"), _URD, ["user_id", "alert_count"], "2.5")
q("user_risk_gated", lambda s, d: T.user_risk(FU.fuse(scored(s, d), "gated")),
  SC() + f", LF AS ({GATED})\n" + _UR.format("LF"), _URD, ["user_id", "alert_count"], "2.5")

# ---- alert list, severity counts, queues ----------------------------------------------
_TA_COLS = ["event_id", "user_id", "login_us", "ip", "country", "device_type", "success", "model_score",
            "graph_anomaly_score", "rule_score", "final_risk", "alert_severity", "is_ato"]


def _top_alerts(s, d):
    return T.top_alerts(FU.fuse(scored(s, d), "linear")).select(*_TA_COLS)


q("top_alerts_5000", _top_alerts,
  SC() + f", LF0 AS ({LIN}), LF AS (SELECT *, {LIN_SEV} AS alert_severity FROM LF0), {TOP5K}\n"
  f"SELECT {', '.join(_TA_COLS)} FROM TA",
  ["model_score", "graph_anomaly_score", "rule_score", "final_risk"],
  ["event_id", "user_id", "login_us", "success", "is_ato"], "2.10")
q("severity_counts", lambda s, d: T.severity_counts(_top_alerts(s, d)),
  SC() + f", LF0 AS ({LIN}), LF AS (SELECT *, {LIN_SEV} AS alert_severity FROM LF0), {TOP5K}\n"
  "SELECT sum(CASE WHEN alert_severity = 'CRITICAL' THEN 1 ELSE 0 END) AS critical,"
  " sum(CASE WHEN alert_severity = 'HIGH' THEN 1 ELSE 0 END) AS high, count(*) AS total FROM TA",
  [], ["critical", "high", "total"], "2.5")
q("rank_queues", lambda s, d: T.rank_queues(_top_alerts(s, d)),
  SC() + f", LF0 AS ({LIN}), LF AS (SELECT *, {LIN_SEV} AS alert_severity FROM LF0), {TOP5K}\n"
  "SELECT 'primary' AS queue, event_id, row_number() OVER (ORDER BY model_score DESC, event_id) AS queue_rank FROM TA"
  " UNION ALL SELECT 'secondary', event_id, row_number() OVER (ORDER BY model_score + graph_anomaly_score DESC, event_id)"
  " FROM TA WHERE model_score > 0.75 AND graph_anomaly_score > 0.95"
  " UNION ALL SELECT 'anomaly', event_id, row_number() OVER (ORDER BY graph_anomaly_score DESC, event_id) FROM TA",
  [], ["event_id", "queue_rank"], "2.10")
q("alerts_over", lambda s, d: FU.fuse(scored(s, d), "linear").where(F.col("final_risk") >= T.ALERT_CUT)
  .select("event_id", "final_risk"),
  SC() + f", LF AS ({LIN})\nSELECT event_id, final_risk FROM LF WHERE final_risk >= 0.4", ["final_risk"],
  ["event_id"], "2.3")


# ---- tiers and their roll-ups -------------------------------------------------------------
def _crit(s, d):
    return T.critical_tier(featured(s, d))


def _susp(s, d):
    return T.suspicious_tier(featured(s, d))


q("critical_tier", lambda s, d: _crit(s, d).select("alert_tier", "alert_rank", "event_id", "user_id", "final_score"),
  FTQ() + f", {CRIT}\nSELECT 'CRITICAL' AS alert_tier, alert_rank, event_id, user_id, final_score FROM CR",
  ["final_score"], ["alert_rank", "event_id", "user_id"], "2.10")
q("suspicious_tier", lambda s, d: _susp(s, d).select("alert_tier", "alert_rank", "event_id", "model_score",
                                                     "final_score"),
  FTQ() + f", {SUSP}\nSELECT 'SUSPICIOUS' AS alert_tier, alert_rank, event_id, model_score, final_score FROM SU",
  ["model_score", "final_score"], ["alert_rank", "event_id"], "2.10")


def _feed(s, d):
    f = featured(s, d)
    return T.alert_feed(T.critical_tier(f), T.suspicious_tier(f))


q("alert_feed", lambda s, d: _feed(s, d).select("alert_tier", "alert_rank", "event_id"),
  FTQ() + f", {CRIT}, {SUSP}\nSELECT 'CRITICAL' AS alert_tier, alert_rank, event_id FROM CR"
  " UNION ALL SELECT 'SUSPICIOUS', alert_rank, event_id FROM SU", [], ["alert_rank", "event_id"], "2.11")


def _afu(s, d):
    f = featured(s, d)
    return T.alert_for_user(T.critical_tier(f), T.suspicious_tier(f))


_AFU_SQL = (f", {CRIT}, {SUSP}, AF AS (SELECT 0 AS t, * FROM CR UNION ALL BY NAME SELECT 1 AS t, * FROM SU),"
            " A1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, alert_rank) AS r"
            " FROM AF) WHERE r = 1)")
q("alert_for_user", lambda s, d: _afu(s, d).select("user_id", "alert_tier", "alert_rank", "event_id"),
  FTQ() + _AFU_SQL + "\nSELECT user_id, CASE WHEN t = 0 THEN 'CRITICAL' ELSE 'SUSPICIOUS' END AS alert_tier,"
  " alert_rank, event_id FROM A1", [], ["user_id", "alert_rank", "event_id"], "2.4")
q("analyst_report", lambda s, d: _afu(s, d).select(
    "user_id", S.analyst_report("user_id", F.round(F.col("final_score") * 100) / 100,
                                F.when(F.col("reason_tags") == "", None).otherwise(F.col("reason_tags")))
    .alias("report")),
  FTQ() + _AFU_SQL + "\nSELECT user_id, CASE WHEN round(final_score * 100) / 100 > 0.8 THEN "
  "printf('CRITICAL: Account takeover likely for user %s (risk %s). Signals: %s. Action: lock account and reset credentials.',"
  " CAST(user_id AS VARCHAR), printf('%.2f', round(final_score * 100) / 100), COALESCE(NULLIF(reason_tags, ''), 'none'))"
  " ELSE printf('SUSPICIOUS: Unusual login for user %s (risk %s). Signals: %s. Action: step-up verification.',"
  " CAST(user_id AS VARCHAR), printf('%.2f', round(final_score * 100) / 100), COALESCE(NULLIF(reason_tags, ''), 'none'))"
  " END AS report FROM A1", [], ["user_id"], "2.2")
q("asn_risk_top", lambda s, d: T.asn_risk_top(_susp(s, d)),
  FTQ() + f", {SUSP}\nSELECT asn, avg(final_score) AS risk FROM SU WHERE asn IS NOT NULL GROUP BY asn"
  " ORDER BY risk DESC, asn LIMIT 10", ["risk"], ["asn"], "2.5")
q("country_alerts_top", lambda s, d: T.country_alerts_top(_susp(s, d)),
  FTQ() + f", {SUSP}, C1 AS (SELECT country, count(*) AS alerts FROM SU WHERE country IS NOT NULL GROUP BY country"
  " ORDER BY alerts DESC, country LIMIT 8)\nSELECT country, alerts, alerts / (SELECT max(alerts) FROM C1) AS share FROM C1",
  ["share"], ["alerts"], "2.5")
q("risky_users_top", lambda s, d: T.risky_users_top(_crit(s, d)),
  FTQ() + f", {CRIT}, U1 AS (SELECT user_id, avg(final_score) AS risk, count(*) AS alerts FROM CR GROUP BY user_id"
  " ORDER BY risk DESC, user_id LIMIT 10)\nSELECT substr(CAST(user_id AS VARCHAR), 1, 8) || '...' AS user, user_id, risk,"
  " alerts, CASE WHEN risk > 0.6 THEN 'CRITICAL_WATCH' ELSE 'ELEVATED' END AS label FROM U1",
  ["risk"], ["user_id", "alerts"], "2.5")
q("score_histogram", lambda s, d: T.score_histogram(_susp(s, d)),
  FTQ() + f", {SUSP}, B AS (SELECT * FROM (VALUES (0, '0-20%', 0.0, 0.2), (1, '20-40%', 0.2, 0.4), (2, '40-60%', 0.4, 0.6),"
  " (3, '60-80%', 0.6, 0.8), (4, '80-100%', 0.8, 1.0)) v(bin, range, lo, hi))\n"
  "SELECT b.bin, b.range, count(su.event_id) AS count FROM B b LEFT JOIN SU su ON su.final_score > b.lo"
  " AND su.final_score <= b.hi GROUP BY b.bin, b.range", [], ["bin", "count"], "2.5")
q("attack_clusters", lambda s, d: T.attack_clusters(_crit(s, d)),
  FTQ() + f", {CRIT}, A AS (SELECT 'ASN_NETWORK' AS type, 'AS' || CAST(asn AS VARCHAR) AS value,"
  " count(DISTINCT user_id) AS users, count(*) AS alerts, avg(final_score) AS risk FROM CR WHERE asn IS NOT NULL GROUP BY asn"
  " HAVING count(DISTINCT user_id) > 1 ORDER BY users DESC, asn LIMIT 5),"
  " D AS (SELECT 'DEVICE_FINGERPRINT' AS type, CASE WHEN strpos(device, '-') > 0 THEN split_part(device, '-', 2)"
  " ELSE device END AS value, count(DISTINCT user_id) AS users, count(*) AS alerts, avg(final_score) AS risk FROM CR"
  " GROUP BY device HAVING count(DISTINCT user_id) > 1 ORDER BY users DESC, device LIMIT 5)\n"
  "SELECT *, CASE WHEN risk > 0.6 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM A"
  " UNION ALL SELECT *, 'HIGH' FROM D", ["risk"], ["users", "alerts"], "2.5")
q("risk_timeline", lambda s, d: T.risk_timeline(_susp(s, d)),
  FTQ() + f", {SUSP}, H AS (SELECT hour(login_ts) AS hour, count(*) AS alerts FROM SU GROUP BY 1)\n"
  "SELECT r.range AS hour, printf('%02d:00', r.range) AS label, COALESCE(h.alerts, 0) AS alerts"
  " FROM range(24) r LEFT JOIN H h ON h.hour = r.range", [], ["hour", "alerts"], "2.5")
q("run_stats", lambda s, d: (lambda f: T.run_stats(f, T.critical_tier(f), T.suspicious_tier(f)))(featured(s, d)),
  FTQ() + f", {CRIT}, {SUSP}\nSELECT count(*) AS total_rows, sum(is_ato) AS known_atos, max(model_score) AS rf_score_max,"
  " max(final_score) AS final_score_max, min(final_score) AS final_score_min,"
  " (SELECT count(*) FROM CR) AS critical_alerts, (SELECT count(*) FROM SU) AS suspicious_alerts,"
  " min(model_score) AS rf_score_min, quantile_cont(model_score, 0.5) AS rf_score_median, quantile_cont(final_score, 0.5) AS final_score_median, "
  + ", ".join(f"(SELECT sum(is_ato) FROM (SELECT is_ato FROM FT ORDER BY {c} DESC, event_id LIMIT {k})) / {by} AS {n}_{m}"
              for n, c in (("rf", "model_score"), ("final", "final_score"))
              for m, k, by in (("p_at_50", 50, "50.0"), ("r_at_500", 500, "(SELECT sum(is_ato) FROM FT)"))) + " FROM FT",
  ["rf_score_max", "final_score_max", "final_score_min", "rf_score_min", "rf_score_median", "final_score_median",
   "rf_p_at_50", "rf_r_at_500", "final_p_at_50", "final_r_at_500"],
  ["total_rows", "known_atos", "critical_alerts", "suspicious_alerts"], "2.5")


# ---- flagship: users with a successful login right after >= 3 failures in 10 minutes ----
def _flagship(s, d):
    f = featured(s, d).where("success_after_fail_burst = 1")
    g = f.groupBy("user_id").agg(F.count(F.lit(1)).alias("burst_logins"), F.max("rule_score").alias("max_rule_score"),
                                 F.max("final_score").alias("max_final_score"))
    return g.orderBy(F.col("burst_logins").desc(), F.col("max_rule_score").desc(), F.col("user_id")).limit(10)


q("brute_force_success_top_users", _flagship,
  FTQ() + "\nSELECT user_id, count(*) AS burst_logins, max(rule_score) AS max_rule_score,"
  " max(final_score) AS max_final_score FROM FT WHERE success_after_fail_burst = 1 GROUP BY user_id"
  " ORDER BY burst_logins DESC, max_rule_score DESC, user_id LIMIT 10",
  ["max_rule_score", "max_final_score"], ["user_id", "burst_logins"], "7")


def _sketched(s, d):
    """Users of every ASN and device: exact ones, and whether the merged daily sketches hold them within their bounds."""
    f = scored(s, d)
    daily = materialize(K.daily_sketches(f, "model_score"))
    m = K.merged(daily).select("type", "value", "users_low", "users_high", "alerts", "risk")
    exact = [f.where(f"{c} IS NOT NULL").groupBy(F.lit(t).alias("type"), v.alias("value")).agg(F.countDistinct("user_id").alias("users"))
             for t, c, v in (("ASN_NETWORK", "asn", F.concat(F.lit("AS"), F.col("asn").cast("string"))), ("DEVICE_FINGERPRINT", "device", F.col("device")))]
    x = exact[0].unionByName(exact[1]).join(m, ["type", "value"], "left")
    return x.select("type", "value", "users", "alerts", "risk", F.col("users").between(F.col("users_low"), F.col("users_high")).cast("int").alias("within"))


q("attack_cluster_sketches", _sketched, O.with_ctes(O.fixture_ctes(False), O.scored_ctes())
  + "\nSELECT 'ASN_NETWORK' AS type, 'AS' || CAST(asn AS VARCHAR) AS value, count(DISTINCT user_id) AS users, count(*) AS alerts,"
  " avg(model_score) AS risk, 1 AS within FROM SC WHERE asn IS NOT NULL GROUP BY asn UNION ALL"
  " SELECT 'DEVICE_FINGERPRINT', device, count(DISTINCT user_id), count(*), avg(model_score), 1 FROM SC GROUP BY device",
  ["risk"], ["users", "alerts", "within"], "2.5")
