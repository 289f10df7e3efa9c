"""Independent DuckDB SQL for the correctness gate.

Written in a different shape from the Spark plans on purpose: history features are
self-joins with ``count(distinct)`` / filtered aggregates instead of window frames, so a
shared mistake is unlikely. Tables ``events`` ... are pre-registered views.
"""

from __future__ import annotations

EPOCH = 1704067200000000


def fixture_ctes(dense: bool = False) -> str:
    """CTEs ``raw`` (fixture logins) and ``L`` (normalised logins), DuckDB dialect."""
    off = "us // 240" if dense else "us"
    return f"""
E AS (SELECT event_id, user_id, event_type, value,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
             epoch_us(ts) - {EPOCH} AS us FROM events),
raw AS (SELECT event_id, user_id, make_timestamp({EPOCH} + {off}) AS login_ts,
  CASE WHEN k = 19 THEN NULL ELSE '10.' || CAST(user_id % 4 AS VARCHAR) || '.' ||
       CAST(CASE WHEN k < 60 THEN user_id % 16 ELSE (user_id + k) % 16 END AS VARCHAR) || '.' || CAST(k AS VARCHAR) END AS ip,
  CASE WHEN k = 13 THEN NULL WHEN k < 80 THEN 'C' || CAST(user_id % 6 AS VARCHAR)
       ELSE 'C' || CAST((user_id + k) % 6 AS VARCHAR) END AS country,
  CASE WHEN k = 17 THEN NULL WHEN k < 70 THEN 1000 + user_id % 12 ELSE 1000 + (user_id + k) % 12 END AS asn,
  CASE WHEN k < 75 THEN 'desktop' WHEN k < 90 THEN 'mobile' ELSE 'tablet' END AS device_type,
  'OS' || CAST(CASE WHEN k < 75 THEN user_id % 3 ELSE k % 5 END AS VARCHAR) AS os_name,
  CASE WHEN k = 23 THEN NULL ELSE 'B' || CAST(CASE WHEN k < 75 THEN user_id % 4 ELSE (user_id + k) % 4 END AS VARCHAR) END AS browser,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
  value AS rtt_ms,
  CASE WHEN k >= 95 THEN 1 ELSE 0 END AS is_attack_ip,
  CASE WHEN k >= 97 AND event_type = 'purchase' THEN 1 ELSE 0 END AS is_ato
  FROM E),
L AS (SELECT event_id, user_id, login_ts, epoch_us(login_ts) AS login_us, ip, country, asn,
  device_type, os_name, browser, rtt_ms,
  COALESCE(success, 1) AS success, 1 - COALESCE(success, 1) AS fail,
  COALESCE(is_attack_ip, 0) AS is_attack_ip, COALESCE(is_ato, 0) AS is_ato,
  COALESCE(country, 'Unknown') AS country_key,
  COALESCE(CAST(asn AS VARCHAR), 'Unknown') AS asn_key,
  CASE WHEN ip IS NULL OR strpos(ip, '.') = 0 THEN 'Unknown'
       ELSE array_to_string(string_split(ip, '.')[1:3], '.') END AS subnet,
  COALESCE(device_type, 'Unknown') || '-' || COALESCE(os_name, 'Unknown') || '-' || COALESCE(browser, 'Unknown') AS device,
  CAST(country IS NULL AS INTEGER) AS missing_country,
  CAST(asn IS NULL AS INTEGER) AS missing_asn,
  CAST(device_type IS NULL OR os_name IS NULL OR browser IS NULL AS INTEGER) AS missing_device_info,
  hour(login_ts) AS hour, isodow(login_ts) - 1 AS dow,
  CAST(isodow(login_ts) >= 6 AS INTEGER) AS is_weekend
  FROM raw WHERE login_ts IS NOT NULL)"""


BEFORE = "(j.login_us < i.login_us OR (j.login_us = i.login_us AND j.event_id < i.event_id))"

_I_COLS = ["event_id", "user_id", "login_us", "country_key", "asn_key", "subnet", "device", "success",
           "fail", "hour", "dow", "is_weekend", "missing_country", "missing_asn", "missing_device_info",
           "is_attack_ip", "is_ato", "ip", "country", "device_type", "rtt_ms", "asn", "login_ts"]


def history_ctes() -> str:
    """CTE ``HF``: every behaviour and user-side graph feature, from self-joins over ``L``."""
    gi = ", ".join(f"i.{c}" for c in _I_COLS)

    def same(*cols):
        return " AND ".join(f"j.{c} = i.{c}" for c in cols)

    ents = {"country": ("country_key",), "asn": ("asn_key",), "subnet": ("subnet",), "device": ("device",),
            "country_device": ("country_key", "device"), "asn_device": ("asn_key", "device"),
            "subnet_device": ("subnet", "device"), "country_asn": ("country_key", "asn_key")}
    per = []
    for n, cols in ents.items():
        per.append(f"CAST(count(j.event_id) FILTER (WHERE {same(*cols)}) = 0 AS INTEGER) AS ft_{n}")
        per.append(f"max(j.login_us) FILTER (WHERE {same(*cols)}) AS last_{n}_us")
    for n, cols in list(ents.items())[:4]:
        per.append(f"count(DISTINCT j.{cols[0]}) AS cnt_{n}")
    h1 = f"""
H1 AS (SELECT {gi},
  count(j.event_id) AS n, min(j.login_us) AS first_us, max(j.login_us) AS prev_us,
  COALESCE(sum(j.is_weekend), 0) AS wk, COALESCE(sum(j.hour), 0) AS hs,
  COALESCE(sum(j.fail), 0) AS fails, COALESCE(sum(j.success), 0) AS succ,
  count(*) FILTER (WHERE j.fail = 1 AND i.login_us - j.login_us <= 600000000) AS f10,
  count(*) FILTER (WHERE j.fail = 1 AND i.login_us - j.login_us <= 3600000000) AS f1h,
  count(*) FILTER (WHERE j.success = 1 AND i.login_us - j.login_us <= 600000000) AS s10,
  {", ".join(per)}
  FROM L i LEFT JOIN L j ON j.user_id = i.user_id AND {BEFORE}
  GROUP BY {gi})"""
    gi2 = ", ".join(f"i.{c}" for c in _I_COLS + ["n"])
    h2 = f"""
H2 AS (SELECT {gi2},
  i.n - COALESCE(max(j.n + 1) FILTER (WHERE j.success = 1), 0) AS consec,
  COALESCE(sum(j.ft_country + j.ft_asn + j.ft_subnet + j.ft_device) FILTER (WHERE i.login_us - j.login_us <= 600000000), 0) AS ne10,
  COALESCE(sum(j.ft_country + j.ft_asn + j.ft_subnet + j.ft_device) FILTER (WHERE i.login_us - j.login_us <= 3600000000), 0) AS ne1h,
  COALESCE(sum(j.ft_subnet) FILTER (WHERE i.login_us - j.login_us <= 3600000000), 0) AS ns1h,
  COALESCE(sum(j.ft_device) FILTER (WHERE i.login_us - j.login_us <= 3600000000), 0) AS nd1h
  FROM H1 i LEFT JOIN H1 j ON j.user_id = i.user_id AND {BEFORE}
  GROUP BY {gi2})"""
    # derived values, one level at a time
    h3 = """
H3 AS (SELECT a.*, b.consec, b.ne10, b.ne1h, b.ns1h, b.nd1h,
  CASE WHEN a.n >= 2 THEN ((a.prev_us - a.first_us) / 1e6) / (a.n - 1) ELSE 1.0 END AS gap0,
  CASE WHEN a.n > 0 THEN a.wk / a.n ELSE 0.0 END AS wrate,
  CASE WHEN a.n >= 2 THEN a.hs / a.n ELSE CAST(a.hour AS DOUBLE) END AS mhour,
  CASE WHEN a.prev_us IS NULL THEN 0.0 ELSE (a.login_us - a.prev_us) / 1e6 END AS since,
  greatest(1, least(a.n, 100)) AS rate_base,
  CAST(a.success = 1 AND a.f10 >= 3 AS INTEGER) AS safb
  FROM H1 a JOIN H2 b ON a.event_id = b.event_id),
H4 AS (SELECT *, CASE WHEN gap0 = 0 THEN 1.0 ELSE gap0 END AS mean_gap,
  CASE WHEN n >= 2 THEN least(abs(hour - mhour), 24 - abs(hour - mhour)) ELSE 0.0 END AS hdev
  FROM H3)"""
    feats = []
    feats += ["ln(1 + n) AS user_login_count_prior",
              "sin(2 * pi() * hour / 24) AS login_hour_sin", "cos(2 * pi() * hour / 24) AS login_hour_cos",
              "dow AS login_day_of_week", "wrate AS user_weekend_login_rate_prior",
              "CAST((is_weekend = 1 AND wrate < 0.1) OR (is_weekend = 0 AND wrate > 0.9) AS INTEGER) AS weekend_behavior_deviation",
              "ft_country AS first_time_country", "ft_asn AS first_time_asn", "ft_subnet AS first_time_subnet",
              "ft_device AS first_time_device_combo",
              "ln(1 + cnt_country) AS user_country_count_prior", "ln(1 + cnt_asn) AS user_asn_count_prior",
              "ln(1 + cnt_subnet) AS user_subnet_count_prior", "ln(1 + cnt_device) AS user_device_combo_count_prior"]

    def secs(n):
        return f"CASE WHEN last_{n}_us IS NULL THEN 0.0 ELSE (login_us - last_{n}_us) / 1e6 END"

    for n in ("country", "asn", "subnet", "device"):
        feats += [f"1 - ft_{n} AS seen_{n}_before", f"{secs(n)} AS secs_since_last_{n}_for_user",
                  f"{secs(n)} / mean_gap AS recency_{n}_normalized"]
    for n in ("country_device", "asn_device", "subnet_device"):
        feats += [f"1 - ft_{n} AS seen_{n}_before", f"{secs(n)} AS secs_since_last_{n}_for_user"]
    feats += ["ft_country_device AS first_time_country_device_combo", "ft_asn_device AS first_time_asn_device_combo",
              "ft_subnet_device AS first_time_subnet_device_combo", "ft_country_asn AS first_time_country_asn",
              "mhour AS user_mean_login_hour_prior", "hdev AS user_login_hour_deviation",
              "CASE WHEN n >= 2 THEN least(mean_gap, 100.0) ELSE 0.0 END AS user_mean_time_between_logins_prior",
              "since AS time_since_last_login_sec",
              "CASE WHEN n >= 2 THEN least(since / mean_gap, 100.0) ELSE 0.0 END AS time_gap_deviation_ratio",
              "fails AS user_fail_count_prior", "succ AS user_success_count_prior",
              "CASE WHEN n > 0 THEN fails / n ELSE 0.0 END AS user_failure_rate_prior",
              "consec AS consecutive_failures_prior",
              "CAST(success = 1 AND consec >= 3 AS INTEGER) AS success_after_consecutive_fails",
              "f10 AS fail_count_10min", "f1h AS fail_count_1hour", "s10 AS success_count_10min",
              "f10 AS recent_fail_burst", "safb AS success_after_fail_burst",
              "CASE WHEN f10 + s10 > 0 THEN f10 / (f10 + s10) ELSE 0.0 END AS recent_fail_success_ratio",
              "ne10 AS new_entities_10min", "ne1h AS new_entities_1hour", "ns1h AS new_subnets_1hour",
              "nd1h AS new_device_combos_1hour",
              "cnt_country / rate_base AS country_change_rate_prior", "cnt_asn / rate_base AS asn_change_rate_prior",
              "cnt_subnet / rate_base AS subnet_change_rate_prior", "cnt_device / rate_base AS device_change_rate_prior",
              "CAST(n >= 20 AND ft_country = 1 AS INTEGER) AS mature_account_new_country",
              "CAST(n >= 20 AND ft_device = 1 AS INTEGER) AS mature_account_new_device",
              "CAST(n >= 20 AND ft_country + ft_asn + ft_subnet + ft_device >= 2 AS INTEGER) AS mature_account_multi_entity_drift",
              "ft_device * ft_subnet AS new_device_and_new_subnet",
              "CAST(ft_country = 1 AND f10 >= 3 AS INTEGER) AS new_country_and_fail_burst",
              "CAST(ft_asn = 1 AND hdev > 4 AS INTEGER) AS new_asn_and_unusual_hour",
              "safb * ft_device AS success_after_fail_and_new_device",
              "ln(1 + cnt_subnet) AS gf_user_subnet_count_before", "ln(1 + cnt_asn) AS gf_user_asn_count_before",
              "ln(1 + cnt_country) AS gf_user_country_count_before", "ln(1 + cnt_device) AS gf_user_device_count_before",
              "ft_subnet AS gf_edge_user_subnet_new", "ft_asn AS gf_edge_user_asn_new",
              "ft_country AS gf_edge_user_country_new", "ft_device AS gf_edge_user_device_new",
              "ft_subnet_device AS gf_edge_user_subnet_device_new", "ft_country_device AS gf_edge_user_country_device_new",
              "ft_asn_device AS gf_edge_user_asn_device_new",
              "ft_subnet + ft_asn + ft_country + ft_device AS gf_new_entity_count",
              "1.0 * ft_subnet + 1.0 * ft_asn + 0.75 * ft_country + 1.25 * ft_device + 1.5 * ft_subnet_device AS gf_user_drift_score"]
    hf = f"""
HF AS (SELECT *, {", ".join(feats)} FROM H4)"""
    return ",".join([h1, h2, h3, hf])


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts)


def finalize(sql: str, doubles=(), ints=()) -> str:
    """Wrap a query so doubles are rounded to 6 places and integers are BIGINT."""
    rep = [f"CASE WHEN round(CAST({c} AS DOUBLE) * 1e6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({c} AS DOUBLE) * 1e6) / 1e6 END AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    if not rep:
        return sql
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({sql}) q"


def graph_ctes() -> str:
    """CTE ``GF``: entity-side graph features from self-joins on each entity key."""
    parts = []
    spec = {"subnet": ("subnet", True, True), "asn": ("asn_key", True, False),
            "country": ("country_key", False, False), "device": ("device", True, False)}
    for kind, (k, fails, hour) in spec.items():
        extra = ""
        if fails:
            extra += f""",
  count(j.event_id) AS {kind}_events, COALESCE(sum(j.fail), 0) AS {kind}_fails,
  count(DISTINCT j.user_id) FILTER (WHERE j.fail = 1) AS {kind}_failed_users,
  count(DISTINCT j.user_id) FILTER (WHERE i.login_us - j.login_us <= 600000000) AS {kind}_u10"""
        if hour:
            extra += f""",
  count(DISTINCT j.user_id) FILTER (WHERE i.login_us - j.login_us <= 3600000000) AS {kind}_u1h"""
        parts.append(f"""
G_{kind} AS (SELECT i.event_id, count(DISTINCT j.user_id) AS {kind}_users{extra}
  FROM L i LEFT JOIN L j ON j.{k} = i.{k} AND {BEFORE} GROUP BY i.event_id)""")
    parts.append("""
G0 AS (SELECT * FROM G_subnet JOIN G_asn USING (event_id) JOIN G_country USING (event_id) JOIN G_device USING (event_id)),
G1 AS (SELECT event_id,
  ln(1 + subnet_users) AS gf_subnet_user_count_before, ln(1 + asn_users) AS gf_asn_user_count_before,
  ln(1 + country_users) AS gf_country_user_count_before, ln(1 + device_users) AS gf_device_user_count_before,
  CASE WHEN subnet_events > 0 THEN subnet_fails / subnet_events ELSE 0.0 END AS gf_subnet_failure_rate_prior,
  CASE WHEN asn_events > 0 THEN asn_fails / asn_events ELSE 0.0 END AS gf_asn_failure_rate_prior,
  CASE WHEN device_events > 0 THEN device_fails / device_events ELSE 0.0 END AS gf_device_failure_rate_prior,
  ln(1 + subnet_failed_users) AS gf_subnet_failed_user_count_before,
  ln(1 + asn_failed_users) AS gf_asn_failed_user_count_before,
  ln(1 + device_failed_users) AS gf_device_failed_user_count_before,
  ln(1 + subnet_u10) AS gf_subnet_user_count_10min, ln(1 + subnet_u1h) AS gf_subnet_user_count_1hour,
  ln(1 + asn_u10) AS gf_asn_user_count_10min, ln(1 + device_u10) AS gf_device_user_count_10min,
  asn_users AS asn_user_count_before_raw, subnet_u10 AS subnet_user_count_10min_raw,
  device_u10 AS device_user_count_10min_raw
  FROM G0),
GF AS (SELECT *,
  CAST(gf_subnet_failed_user_count_before > 2.0 AND gf_subnet_failure_rate_prior > 0.5 AS INTEGER) AS gf_subnet_has_high_failure_pressure,
  CAST(gf_device_failed_user_count_before > 1.5 AND gf_device_failure_rate_prior > 0.5 AS INTEGER) AS gf_device_has_high_failure_pressure
  FROM G1)""")
    return ",".join(parts)


MODEL_SQL = ("least(1e0, 0.55e0 * (CAST((event_id * 7919 + user_id * 104729) % 1009 AS DOUBLE) / 1009e0)"
             " + 0.45e0 * is_ato + 0.2e0 * is_attack_ip)")
GRAPH_SQL = "CAST((event_id * 6007 + user_id * 31) % 997 AS DOUBLE) / 997e0"
RULE_SQL = "CAST((event_id * 389 + user_id * 17) % 11 AS DOUBLE) / 10e0"


def scored_ctes() -> str:
    """CTE ``SC``: logins with the fixture's surrogate model / graph / rule scores."""
    return f"""
SC AS (SELECT L.*, {MODEL_SQL} AS model_score, {GRAPH_SQL} AS graph_anomaly_score, {RULE_SQL} AS rule_score FROM L)"""


RULE_CASES = [
    ("subnet_user_count_10min_raw > 10", 0.4, "High Subnet Pressure (10m)"),
    ("device_user_count_10min_raw > 5", 0.3, "Shared Device Anomaly"),
    ("success_after_fail_burst = 1", 0.6, "Post-Burst Login Success"),
    ("mature_account_multi_entity_drift = 1", 0.4, "High-Confidence Account Drift"),
    ("new_country_and_fail_burst = 1", 0.5, "Cross-Border Brute Force"),
    ("is_attack_ip = 1", 0.9, "Known Malicious Infrastructure"),
]


def featured_ctes() -> str:
    """CTE ``FT``: features + rule score + surrogate model score + precision boost (dense logins)."""
    score = "0.0" + "".join(f" + CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w, _ in RULE_CASES)
    reasons = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, _, t in RULE_CASES) + ")"
    b = [("success_after_fail_burst = 1", 0.40, "SUCCESS_AFTER_BRUTEFORCE; "),
         ("gf_asn_failure_rate_prior > 0.5 AND asn_user_count_before_raw > 100 AND "
          "(fail_count_10min >= 1 OR user_login_hour_deviation > 8)", 0.25, "BOTNET_INFRA_PRESSURE; "),
         ("new_device_and_new_subnet = 1 AND first_time_country = 1 AND n > 50", 0.30, "MATURE_GEO_INFRA_MIGRATION; "),
         ("success = 1 AND first_time_country = 1 AND first_time_subnet = 1 AND gf_asn_failure_rate_prior > 0.3",
          0.30, "STEALTH_GEO_PIVOT; ")]
    boost = "0.0" + "".join(f" + CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w, _ in b)
    tags = " || ".join(f"CASE WHEN {c} THEN '{t}' ELSE '' END" for c, _, t in b)
    return f"""
FX AS (SELECT h.*, g.* EXCLUDE (event_id), {MODEL_SQL} AS model_score,
  {GRAPH_SQL} AS graph_anomaly_score FROM HF h JOIN GF g USING (event_id)),
FR AS (SELECT *, least(1.0, {score}) AS rule_score,
  CASE WHEN {reasons} = '' THEN 'Baseline' ELSE {reasons} END AS rule_reasons,
  row_number() OVER (ORDER BY model_score DESC, event_id) AS top_rank FROM FX),
FB AS (SELECT *, CASE WHEN top_rank <= 5000 THEN {boost} ELSE 0.0 END AS rule_boost,
  CASE WHEN top_rank <= 5000 THEN {tags} ELSE '' END AS reason_tags FROM FR),
FT AS (SELECT *, least(greatest(model_score + rule_boost * 1.2, 0.0), 1.0) AS final_score FROM FB)"""
