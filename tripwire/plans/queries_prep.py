"""Registered queries for normalisation and scalar functions (§2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import prep as P
from ..sources.logins import fixture_logins, load_fixture
from . import oracle as O
from .catalog import add, finalize
from .frames import featured

LQ = lambda dense=False: O.with_ctes(O.fixture_ctes(dense))


def q(name, spark_fn, sql, doubles=(), ints=(), section="2.2"):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


q("calendar_features", lambda s, d: load_fixture(s, d).select(
    "event_id", "hour", "dow", "is_weekend", S.hour_sin("hour").alias("login_hour_sin"),
    S.hour_cos("hour").alias("login_hour_cos")),
  LQ() + "\nSELECT event_id, hour, dow, is_weekend, sin(2 * pi() * hour / 24) AS login_hour_sin,"
  " cos(2 * pi() * hour / 24) AS login_hour_cos FROM L", ["login_hour_sin", "login_hour_cos"],
  ["event_id", "hour", "dow", "is_weekend"])
q("normalised_logins", lambda s, d: load_fixture(s, d).select(
    "event_id", "success", "fail", "is_attack_ip", "is_ato", "country_key", "asn_key", "subnet", "device",
    "missing_country", "missing_asn", "missing_device_info", "login_us"),
  LQ() + "\nSELECT event_id, success, fail, is_attack_ip, is_ato, country_key, asn_key, subnet, device,"
  " missing_country, missing_asn, missing_device_info, login_us FROM L", [],
  ["event_id", "success", "fail", "is_attack_ip", "is_ato", "missing_country", "missing_asn", "missing_device_info",
   "login_us"])
q("ip_to_int", lambda s, d: load_fixture(s, d).select("event_id", "ip", S.ip_to_int("ip").alias("ip_int")),
  LQ() + "\nSELECT event_id, ip, CASE WHEN regexp_full_match(ip, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}')"
  " AND list_max(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT))) <= 255 THEN"
  " CAST(string_split(ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip, '.')[2] AS BIGINT) * 65536"
  " + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) ELSE 0 END AS ip_int"
  " FROM L", [], ["event_id", "ip_int"])
q("log_damp_clip", lambda s, d: load_fixture(s, d).select(
    "event_id", S.log_damp(F.col("rtt_ms") - 10).alias("rtt_log"), S.clip("rtt_ms", 5.0, 50.0).alias("rtt_clip")),
  LQ() + "\nSELECT event_id, ln(1 + greatest(rtt_ms - 10, 0.0)) AS rtt_log, least(greatest(rtt_ms, 5.0), 50.0)"
  " AS rtt_clip FROM L", ["rtt_log", "rtt_clip"], ["event_id"])
q("impute", lambda s, d: P.impute(fixture_logins(s, d).select("event_id", "ip", "country", "asn", "browser")),
  LQ() + "\nSELECT event_id, COALESCE(ip, 'Unknown') AS ip, COALESCE(country, 'Unknown') AS country,"
  " COALESCE(asn, 0) AS asn, COALESCE(browser, 'Unknown') AS browser FROM raw", [], ["event_id", "asn"])
q("one_hot_device_type", lambda s, d: P.one_hot(load_fixture(s, d).select("event_id", "device_type"),
                                                "device_type", ["desktop", "mobile"]).drop("device_type"),
  LQ() + "\nSELECT event_id, CAST(device_type = 'desktop' AS INTEGER) AS device_type_desktop,"
  " CAST(device_type = 'mobile' AS INTEGER) AS device_type_mobile FROM L", [],
  ["event_id", "device_type_desktop", "device_type_mobile"])
q("standard_scale", lambda s, d: P.standard_scale(load_fixture(s, d), ["rtt_ms", "hour"])[0]
  .select("event_id", "rtt_ms_std", "hour_std"),
  LQ() + ", ST AS (SELECT avg(rtt_ms) AS m1, stddev_pop(rtt_ms) AS s1, avg(hour) AS m2, stddev_pop(hour) AS s2 FROM L)\n"
  "SELECT event_id, (rtt_ms - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END AS rtt_ms_std,"
  " (hour - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END AS hour_std FROM L, ST", ["rtt_ms_std", "hour_std"],
  ["event_id"])
q("robust_scale", lambda s, d: P.robust_scale(load_fixture(s, d), ["rtt_ms", "hour"])[0]
  .select("event_id", "rtt_ms_rob", "hour_rob"),
  LQ() + ", ST AS (SELECT quantile_cont(rtt_ms, 0.5) AS m1, quantile_cont(rtt_ms, 0.75) - quantile_cont(rtt_ms, 0.25)"
  " AS i1, quantile_cont(hour, 0.5) AS m2, quantile_cont(hour, 0.75) - quantile_cont(hour, 0.25) AS i2 FROM L)\n"
  "SELECT event_id, (rtt_ms - m1) / CASE WHEN i1 = 0 THEN 1.0 ELSE i1 END AS rtt_ms_rob,"
  " (hour - m2) / CASE WHEN i2 = 0 THEN 1.0 ELSE i2 END AS hour_rob FROM L, ST", ["rtt_ms_rob", "hour_rob"],
  ["event_id"])
q("mask_user_os_of_combo", lambda s, d: load_fixture(s, d).select(
    "event_id", S.mask_user(F.col("user_id") * 1000003).alias("masked_user"), S.os_of_combo("device").alias("os")),
  LQ() + "\nSELECT event_id, substr(CAST(user_id * 1000003 AS VARCHAR), 1, 8) || '...' AS masked_user,"
  " CASE WHEN strpos(device, '-') > 0 THEN split_part(device, '-', 2) ELSE device END AS os FROM L", [], ["event_id"])
q("alert_search", lambda s, d: load_fixture(s, d).where(S.alert_search("os2", ("user_id", "asn", "device", "ip")))
  .select("event_id"),
  LQ() + "\nSELECT event_id FROM L WHERE contains(lower(CAST(user_id AS VARCHAR)), 'os2')"
  " OR contains(lower(CAST(asn AS VARCHAR)), 'os2') OR contains(lower(device), 'os2') OR contains(lower(ip), 'os2')",
  [], ["event_id"])
q("tag_split", lambda s, d: featured(s, d).select("event_id", F.array_join(S.tag_split("reason_tags"), "|").alias("tags"))
  .where("tags != ''"),
  O.with_ctes(O.fixture_ctes(True), O.history_ctes(), O.graph_ctes(), O.featured_ctes())
  + "\nSELECT event_id, array_to_string(list_filter(list_transform(string_split(reason_tags, ';'), lambda x: trim(x)),"
  " lambda x: x != '')[1:2], '|') AS tags FROM FT WHERE reason_tags != ''", [], ["event_id"])
q("tag_counts", lambda s, d: featured(s, d).select(F.explode(S.tag_split("reason_tags", 10)).alias("tag"))
  .groupBy("tag").agg(F.count(F.lit(1)).alias("n")),
  O.with_ctes(O.fixture_ctes(True), O.history_ctes(), O.graph_ctes(), O.featured_ctes())
  + ", TG AS (SELECT unnest(list_filter(list_transform(string_split(reason_tags, ';'), lambda x: trim(x)), lambda x: x != ''))"
  " AS tag FROM FT)\nSELECT tag, count(*) AS n FROM TG GROUP BY tag", [], ["n"])
q("ml_project", lambda s, d: P.ml_project(load_fixture(s, d).select(
    "event_id", "user_id", "ip", "country_key", "success", "hour", "is_weekend", "missing_asn", "device_type",
    "is_attack_ip", "is_ato")),
  LQ() + "\nSELECT success, hour, is_weekend, missing_asn, device_type, is_ato FROM L", [],
  ["success", "hour", "is_weekend", "missing_asn", "is_ato"])
