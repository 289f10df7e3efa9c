"""Per-user comparisons that survive a hot user (one user holding a large share of all rows).

Each value is a running aggregate keyed by the user in time order, computed with
:func:`sweep.running_prior_sums`, which splits every key by time bucket and carries the totals of
earlier buckets; trailing sums take back their events when these expire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sweep import DEFAULT_BUCKET_US, ORDER, running_prior_sums

NEXT_T = "STRUCT<t: BIGINT, e: BIGINT>"


def _explode(df: DataFrame, kinds: list[dict], fields: dict[str, str]) -> DataFrame:
    """One event per (row, kind) plus expiry events of the trailing sums; ``fields``: name -> SQL type."""
    items = []

    def struct(name, key, t, ph, tie, flag, vals):
        parts = [f"'_en', '{name}'", f"'_key', CAST({key} AS STRING)", f"'_t', CAST({t} AS BIGINT)",
                 f"'_ph', {ph}", f"'_tie', CAST({tie} AS BIGINT)", f"'_kind', {flag}"]
        parts += [f"'{f}', CAST({vals.get(f, 'NULL')} AS {ty})" for f, ty in fields.items()]
        return "named_struct(" + ", ".join(parts) + ")"

    for k in kinds:
        rev = k.get("reverse", False)
        t = "-login_us" if rev else "login_us"
        tie = "-event_id" if rev else "event_id"
        own = {f: spec[0] for f, spec in k["values"].items()}
        own.update({f: e for f, (e, _) in k.get("windows", {}).items()})  # +v here, -v at expiry
        items.append(struct(k["name"], k["key"], t, 0, tie, 0, own))
        for f, (e, w) in k.get("windows", {}).items():
            items.append(struct(k["name"], k["key"], f"login_us + {w}", 1, "event_id", 1, {f: f"-({e})"}))
    x = df.selectExpr("event_id", f"explode(array({', '.join(items)})) AS _e")
    return x.selectExpr("event_id", "_e._en AS _en", "concat(_e._en, '\u0001', _e._key) AS _k",
                        *[f"_e.{c} AS {c}" for c in ORDER], *[f"_e.{f} AS {f}" for f in fields])


def _pass(df: DataFrame, kinds: list[dict], bucket_us: int) -> DataFrame:
    fields, aggs = {}, {}
    for k in kinds:
        for f, spec in k["values"].items():
            aggs[f] = spec[1]
            fields[f] = spec[2] if len(spec) > 2 else (NEXT_T if f.startswith("nx_") else "BIGINT")
        for f in k.get("windows", {}):
            aggs[f] = "sum"
            fields[f] = "BIGINT"
    ev = _explode(df, kinds, fields)
    r = running_prior_sums(ev, "_k", ORDER, [(f, aggs[f]) for f in fields], "_t", bucket_us, prefix="S_")
    own = r.where("_kind = 0")
    out = [F.max(F.when(F.col("_en") == k["name"], F.col(f"S_{f}"))).alias(f)
           for k in kinds for f in list(k["values"]) + list(k.get("windows", {}))]
    return own.groupBy("event_id").agg(*out)


PREV_T = "STRUCT<t: BIGINT, e: BIGINT, a: STRING, s: STRING, d: STRING, c: STRING>"


def sequence_shifts(df: DataFrame, geo_jump_minutes: int = 60, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Previous-login comparisons per user: gap, gap to the previous success, and whether ASN, subnet, device or country
    changed (the country change within ``geo_jump_minutes``). The previous row is the running max of
    (time, id, values) and the previous success time a running max, both split by time bucket."""
    kinds = [{"name": "u", "key": "CAST(user_id AS STRING)", "values": {
        "pv": ("named_struct('t', login_us, 'e', event_id, 'a', asn_key, 's', subnet, 'd', device, 'c', country_key)",
               "max", PREV_T),
        "ps": ("CASE WHEN success = 1 THEN login_us END", "max")}}]
    r = _pass(df.select("event_id", "user_id", "login_us", "success", "asn_key", "subnet", "device", "country_key"),
              kinds, bucket_us)
    x = df.join(r, "event_id")
    return x.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "CASE WHEN pv IS NULL THEN 0.0D ELSE (login_us - pv.t) / 1e6 END AS inter_arrival_sec",
        "CASE WHEN ps IS NULL THEN NULL ELSE (login_us - ps) / 1e6 END AS session_recency_sec",
        "CAST(pv IS NOT NULL AND pv.a != asn_key AS INT) AS asn_pivot",
        "CAST(pv IS NOT NULL AND pv.s != subnet AS INT) AS subnet_shift",
        "CAST(pv IS NOT NULL AND pv.d != device AS INT) AS device_drift",
        f"CAST(pv IS NOT NULL AND pv.c != country_key AND login_us - pv.t <= {geo_jump_minutes * 60_000_000} AS INT)"
        " AS geo_jump")


def hour_zscore(df: DataFrame, days: int = 30, bucket_us: int = 24 * 3600 * 1_000_000) -> DataFrame:
    """(hour - mean) / std of the user's login hours over the prior ``days`` days (population std; 0 when fewer than
    two prior logins or zero spread): trailing sums of 1, h, h^2 as expiry events."""
    w = days * 24 * 3600 * 1_000_000
    kinds = [{"name": "u", "key": "CAST(user_id AS STRING)", "values": {},
              "windows": {"zc": ("1", w), "zs": ("hour", w), "zq": ("hour * hour", w)}}]
    r = _pass(df.select("event_id", "user_id", "login_us", "hour"), kinds, bucket_us)
    x = df.join(r, "event_id").selectExpr("*", "CASE WHEN zc >= 2 THEN zs / zc END AS _m")
    x = x.selectExpr("*", "CASE WHEN zc >= 2 THEN sqrt(greatest(zq / zc - _m * _m, 0.0D)) END AS _sd")
    return x.selectExpr(*[f"`{c}`" for c in df.columns],
                        f"CASE WHEN _sd IS NULL OR _sd = 0 THEN 0.0D ELSE (hour - _m) / _sd END AS hour_zscore_{days}d")
