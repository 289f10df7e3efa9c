"""Column-level helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_us(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (independent of session zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {ts})") if isinstance(ts, str) \
        else F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts)


def from_epoch_us(us) -> Column:
    return F.timestamp_add("MICROSECOND", c(us), F.expr(EPOCH_NTZ))


def to_ntz(ts) -> Column:
    """Any timestamp-ish column to TIMESTAMP_NTZ (wall clock in the session zone, UTC by default)."""
    return c(ts).cast("timestamp_ntz")


def login_hour(ts) -> Column:
    return F.hour(c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(c(ts))


def is_weekend(ts) -> Column:
    return (F.weekday(c(ts)) >= 5).cast("int")


def hour_sin(h) -> Column:
    return F.sin(F.lit(2 * math.pi) * c(h) / F.lit(24.0))


def hour_cos(h) -> Column:
    return F.cos(F.lit(2 * math.pi) * c(h) / F.lit(24.0))


def ip_subnet(ip) -> Column:
    """First three dot-separated parts; null or dot-less text gives 'Unknown'."""
    ip = c(ip)
    return F.when(ip.isNull() | (F.instr(ip, ".") == 0), F.lit(UNKNOWN)) \
        .otherwise(F.substring_index(ip, ".", 3))


def device_combo(device_type, os_name, browser) -> Column:
    """type-os-browser; a missing part is written as 'Unknown' (concat_ws alone would skip it)."""
    parts = [F.coalesce(c(x).cast("string"), F.lit(UNKNOWN)) for x in (device_type, os_name, browser)]
    return F.concat_ws("-", *parts)


def entity_key(x) -> Column:
    """Null entity values become the 'Unknown' entity (a missing-flag column keeps the fact)."""
    return F.coalesce(c(x).cast("string"), F.lit(UNKNOWN))


def ip_to_int(ip) -> Column:
    """Dotted IPv4 quad to its integer value; anything else (IPv6, junk, null) gives 0."""
    ip = c(ip)
    ok = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    parts = F.split(ip, r"\.")
    octs = [parts.getItem(i).cast("bigint") for i in range(4)]
    in_range = octs[0] <= 255
    for o in octs[1:]:
        in_range = in_range & (o <= 255)
    val = octs[0] * F.lit(16777216) + octs[1] * F.lit(65536) + octs[2] * F.lit(256) + octs[3]
    return F.when(ok & in_range, val).otherwise(F.lit(0).cast("bigint"))


def log_damp(x) -> Column:
    """log(1 + max(0, x))."""
    return F.log1p(F.greatest(c(x).cast("double"), F.lit(0.0)))


def clip(x, lo=None, hi=None) -> Column:
    out = c(x)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


def norm_flag(x, default: int) -> Column:
    """Boolean / int / null flag to 0/1 int with a default for null."""
    return F.coalesce(c(x).cast("int"), F.lit(default))


def mask_user(u) -> Column:
    return F.concat(F.substring(c(u).cast("string"), 1, 8), F.lit("..."))


def os_of_combo(combo) -> Column:
    """Second '-' part of a device combo, or the whole text when there is no '-'."""
    combo = c(combo)
    return F.when(F.instr(combo, "-") > 0, F.split(combo, "-").getItem(1)).otherwise(combo)


def alert_search(term: str, cols=("user_id", "asn", "device_type", "ip")) -> Column:
    """Case-insensitive substring match over several columns (OR)."""
    t = term.lower()
    cond = F.lit(False)
    for x in cols:
        cond = cond | F.coalesce(F.lower(c(x).cast("string")).contains(t), F.lit(False))
    return cond


def tag_split(tags, keep: int = 2) -> Column:
    """Split ';'-joined reason tags, trim, drop blanks, keep the first ``keep``."""
    arr = F.transform(F.split(F.coalesce(c(tags), F.lit("")), ";"), lambda s: F.trim(s))
    arr = F.filter(arr, lambda s: s != "")
    return F.slice(arr, 1, keep)


def analyst_report(user, risk, reasons) -> Column:
    """Template verdict text for one alert (the offline form of the investigator)."""
    # fixed values: wording of the two verdicts
    crit = "CRITICAL: Account takeover likely for user %s (risk %s). Signals: %s. Action: lock account and reset credentials."
    susp = "SUSPICIOUS: Unusual login for user %s (risk %s). Signals: %s. Action: step-up verification."
    r = F.format_number(c(risk), 2)
    rs = F.coalesce(c(reasons).cast("string"), F.lit("none"))
    u = c(user).cast("string")
    return F.when(c(risk) > 0.8, F.format_string(crit, u, r, rs)).otherwise(F.format_string(susp, u, r, rs))


def round6(x) -> Column:
    return F.round(c(x).cast("double"), 6)
