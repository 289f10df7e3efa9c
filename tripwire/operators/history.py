"""Per-user login history (exact, prior-only) as window functions.

All windows are partitioned by (user, time bucket) first, so after one hash exchange the whole
feature set is computed with sorts only (no further shuffles), and a user of any size is spread over
its buckets. Order of events is ``(login_us, event_id)``; "prior" means strictly earlier in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, parts_for

TEN_MIN_US = 600 * 1_000_000
ONE_HOUR_US = 3600 * 1_000_000

# (short name, entity key column) of the four entity kinds seen by a user
ENTITIES = (("country", "country_key"), ("asn", "asn_key"), ("subnet", "subnet"), ("device", "device"))
# pairs (name, cols) tracked per user
PAIRS = (("country_device", ("country_key", "device")),
         ("asn_device", ("asn_key", "device")),
         ("subnet_device", ("subnet", "device")),
         ("country_asn", ("country_key", "asn_key")))


def _ow(*keys) -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY login_us, event_id)"


def _pw(*keys) -> str:
    return f"(PARTITION BY {', '.join(keys)} ORDER BY login_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _trail(v: str, keys: str, width_us: int) -> str:
    """Sum of ``v`` over earlier rows of the same keys with ``now - t <= width_us``.

    The range frame takes in the row itself and all rows of its instant; less the sum over this row and its
    later peers of that instant, exactly the prior rows remain (ties broken by ``event_id``)."""
    return (f"(sum({v}) OVER (PARTITION BY {keys} ORDER BY login_us RANGE BETWEEN {width_us} PRECEDING AND CURRENT ROW)"
            f" - sum({v}) OVER (PARTITION BY {keys}, login_us ORDER BY event_id"
            f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


#: Rows of one user that one task may hold; a user with more is cut into time buckets.
MAX_USER_ROWS = 100_000


def split_users(logins: DataFrame, max_rows: int = MAX_USER_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``logins`` with ``_bkt``, and the users that are cut: (user_id, lo, width), None if there are none.

    A user with at most ``max_rows`` rows is one bucket. A busier one is cut into equal spans of time, as many as
    its rows ask for, each at least an hour. There are at most rows / ``max_rows`` such users."""
    busy = logins.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.min("login_us").alias("lo"), F.max("login_us").alias("_hi")) \
        .where(F.col("_n") > max_rows).selectExpr(
            "user_id", "lo", f"greatest({ONE_HOUR_US}, CAST(ceil((_hi - lo + 1) / ceil(_n / {max_rows})) AS BIGINT)) AS width")
    busy = materialize(busy)
    n = busy.limit(BROADCAST_USERS + 1).count()
    if not n:
        return logins.withColumn("_bkt", F.lit(0).cast("long")), None
    side = busy.withColumnRenamed("user_id", "_u")
    # many cut users: hashed, so that the wide rows are not sorted
    x = logins.join(F.broadcast(side) if n <= BROADCAST_USERS else side.hint("shuffle_hash"), F.col("user_id").eqNullSafe(F.col("_u")), "left")
    x = x.withColumn("_bkt", F.expr("coalesce((login_us - lo) div width, 0)"))
    return x.withColumn("_end", F.expr("lo + (_bkt + 1) * width")).drop("_u", "lo", "width"), busy


BROADCAST_USERS = 200_000
#: Items (an entity or a pair of a row) of a task; they are narrow.
ITEMS_OF_A_TASK = 300_000
_FT = {"country": "first_time_country", "asn": "first_time_asn", "subnet": "first_time_subnet", "device": "first_time_device_combo"}
_KINDS = [(n, (k,)) for n, k in ENTITIES] + list(PAIRS)


def _carried(rows: DataFrame) -> DataFrame:
    """What a bucket of a cut user must know of the user's other buckets, as rows beside its own (``_real`` = 0).

    * one row with the totals of all earlier buckets: counts, sums, first and last time, run of failures;
    * for each entity or pair that occurs in the bucket its last row before and its first row behind it;
    * the rows of the last hour before the bucket, with their first-time flags, for the trailing windows only.

    All come from aggregates by (user, bucket) and (user, entity, bucket); windows over these run along a user's
    buckets, not its rows. Every sort follows on a shuffle whose partitions are set by rows.
    """
    h = materialize(rows.where("_end IS NOT NULL").select(
        "user_id", "_bkt", "login_us", "event_id", "fail", "success", "is_weekend", "hour", *[k for _, k in ENTITIES], "_end"))
    spark, n = h.sparkSession, h.count()
    at = F.struct("login_us", "event_id")

    # entities and pairs: first and last row of each in each bucket
    item = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.concat_ws("\u0001", *cols).alias("value"),
                                        *[(F.col(k) if k in cols else F.lit(None).cast("string")).alias(k) for _, k in ENTITIES])
                               for n, cols in _KINDS]))
    # dealt by bucket before the eight items of a row unfold, so that a task's table of items is that of a bounded number of rows
    dealt = h.repartition(parts_for(spark, n), "user_id", "_bkt")
    occ = dealt.select("user_id", "_bkt", at.alias("at"), "fail", item.alias("i")).groupBy("user_id", "_bkt", "i.kind", "i.value").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max("fail").alias("fail"),
        *[F.first(f"i.{k}").alias(k) for _, k in ENTITIES])
    w = "OVER (PARTITION BY user_id, kind, value ORDER BY _bkt"
    occ = occ.repartition(parts_for(spark, n * len(_KINDS), ITEMS_OF_A_TASK), "user_id", "kind", "value")
    occ = materialize(occ.selectExpr("*", f"lag(last) {w}) AS before", f"lead(first) {w}) AS behind",
                                     f"max(fail) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed"))
    keys = [k for _, k in ENTITIES]
    near = [occ.where(f"{side} IS NOT NULL").selectExpr("user_id", "_bkt", f"{side}.login_us AS login_us", f"{side}.event_id AS event_id", *keys,
                                                        f"{fe} AS _fe") for side, fe in (("before", "failed"), ("behind", "0"))]
    # first-time flags of the rows that are a first
    firsts = occ.where("before IS NULL").selectExpr("user_id", "_bkt", "first.event_id AS event_id", *[f"CAST(kind = '{n}' AS INT) AS _ft_{n}" for n, _ in ENTITIES])

    # totals by bucket, then of all earlier buckets
    tot = dealt.select("*", at.alias("at"), F.expr("max(CASE WHEN success = 1 THEN struct(login_us, event_id) END) OVER (PARTITION BY user_id, _bkt)").alias("ok")) \
        .groupBy("user_id", "_bkt").agg(
            F.count(F.lit(1)).alias("n"), F.min("login_us").alias("mn"), F.max("at").alias("mx"), F.sum("is_weekend").alias("wk"),
            F.sum("hour").alias("hr"), F.sum("fail").alias("f"), F.sum("success").alias("s"),
            F.sum(F.expr("CASE WHEN ok IS NOT NULL THEN CASE WHEN at > ok THEN fail ELSE 0 END END")).alias("tail"))
    tot = materialize(tot)
    new = firsts.groupBy("user_id", "_bkt").agg(*[F.sum(f"_ft_{n}").alias(f"new_{n}") for n, _ in ENTITIES])
    # a bucket's totals and its number of new entities come as two rows, which need no join on a key that may be null
    both = tot.unionByName(new, allowMissingColumns=True).repartition(parts_for(spark, 2 * tot.count()), "user_id")
    t = both.groupBy("user_id", "_bkt").agg(*[F.max(c).alias(c) for c in tot.columns[2:]],
                                            *[F.coalesce(F.max(f"new_{n}"), F.lit(0)).alias(f"new_{n}") for n, _ in ENTITIES])
    p = "OVER (PARTITION BY user_id ORDER BY _bkt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    t = t.selectExpr("*", f"coalesce(sum(f) {p}, 0) AS f0").selectExpr("*", "f0 + f - tail AS upto")
    state = t.selectExpr("user_id", "_bkt", f"max(mx) {p} AS mx", f"sum(n) {p} AS _c", f"min(mn) {p} AS _first", f"sum(wk) {p} AS _wk", f"sum(hr) {p} AS _hr",
                         "f0 AS _f", f"sum(s) {p} AS _s", f"coalesce(last(upto, true) {p}, 0) AS _upto",
                         *[f"sum(new_{n}) {p} AS _ft_{n}" for n, _ in ENTITIES]).where("mx IS NOT NULL") \
        .selectExpr("* EXCEPT (mx)", "mx.login_us AS login_us", "mx.event_id AS event_id", "mx.login_us AS _us")

    # the rows of the last hour beside the firsts of their bucket: a row takes the flags that carry its id
    halo = h.where(F.col("login_us") >= F.col("_end") - ONE_HOUR_US).selectExpr("user_id", "_bkt", "login_us", "event_id", "fail AS _tf", "success AS _ts", "1 AS _own")
    flagged = halo.unionByName(firsts, allowMissingColumns=True).repartition(parts_for(spark, n * (1 + len(_KINDS)), ITEMS_OF_A_TASK), "user_id", "_bkt")
    halo = flagged.selectExpr("*", *[f"coalesce(max(_ft_{n}) OVER (PARTITION BY user_id, _bkt, event_id), 0) AS _tn_{n}" for n, _ in ENTITIES]) \
        .where("_own = 1").selectExpr("user_id", "_bkt + 1 AS _bkt", "login_us", "event_id", "_tf", "_ts", *[f"_tn_{n}" for n, _ in ENTITIES])
    out = near[0]
    for d in (near[1], state, halo):
        out = out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("_real", F.lit(0))


def user_history(logins: DataFrame, max_rows: int = MAX_USER_ROWS) -> DataFrame:
    """All behaviour features of one login relative to the same user's earlier logins.

    Input: prepared logins. Output: input columns + behaviour features + helper columns
    (prefixed ``h_``) that later stages (entity passes, streaming parity) reuse. All windows are
    partitioned by (user, time bucket), so that one exchange feeds them all; a user with at most ``max_rows``
    rows is one bucket, and the buckets of a busier one also hold what they must know of each other
    (:func:`_carried`). Expressions are SQL text (one JVM call per stage instead of thousands of Column calls).
    """
    own = [f"`{c}`" for c in logins.columns]
    rows, busy = split_users(logins, max_rows)
    df = rows.drop("_end").selectExpr("*", "1 AS _real", "1L AS _c", "login_us AS _us", "login_us AS _first", "is_weekend AS _wk", "hour AS _hr", "fail AS _f",
                         "success AS _s", "fail AS _tf", "success AS _ts", "fail AS _fe", "CAST(NULL AS BIGINT) AS _upto")
    n = logins.count()
    if busy is not None:
        carried = materialize(_carried(rows))
        n += carried.count()
        df = df.unionByName(carried, allowMissingColumns=True)
    else:
        df = df.selectExpr("*", *[f"0 AS {p}_{n}" for p in ("_ft", "_tn") for n, _ in ENTITIES])
    # each of the sorts below holds all rows of its task: their number is set here, not by the bytes of the shuffle. Where no user is cut
    # the bucket is a constant, which the windows' keys lose: dealt by it too, all rows would be shuffled once more, by bytes
    by = ["user_id"] if busy is None else ["user_id", "_bkt"]
    df = df.repartition(parts_for(logins.sparkSession, n), *by)
    u = ", ".join(by)
    p, w = _pw(u), _ow(u)
    cols = [
        f"coalesce(sum(_c) OVER {p}, 0) AS h_n",
        f"last(_us, true) OVER {p} AS h_prev_us",
        f"min(_first) OVER {p} AS h_first_us",
        f"coalesce(sum(_wk) OVER {p}, 0) AS h_weekend_prior",
        f"coalesce(sum(_hr) OVER {p}, 0) AS h_hour_sum",
        f"CAST(coalesce(sum(_f) OVER {p}, 0) AS BIGINT) AS user_fail_count_prior",
        f"CAST(coalesce(sum(_s) OVER {p}, 0) AS BIGINT) AS user_success_count_prior",
        f"CAST({_trail('coalesce(_tf, 0)', u, TEN_MIN_US)} AS BIGINT) AS fail_count_10min",
        f"CAST({_trail('coalesce(_tf, 0)', u, ONE_HOUR_US)} AS BIGINT) AS fail_count_1hour",
        f"CAST({_trail('coalesce(_ts, 0)', u, TEN_MIN_US)} AS BIGINT) AS success_count_10min",
    ]
    for name, key in ENTITIES:
        w = _ow(u, key)
        cols += [
            f"CAST(row_number() OVER {w} = 1 AS INT) AS {_FT[name]}",
            f"lag(login_us) OVER {w} AS h_last_{name}_us",
            # first failing row of (user, entity): input of failed-user counts per entity
            f"CAST(fail = 1 AND coalesce(sum(_fe) OVER {_pw(u, key)}, 0) = 0 AS INT) AS h_first_fail_{name}",
            f"lead(login_us) OVER {w} AS h_next_{name}_us",
            f"lead(event_id) OVER {w} AS h_next_{name}_eid",
        ]
    for name, keys in PAIRS:
        w = _ow(u, *keys)
        cols.append(f"CAST(row_number() OVER {w} = 1 AS INT) AS h_ft_{name}")
        if name != "country_asn":
            cols.append(f"lag(login_us) OVER {w} AS h_last_{name}_us")
    df = df.selectExpr("*", *cols)
    # new entities of a row: its own flags, those that a row of the hour before brings along; in the totals their number so far
    df = df.selectExpr("*", *[f"CASE WHEN _real = 1 THEN {_FT[n]} ELSE coalesce(_ft_{n}, 0) END AS _cnt_{n}" for n, _ in ENTITIES],
                       *[f"CASE WHEN _real = 1 THEN {_FT[n]} ELSE coalesce(_tn_{n}, 0) END AS _new_{n}" for n, _ in ENTITIES],
                       "CASE WHEN _real = 0 THEN _upto WHEN success = 1 THEN user_fail_count_prior END AS _ok")
    all4 = "(" + " + ".join(f"_new_{n}" for n, _ in ENTITIES) + ")"
    df = df.selectExpr(
        "*",
        *[f"coalesce(sum(_cnt_{n}) OVER {p}, 0) AS h_cnt_{n}" for n, _ in ENTITIES],
        # failures so far, less those up to the last success
        f"user_fail_count_prior - coalesce(last(_ok, true) OVER {p}, 0) AS consecutive_failures_prior",
        f"CAST({_trail(all4, u, TEN_MIN_US)} AS BIGINT) AS new_entities_10min",
        f"CAST({_trail(all4, u, ONE_HOUR_US)} AS BIGINT) AS new_entities_1hour",
        f"CAST({_trail('_new_subnet', u, ONE_HOUR_US)} AS BIGINT) AS new_subnets_1hour",
        f"CAST({_trail('_new_device', u, ONE_HOUR_US)} AS BIGINT) AS new_device_combos_1hour",
    ).where("_real = 1")
    made = [c for c in df.columns if not c.startswith("_") and c not in logins.columns]
    return derive(df.selectExpr(*own, *made))


def derive(df: DataFrame) -> DataFrame:
    """Helper columns -> behaviour features (shared by the batch and the streaming plans)."""
    df = df.selectExpr("*", "CASE WHEN h_n >= 2 THEN ((h_prev_us - h_first_us) / 1e6) / (h_n - 1) ELSE 1.0 END AS h_gap0",
                       "CASE WHEN h_n >= 2 THEN h_hour_sum / h_n ELSE CAST(hour AS DOUBLE) END AS h_mhour",
                       "CASE WHEN h_n > 0 THEN h_weekend_prior / h_n ELSE 0.0 END AS h_wrate",
                       "CASE WHEN h_prev_us IS NULL THEN 0.0 ELSE (login_us - h_prev_us) / 1e6 END AS h_since",
                       "greatest(1, least(h_n, 100)) AS h_rate_base",
                       "CAST(success = 1 AND fail_count_10min >= 3 AS INT) AS success_after_fail_burst")
    df = df.selectExpr("*", "CASE WHEN h_gap0 = 0 THEN 1.0 ELSE h_gap0 END AS h_mean_gap",
                       "CASE WHEN h_n >= 2 THEN least(abs(hour - h_mhour), 24 - abs(hour - h_mhour)) ELSE 0.0 END"
                       " AS user_login_hour_deviation")
    return df.selectExpr("*", *behaviour_exprs())


def behaviour_exprs() -> list[str]:
    """Feature expressions over the helper columns (no windows)."""
    def secs(n):
        return f"CASE WHEN h_last_{n}_us IS NULL THEN 0.0 ELSE (login_us - h_last_{n}_us) / 1e6 END"

    out = [
        "log1p(h_n) AS user_login_count_prior",
        "sin(2 * pi() * hour / 24) AS login_hour_sin",
        "cos(2 * pi() * hour / 24) AS login_hour_cos",
        "dow AS login_day_of_week",
        "h_wrate AS user_weekend_login_rate_prior",
        "CAST((is_weekend = 1 AND h_wrate < 0.1) OR (is_weekend = 0 AND h_wrate > 0.9) AS INT) AS weekend_behavior_deviation",
        "log1p(h_cnt_country) AS user_country_count_prior",
        "log1p(h_cnt_asn) AS user_asn_count_prior",
        "log1p(h_cnt_subnet) AS user_subnet_count_prior",
        "log1p(h_cnt_device) AS user_device_combo_count_prior",
    ]
    for name, _ in ENTITIES:
        ft = "first_time_device_combo" if name == "device" else f"first_time_{name}"
        out += [f"1 - {ft} AS seen_{name}_before", f"{secs(name)} AS secs_since_last_{name}_for_user",
                f"{secs(name)} / h_mean_gap AS recency_{name}_normalized"]
    for name in ("country_device", "asn_device", "subnet_device"):
        out += [f"1 - h_ft_{name} AS seen_{name}_before", f"{secs(name)} AS secs_since_last_{name}_for_user"]
    out += [
        "h_ft_country_device AS first_time_country_device_combo",
        "h_ft_asn_device AS first_time_asn_device_combo",
        "h_ft_subnet_device AS first_time_subnet_device_combo",
        "h_ft_country_asn AS first_time_country_asn",
        "h_mhour AS user_mean_login_hour_prior",
        "CASE WHEN h_n >= 2 THEN least(h_mean_gap, 100.0) ELSE 0.0 END AS user_mean_time_between_logins_prior",
        "h_since AS time_since_last_login_sec",
        "CASE WHEN h_n >= 2 THEN least(h_since / h_mean_gap, 100.0) ELSE 0.0 END AS time_gap_deviation_ratio",
        "CASE WHEN h_n > 0 THEN user_fail_count_prior / h_n ELSE 0.0 END AS user_failure_rate_prior",
        "CAST(success = 1 AND consecutive_failures_prior >= 3 AS INT) AS success_after_consecutive_fails",
        "fail_count_10min AS recent_fail_burst",
        "CASE WHEN fail_count_10min + success_count_10min > 0 THEN fail_count_10min / "
        "(fail_count_10min + success_count_10min) ELSE 0.0 END AS recent_fail_success_ratio",
        "h_cnt_country / h_rate_base AS country_change_rate_prior",
        "h_cnt_asn / h_rate_base AS asn_change_rate_prior",
        "h_cnt_subnet / h_rate_base AS subnet_change_rate_prior",
        "h_cnt_device / h_rate_base AS device_change_rate_prior",
        "CAST(h_n >= 20 AND first_time_country = 1 AS INT) AS mature_account_new_country",
        "CAST(h_n >= 20 AND first_time_device_combo = 1 AS INT) AS mature_account_new_device",
        "CAST(h_n >= 20 AND first_time_country + first_time_asn + first_time_subnet + first_time_device_combo >= 2"
        " AS INT) AS mature_account_multi_entity_drift",
        "first_time_device_combo * first_time_subnet AS new_device_and_new_subnet",
        "CAST(first_time_country = 1 AND fail_count_10min >= 3 AS INT) AS new_country_and_fail_burst",
        "CAST(first_time_asn = 1 AND user_login_hour_deviation > 4 AS INT) AS new_asn_and_unusual_hour",
        "success_after_fail_burst * first_time_device_combo AS success_after_fail_and_new_device",
        # user side of the infrastructure graph (same state, graph naming)
        "log1p(h_cnt_subnet) AS gf_user_subnet_count_before",
        "log1p(h_cnt_asn) AS gf_user_asn_count_before",
        "log1p(h_cnt_country) AS gf_user_country_count_before",
        "log1p(h_cnt_device) AS gf_user_device_count_before",
        "first_time_subnet AS gf_edge_user_subnet_new",
        "first_time_asn AS gf_edge_user_asn_new",
        "first_time_country AS gf_edge_user_country_new",
        "first_time_device_combo AS gf_edge_user_device_new",
        "h_ft_subnet_device AS gf_edge_user_subnet_device_new",
        "h_ft_country_device AS gf_edge_user_country_device_new",
        "h_ft_asn_device AS gf_edge_user_asn_device_new",
        "first_time_subnet + first_time_asn + first_time_country + first_time_device_combo AS gf_new_entity_count",
        "1.0D * first_time_subnet + 1.0D * first_time_asn + 0.75D * first_time_country + 1.25D * first_time_device_combo"
        " + 1.5D * h_ft_subnet_device AS gf_user_drift_score",
    ]
    return out


# fixed values: the 71 behaviour feature names, in their original order
BEHAVIOUR_FEATURES = [
    "missing_country", "missing_asn", "missing_device_info", "user_login_count_prior",
    "login_hour_sin", "login_hour_cos", "login_day_of_week", "is_weekend",
    "user_weekend_login_rate_prior", "weekend_behavior_deviation",
    "first_time_country", "first_time_asn", "first_time_subnet", "first_time_device_combo",
    "user_country_count_prior", "user_asn_count_prior", "user_subnet_count_prior",
    "user_device_combo_count_prior",
    "seen_country_before", "secs_since_last_country_for_user", "recency_country_normalized",
    "seen_asn_before", "secs_since_last_asn_for_user", "recency_asn_normalized",
    "seen_subnet_before", "secs_since_last_subnet_for_user", "recency_subnet_normalized",
    "seen_device_before", "secs_since_last_device_for_user", "recency_device_normalized",
    "seen_country_device_before", "secs_since_last_country_device_for_user",
    "seen_asn_device_before", "secs_since_last_asn_device_for_user",
    "seen_subnet_device_before", "secs_since_last_subnet_device_for_user",
    "first_time_country_device_combo", "first_time_asn_device_combo",
    "first_time_subnet_device_combo", "first_time_country_asn",
    "user_mean_login_hour_prior", "user_login_hour_deviation",
    "user_mean_time_between_logins_prior", "time_since_last_login_sec", "time_gap_deviation_ratio",
    "user_fail_count_prior", "user_success_count_prior", "user_failure_rate_prior",
    "consecutive_failures_prior", "success_after_consecutive_fails",
    "fail_count_10min", "fail_count_1hour", "success_count_10min", "recent_fail_burst",
    "success_after_fail_burst", "recent_fail_success_ratio",
    "new_entities_10min", "new_entities_1hour", "new_subnets_1hour", "new_device_combos_1hour",
    "country_change_rate_prior", "asn_change_rate_prior", "subnet_change_rate_prior",
    "device_change_rate_prior",
    "mature_account_new_country", "mature_account_new_device", "mature_account_multi_entity_drift",
    "new_device_and_new_subnet", "new_country_and_fail_burst", "new_asn_and_unusual_hour",
    "success_after_fail_and_new_device",
]
