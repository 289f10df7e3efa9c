"""Hand tables (ties, exact bounds, nulls, small users) against the plain-Python walk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripwire.operators.history import user_history
from tripwire.operators.infra import graph_features
from tripwire.sources.logins import LOGIN_SCHEMA, prepare_logins

from .walk import walk

T0 = 1_704_067_200_000_000
S = 1_000_000


def _frame(spark, rows):
    from datetime import datetime, timedelta
    data = []
    for r in rows:
        ts = None if r.get("us") is None else datetime(1970, 1, 1) + timedelta(microseconds=T0 + r["us"])
        data.append((r["eid"], r["user"], ts, r.get("ip", "10.0.0.1"), r.get("country", "C0"), r.get("asn", 1000),
                     r.get("dt", "desktop"), r.get("os", "OS0"), r.get("br", "B0"), r.get("ok", 1), 1.0,
                     r.get("atk", 0), r.get("ato", 0)))
    return prepare_logins(spark.createDataFrame(data, LOGIN_SCHEMA))


def hand_rows():
    rows = []
    e = 0

    def add(user, us, **kw):
        nonlocal e
        rows.append(dict(eid=e, user=user, us=us, **kw))
        e += 1
    # ties: 4 logins of one user at the same microsecond, mixed success
    for ok in (0, 0, 1, 0):
        add(1, 10 * S, ok=ok)
    # two users on one subnet at the same instant
    add(2, 10 * S, ip="10.0.0.9")
    add(3, 10 * S, ip="10.0.0.8", ok=0)
    # exact bounds: 600 s, 600 s + 1 us, 3600 s, 3600 s + 1 us after failures
    add(4, 100 * S, ok=0)
    add(4, 100 * S + 600 * S, ok=1)
    add(5, 100 * S, ok=0)
    add(5, 100 * S + 600 * S + 1, ok=1)
    add(6, 100 * S, ok=0, ip="10.0.1.1")
    add(6, 100 * S + 3600 * S, ok=0, ip="10.0.1.2")
    add(6, 100 * S + 7200 * S + 1, ok=1, ip="10.0.1.1")
    # nulls: country, asn, ip, device fields; ip without a dot
    add(7, 50 * S, country=None, asn=None, ip=None, dt=None, os=None, br=None)
    add(7, 60 * S, ip="nodots", ok=None)
    add(7, 70 * S, country="C1")
    # all fails, then success after >= 3
    for i in range(5):
        add(8, 200 * S + i * S, ok=0, country=f"C{i % 3}")
    add(8, 206 * S, ok=1)
    # a mature user then new entities
    for i in range(22):
        add(9, 1000 * S + i * 60 * S)
    add(9, 1000 * S + 22 * 60 * S, country="C9", ip="10.9.9.9", dt="mobile", asn=4242)
    # shared infrastructure: many users on one device within 10 minutes
    for uu in range(20, 28):
        add(uu, 5000 * S + (uu - 20) * 30 * S, dt="tablet", ok=uu % 2)
    return rows


def test_history_matches_walk(spark):
    rows = hand_rows()
    df = _frame(spark, rows)
    h = graph_features(user_history(df), bucket_us=300 * S)
    got = {r["event_id"]: r for r in h.collect()}
    prep = [r.asDict() for r in df.collect()]
    exp = walk(prep)
    assert set(got) == set(exp)
    for eid, f in exp.items():
        g = got[eid]
        assert g["h_n"] == f["h_n"]
        assert g["first_time_country"] == f["ft_country"]
        assert g["first_time_subnet"] == f["ft_subnet"]
        assert g["first_time_device_combo"] == f["ft_device"]
        assert g["user_fail_count_prior"] == f["user_fail_count_prior"]
        assert g["consecutive_failures_prior"] == f["consecutive_failures_prior"], eid
        assert g["fail_count_10min"] == f["fail_count_10min"], eid
        assert g["fail_count_1hour"] == f["fail_count_1hour"], eid
        assert g["success_count_10min"] == f["success_count_10min"], eid
        assert g["new_entities_10min"] == f["new_entities_10min"], eid
        assert g["new_entities_1hour"] == f["new_entities_1hour"], eid
        assert g["secs_since_last_country_for_user"] == pytest.approx(f["secs_country"])
        assert g["user_country_count_prior"] == pytest.approx(math.log1p(f["cnt_country"]))
        for k in ("subnet", "asn", "country", "device"):
            assert g[f"gf_{k}_user_count_before"] == pytest.approx(math.log1p(f[f"gf_{k}_users"])), (eid, k)
        for k in ("subnet", "asn", "device"):
            assert g[f"gf_{k}_failed_user_count_before"] == pytest.approx(math.log1p(f[f"gf_{k}_failed_users"]))
            assert g[f"gf_{k}_failure_rate_prior"] == pytest.approx(f[f"gf_{k}_rate"])
            assert g[f"gf_{k}_user_count_10min"] == pytest.approx(math.log1p(f[f"gf_{k}_users_600000000"])), (eid, k)
        assert g["gf_subnet_user_count_1hour"] == pytest.approx(math.log1p(f["gf_subnet_users_3600000000"]))


def test_bounds_are_inclusive(spark):
    df = _frame(spark, [r for r in hand_rows() if r["user"] in (4, 5)])
    h = {r["event_id"]: r for r in user_history(df).collect()}
    ok4 = [r for r in h.values() if r["user_id"] == 4 and r["success"] == 1][0]
    ok5 = [r for r in h.values() if r["user_id"] == 5 and r["success"] == 1][0]
    assert ok4["fail_count_10min"] == 1  # exactly 600 s: still inside
    assert ok5["fail_count_10min"] == 0  # 600 s + 1 us: outside


def test_random_logins_match_walk(spark):
    rnd = random.Random(3)
    rows = []
    for e in range(400):
        rows.append(dict(eid=e, user=rnd.randrange(12), us=rnd.randrange(0, 7200) * S // 2,
                         ip=f"10.{rnd.randrange(2)}.{rnd.randrange(3)}.1", country=f"C{rnd.randrange(3)}",
                         asn=1000 + rnd.randrange(3), dt=rnd.choice(["desktop", "mobile"]), ok=rnd.randrange(2)))
    df = _frame(spark, rows)
    h = graph_features(user_history(df), bucket_us=700 * S)
    got = {r["event_id"]: r for r in h.collect()}
    exp = walk([r.asDict() for r in df.collect()])
    for eid, f in exp.items():
        g = got[eid]
        assert (g["consecutive_failures_prior"], g["fail_count_10min"], g["new_entities_1hour"]) == \
            (f["consecutive_failures_prior"], f["fail_count_10min"], f["new_entities_1hour"]), eid
        for k in ("subnet", "asn", "device"):
            assert g[f"gf_{k}_user_count_10min"] == pytest.approx(math.log1p(f[f"gf_{k}_users_600000000"])), (eid, k)
        assert g["gf_country_user_count_before"] == pytest.approx(math.log1p(f["gf_country_users"]))


def test_null_timestamp_rejected(spark):
    df = _frame(spark, [dict(eid=1, user=1, us=None), dict(eid=2, user=1, us=5 * S)])
    assert [r["event_id"] for r in df.collect()] == [2]


def test_partition_invariance(spark):
    rows = hand_rows()
    base = None
    for parts in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = _frame(spark, rows).repartition(3)
        h = graph_features(user_history(df), bucket_us=300 * S).select(
            "event_id", "fail_count_1hour", "consecutive_failures_prior", "gf_subnet_user_count_10min",
            "gf_asn_failure_rate_prior").orderBy("event_id").collect()
        base = base or h
        assert h == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_split_users_equal_whole_users(spark):
    """Users cut into buckets, down to a row each, get what one bucket gives, ties and the last hour at the edges included."""
    from tripwire.operators.history import BEHAVIOUR_FEATURES
    rnd = random.Random(5)
    rows = hand_rows()
    e = len(rows)
    # one hot user with most rows
    for i in range(300):
        rows.append(dict(eid=e + i, user=99, us=rnd.randrange(0, 9 * 3600, 60) * S, ok=rnd.randrange(2),
                         ip=f"10.{rnd.randrange(2)}.{rnd.randrange(4)}.1", country=f"C{rnd.randrange(3)}"))
    df = _frame(spark, rows)
    cols = ["event_id", *BEHAVIOUR_FEATURES, *[f"h_{x}_{n}_{y}" for n in ("country", "asn", "subnet", "device")
                                               for x, y in (("next", "us"), ("next", "eid"), ("last", "us"))],
            *[f"h_first_fail_{n}" for n in ("country", "asn", "subnet", "device")]]
    a = {r["event_id"]: r for r in user_history(df).select(*cols).collect()}
    for most in (100, 20, 1):
        b = {r["event_id"]: r for r in user_history(df, most).select(*cols).collect()}
        assert a.keys() == b.keys()
        for eid in a:
            for c in cols:
                assert a[eid][c] == pytest.approx(b[eid][c]), (most, eid, c)


def test_a_cut_user_is_spread(spark):
    """No bucket of a busy user holds more than a few times the rows asked for when they are even in time."""
    from tripwire.operators.history import split_users
    df = _frame(spark, [dict(eid=i, user=1, us=i * 60 * S, ok=1, ip="1.2.3.4", country="C") for i in range(6000)])
    x, busy = split_users(df, 500)
    per = [r["count"] for r in x.groupBy("_bkt").count().collect()]
    assert max(per) <= 1000 and len(per) >= 12 and sum(per) == 6000 and busy.count() == 1
