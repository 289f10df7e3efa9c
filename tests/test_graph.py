"""Distributed SVD against numpy on a small graph (sign / rotation free comparison)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.operators.graph import _split_hubs, graph_svd_fit, symmetric


@pytest.mark.parametrize("hub_edges", [100_000, 2])
def test_svd_matches_numpy(spark, hub_edges):
    rng = np.random.default_rng(0)
    edges = []
    for u in range(6):
        for s in range(3):
            w = float(rng.integers(1, 5))
            edges.append((f"U{u}", f"S{s}", w))
        for d in range(2):
            edges.append((f"U{u}", f"D{d}", float(rng.integers(1, 5))))
    for s in range(3):
        for d in range(2):
            edges.append((f"S{s}", f"D{d}", float(rng.integers(1, 3))))
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    k = 3
    emb, s = graph_svd_fit(df, k=k, oversample=8, iterations=4, hub_edges=hub_edges)
    got = {r["node"]: np.array(r["vec"]) for r in emb.collect()}
    nodes = sorted(got)
    idx = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y, w in edges:
        a[idx[x], idx[y]] += w
        a[idx[y], idx[x]] += w
    u, sv, vt = np.linalg.svd(a)
    assert np.allclose(s, sv[:k], rtol=1e-6)
    e_np = u[:, :k] * np.sqrt(sv[:k])
    e_sp = np.array([got[n] for n in nodes])
    # embeddings agree up to sign / rotation: compare the Gram matrices E E^T
    assert np.allclose(e_np @ e_np.T, e_sp @ e_sp.T, atol=1e-6)


def test_no_key_of_the_join_holds_a_hub(spark):
    """A star of 20 000 leaves: no (node, salt) has more edges than twice the bound."""
    star = spark.range(20_000).select(F.lit("hub").alias("a"), F.concat(F.lit("n"), F.col("id")).alias("b"), F.lit(1.0).alias("weight"))
    adj, hubs = _split_hubs(symmetric(star), 500)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 40)]
    per = adj.groupBy("dst", "salt").count()
    assert per.agg(F.max("count")).first()[0] <= 1000 and adj.count() == 40_000


def test_sketches_hold_the_exact_counts(spark):
    from tripwire.operators import sketches as K
    x = spark.range(60_000).selectExpr("id % 7 AS asn", "concat('d', id % 3) AS device", "id * 7919 % 20000 AS user_id", "0.5D AS final_score",
                                       "timestampadd(HOUR, id % 240, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS login_ts")
    daily = K.daily_sketches(x)
    assert daily.count() == 100  # ten days, seven networks and three devices
    got = {(r["type"], r["value"]): r for r in K.merged(daily).collect()}
    for kind, col, name in (("ASN_NETWORK", "asn", lambda v: f"AS{v}"), ("DEVICE_FINGERPRINT", "device", str)):
        for r in x.groupBy(col).agg(F.countDistinct("user_id").alias("n"), F.count("*").alias("c")).collect():
            m = got[kind, name(r[col])]
            assert m["users_low"] <= r["n"] <= m["users_high"] and m["alerts"] == r["c"] and m["risk"] == 0.5
    assert K.clusters(daily, 2).count() == 4
