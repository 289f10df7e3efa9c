"""Property tests for the learned detectors: planted outliers rank first; loss falls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.operators.detectors import iforest, recon


def _planted(spark, n=2000, k=20, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4))
    out = rng.normal(8, 0.5, (k, 4))
    rows = [(i, 0, *map(float, r)) for i, r in enumerate(x)] + [(n + i, 1, *map(float, r)) for i, r in enumerate(out)]
    return spark.createDataFrame(rows, "event_id long, is_ato int, a double, b double, c double, d double")


def test_iforest_planted_outliers_rank_first(spark):
    df = _planted(spark)
    cols = ["a", "b", "c", "d"]
    m = iforest.fit(df.where("is_ato = 0"), cols, n_trees=50)
    s = iforest.decision(df, m).orderBy("iso_decision").limit(20).agg(F.sum("is_ato")).collect()[0][0]
    assert s >= 18


def test_recon_loss_falls_and_outliers_score_high(spark):
    df = _planted(spark)
    cols = ["a", "b", "c", "d"]
    normal = df.where("is_ato = 0").select(*cols)
    ws, hist = recon.fit(normal.repartition(4), normal, cols, epochs=6, patience=10)
    assert hist[-1] < hist[0]
    sc = recon.score(df, cols, ws).orderBy(F.col("recon_mse").desc()).limit(20).agg(F.sum("is_ato")).collect()[0][0]
    assert sc >= 15


def test_every_tree_has_its_whole_sample(spark):
    from tripwire.operators.detectors import iforest
    for n, want in ((1000, 256), (100, 100), (20_000, 256)):
        x = iforest.tree_samples(spark.range(n).selectExpr("id AS event_id", "id * 1.5 AS a"), ["a"], n, 100, 256, 42)
        got = {r["tree"]: r["count"] for r in x.groupBy("tree").count().collect()}
        assert got == dict.fromkeys(range(100), want)
    # the candidates of a tree stay enough, and few, at any size
    for n in (10**6, 10**9, 5 * 10**12):
        assert 256 + 9 * 16 < iforest.candidate_rate(n, 256) * n < 1000
        assert iforest.candidate_rate(n, 256) * 2**64 > 1000


def test_tree_samples_do_not_depend_on_partitions(spark):
    from tripwire.operators.detectors import iforest
    a, b = (sorted(map(tuple, iforest.tree_samples(spark.range(5000).selectExpr("id AS event_id", "id * 1.5 AS a").repartition(k),
                                                   ["a"], 5000, 7, 64, 1).collect())) for k in (1, 6))
    assert a == b


def test_detector_columns():
    from tripwire.operators.history import BEHAVIOUR_FEATURES
    from tripwire.plans import queries_models as Q
    assert len(Q.IFOREST_COLS) == len(set(Q.IFOREST_COLS)) == 37 and len(Q.RECON_COLS) == len(set(Q.RECON_COLS)) == 32
    assert set(Q.RECON_COLS) - set(BEHAVIOUR_FEATURES) == {"hour", "success"}


def test_saved_detectors_score_alike(spark):
    import tempfile

    import numpy as np

    from tripwire.operators.detectors import iforest, recon
    d = tempfile.mkdtemp(prefix="tw-model-")
    df = spark.range(600).selectExpr("id AS event_id", "id % 17 / 17D AS a", "id % 5 / 5D AS b")
    m = iforest.fit(df, ["a", "b"], n_trees=10)
    again = iforest.load(spark, iforest.save(spark, m, f"{d}/forest"))
    x, y = (np.array([r["_iso"] for r in iforest.score_samples(df, k).orderBy("event_id").collect()]) for k in (m, again))
    assert np.array_equal(x, y) and again["offset"] == m["offset"]
    ws, hist = recon.fit(df, df, ["a", "b"], epochs=3)
    assert len(hist) == 3 and hist[-1] < hist[0] * 1.5
    back, cols = recon.load(spark, recon.save(spark, ws, ["a", "b"], f"{d}/net"))
    x, y = (np.array([r["recon_mse"] for r in recon.score(df, cols, k).orderBy("event_id").collect()]) for k in (ws, back))
    assert np.array_equal(x, y)


def test_detector_bundle_round_trip(spark):
    """Nulls, a value that training did not know, and clashing columns; the loaded detector scores and flags alike."""
    import tempfile

    from tripwire.operators.detectors import bundle
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 20 == 0), float(rng.normal(3.0 * (i % 20 == 0))), None if i % 7 == 0 else float(rng.normal()),
             [None, "desktop", "mobile"][i % 3], float(i % 5)) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, is_ato int, a double, b double, device_type string, gf_user_drift_score double")
    m = bundle.train(df.where("event_id < 600"), df.where("event_id >= 600"), ["a", "b"], numTrees=20, maxDepth=6)
    assert m.names() == ["a", "b", "device_type_Unknown", "device_type_desktop", "device_type_mobile"]
    d = tempfile.mkdtemp(prefix="tw-model-") + "/m"
    m.write().overwrite().save(d)
    back = bundle.LoginDetectorModel.load(d)
    new = df.withColumn("device_type", F.when(F.col("event_id") % 2 == 0, "tablet")).withColumn("_f", F.lit(1))
    x, y = ([tuple(r) for r in k.transform(new).orderBy("event_id").select("event_id", "model_score", "model_flag", "_f").collect()] for k in (m, back))
    assert x == y and len(x) == 800 and {r[2] for r in x} == {0, 1}
    assert back.calibration() == m.calibration() and back.getOrDefault(back.threshold) == m.getOrDefault(m.threshold) > 0
    assert m.calibration()["recall"] >= 0.7
    # nulls count as 0
    a = df.limit(1).select(F.lit(1).cast("long").alias("event_id"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
                           F.lit("mobile").alias("device_type"))
    z = a.withColumn("a", F.lit(0.0)).withColumn("b", F.lit(0.0))
    assert m.transform(a).first()["model_score"] == m.transform(z).first()["model_score"]


def test_compare_names_a_winner(spark):
    from tripwire.operators.detectors import bundle
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(i % 10 == 0), float(rng.normal(2.0 * (i % 10 == 0))), 1.0, 0.5) for i in range(600)],
                               "event_id long, is_ato int, a double, c double, gf_user_drift_score double")
    good = bundle.train(df, df, ["a"], (), "rf_balanced", numTrees=10, maxDepth=5)
    poor = bundle.train(df, df, ["c"], (), "rf_balanced", numTrees=2, maxDepth=2)
    t = {r["model"]: r for r in bundle.compare({"good": good, "poor": poor}, df).collect()}
    assert t["good"]["winner"] == 1 and t["poor"]["winner"] == 0
    assert t["good"]["pr_auc"] > t["poor"]["pr_auc"] and t["good"]["p_at_50"] > 0.5 and t["good"]["p_at_1000"] is None
    assert t["good"]["tp"] + t["good"]["fn"] == 60 and t["good"]["threshold"] > 0


def test_recon_does_not_depend_on_partitions(spark):
    df = _planted(spark, n=5000)
    cols = ["a", "b", "c", "d"]
    one, many = (recon.fit(df.repartition(k), df, cols, epochs=3)[1] for k in (1, 8))
    assert len(one) == 3 and one[-1] < one[0] and np.allclose(one, many, rtol=1e-6)
    assert recon.fit(df.limit(0), df, cols, epochs=2)[1] == []


def test_a_query_writes_the_features_once(spark, monkeypatch):
    """Fitting and scoring share the splits, and the forest's rows keep their nodes (the same trees either way)."""
    from tripwire.operators.detectors import bundle
    from tripwire.plans import queries_models as Q
    made, train, small = [], bundle.train, {"gbt": {"maxIter": 2, "maxDepth": 2}}

    def features(s, d):
        made.append(d)
        x = s.range(200).selectExpr("id AS event_id", "id AS login_us", "CAST(id % 3 = 0 AS INT) AS is_ato", "'desktop' AS device_type")
        return x.select("*", *[(F.col("event_id") % (i % 7 + 2)).alias(c) for i, c in enumerate(Q.SUPERVISED_COLS)])

    monkeypatch.setattr(Q, "SUPERVISED_COLS", Q.SUPERVISED_COLS[:5])
    monkeypatch.setattr(Q, "features", features)
    monkeypatch.setattr(Q.bundle, "train", lambda tr, va, cols, kind: train(tr, va, cols, kind=kind, **small.get(kind, {"numTrees": 3, "maxDepth": 3})))
    assert Q._score("gbt")(spark, "a").count() == 40 and made == ["a"]
    assert Q._compare(spark, "b").count() == 2 and made == ["a", "b"]
    assert Q._score("rf_balanced")(spark, "b").count() == 40 and made == ["a", "b", "b"]  # fitted already

    def forest(**settings):
        est = bundle.LoginDetector(numericCols=Q.SUPERVISED_COLS, kind="rf")
        est.settings = {"numTrees": 5, **settings}
        return est.fit(features(spark, "c")).classifier.stages[-1]

    kept, walked = forest(), forest(cacheNodeIds=False)
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]


def test_training_rows_lie_in_even_shares(spark):
    """One share a core where the rows are worth it, whatever pieces they come in; a small table in one."""
    from tripwire.operators.detectors import bundle
    pieces = spark.range(39_000).union(spark.range(500)).union(spark.range(500)).coalesce(3)
    sizes = bundle._in_tasks(pieces).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 4 and max(sizes) < 10_500
    assert bundle._in_tasks(spark.range(9_000).repartition(5)).rdd.getNumPartitions() == 1


def test_compared_detectors_share_a_sample(spark, monkeypatch):
    """The sample of a comparison is drawn once, and is the one that each detector would draw."""
    from tripwire.operators.detectors import bundle
    from tripwire.plans import queries_models as Q
    drawn, fitted, draw, fit = [], [], bundle.hard_negative_sample, bundle.LoginDetector._fit
    x = spark.range(300).selectExpr("id AS event_id", "id AS login_us", "CAST(id % 3 = 0 AS INT) AS is_ato", "'desktop' AS device_type")
    x = x.select("*", *[(F.col("event_id") % (i % 7 + 2)).alias(c) for i, c in enumerate(Q.SUPERVISED_COLS[:5])])
    monkeypatch.setattr(Q, "SUPERVISED_COLS", Q.SUPERVISED_COLS[:5])
    monkeypatch.setattr(Q, "features", lambda s, d: x)
    monkeypatch.setattr(bundle, "hard_negative_sample", lambda df, label: drawn.append(1) or draw(df.withColumn("gf_user_drift_score", F.lit(0.0)), label))
    monkeypatch.setattr(bundle.LoginDetector, "_fit", lambda self, df: fitted.append(sorted(r[0] for r in df.select("event_id").collect())) or fit(self, df))
    monkeypatch.setattr(bundle, "SETTINGS", {"rf_balanced": {"numTrees": 3, "maxDepth": 3}, "gbt": {"maxIter": 2, "maxDepth": 2}})
    assert {r["model"] for r in Q._compare(spark, "shared").collect()} == {"random_forest", "gradient_boosting"}
    assert drawn == [1] and len(fitted) == 2 and fitted[0] == fitted[1]
    bundle.train(Q._splits(spark, "shared")[0], x.where("event_id >= 210"), Q.SUPERVISED_COLS, kind="rf_balanced")
    assert drawn == [1, 1] and fitted[2] == fitted[0]


def test_plain_figures_form_no_pairs(spark):
    """Ties, and more rows than the top 500: the figures of all pairs, without a join of the rows with themselves."""
    from tripwire.plans import queries_models as Q
    rows = [(i, int(i * 7919 % 13 == 0), (i * 104729 % 211) / 211, int(i % 4 == 0)) for i in range(900)]
    x = spark.createDataFrame(rows, "event_id long, is_ato int, model_score double, model_flag int")
    plain = Q._plain_figures(x)
    got = plain.first()
    pos, neg = ([r[2] for r in rows if r[1] == y] for y in (1, 0))
    assert got["auc"] == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
    best = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got["p50"] == pytest.approx(sum(r[1] for r in best[:50]) / 50)
    assert got["r500"] == pytest.approx(sum(r[1] for r in best[:500]) / len(pos))
    ap = sum(sum(r[1] for r in rows if r[2] == s) * sum(r[1] for r in rows if r[2] >= s) / sum(r[2] >= s for r in rows) for s in {r[2] for r in rows})
    assert got["ap"] == pytest.approx(ap / len(pos))
    assert (got["tp"], got["fp"]) == tuple(sum(r[3] for r in rows if r[1] == y) for y in (1, 0))
    assert "Join Inner, (" not in plain._jdf.queryExecution().analyzed().toString()


def test_only_the_sample_gets_embeddings(spark, monkeypatch):
    """The ablation draws its sample once, from rows without embeddings, and embeds that, the validation and the test part."""
    from tripwire.operators import graph as G
    from tripwire.operators.detectors import bundle
    from tripwire.plans import queries_models as Q
    drawn, embedded, draw, flat = [], [], bundle.hard_negative_sample, G.flat_embeddings
    x = spark.range(400).selectExpr("id AS event_id", "id AS login_us", "CAST(id % 3 = 0 AS INT) AS is_ato", "'desktop' AS device_type",
                                    "id % 20 AS user_id", "concat('s', id % 4) AS subnet", "concat('d', id % 5) AS device")
    x = x.select("*", *[(F.col("event_id") % (i % 7 + 2)).alias(c) for i, c in enumerate(Q.SUPERVISED_COLS[:5])])
    monkeypatch.setattr(Q, "SUPERVISED_COLS", Q.SUPERVISED_COLS[:5])
    monkeypatch.setattr(Q, "features", lambda s, d: x)
    monkeypatch.setattr(bundle, "hard_negative_sample", lambda df, label: drawn.append(df.columns) or draw(df, label, "user_id").where("event_id % 2 = 0"))
    monkeypatch.setattr(G, "flat_embeddings", lambda df, v, k: embedded.append(df.count()) or flat(df, v, k))
    monkeypatch.setattr(bundle, "SETTINGS", {"rf": {"numTrees": 3, "maxDepth": 3}})
    assert [r["variant"] for r in Q._embedding_ablation(spark, "x").collect()] == ["without_embeddings", "with_embeddings"]
    assert embedded == [140, 40, 80] and len(drawn) == 1 and not {*drawn[0]} & {*G.embedding_columns(16)}
