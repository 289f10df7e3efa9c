"""Registered queries for the detectors (§2.12) and model persistence (§2.1).

Learned models cannot be matched bit for bit with another engine: these run on the whole
fixture and are checked by row count in the driver and by property tests here. Their
calibration steps are value-checked on the fixture's fixed scores. All are fitted at the operators' own
settings; a detector is fitted once per application and read back by the queries that use it. What can be
said of learned results in SQL is: the ids of the training sample, that a reload and a stream score
exactly alike, and that the reported figures are those of the written scores.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prep as P
from ..operators.detectors import bundle, iforest, recon
from ..operators.history import BEHAVIOUR_FEATURES
from ..operators.infra import GRAPH_ENTITY_FEATURES
from ..operators.sampling import temporal_split
from ..session import exists, materialize, scratch_path
from ..sources.logins import fixture_logins
from ..streaming.runner import read_scores, run_states, score_logins, write_log_files
from . import oracle as O
from .catalog import add, finalize
from .frames import features, scored
from .queries_io import state_parts

SC = lambda: O.with_ctes(O.fixture_ctes(False), O.scored_ctes())

GF_USER = ["gf_user_subnet_count_before", "gf_user_asn_count_before", "gf_user_country_count_before",
           "gf_user_device_count_before", "gf_edge_user_subnet_new", "gf_edge_user_asn_new", "gf_edge_user_country_new",
           "gf_edge_user_device_new", "gf_edge_user_subnet_device_new", "gf_edge_user_country_device_new",
           "gf_edge_user_asn_device_new", "gf_new_entity_count", "gf_user_drift_score"]
# fixed values: the 37 graph-side inputs of the isolation forest
IFOREST_COLS = GF_USER + GRAPH_ENTITY_FEATURES + [
    "user_login_count_prior", "user_login_hour_deviation", "time_gap_deviation_ratio", "fail_count_10min", "fail_count_1hour",
    "recent_fail_burst", "success_after_fail_burst", "time_since_last_login_sec"]
# fixed values: the 32 behaviour inputs of the reconstruction network
RECON_COLS = [
    "hour", "time_since_last_login_sec", "time_gap_deviation_ratio", "user_login_hour_deviation", "user_mean_login_hour_prior",
    "first_time_country", "first_time_asn", "first_time_subnet", "first_time_device_combo",
    "first_time_country_device_combo", "first_time_asn_device_combo",
    "user_login_count_prior", "user_country_count_prior", "user_asn_count_prior",
    "secs_since_last_country_for_user", "secs_since_last_device_for_user",
    "success", "fail_count_10min", "fail_count_1hour", "success_after_fail_burst", "recent_fail_success_ratio",
    "recency_country_normalized", "recency_asn_normalized", "recency_subnet_normalized", "recency_device_normalized",
    "seen_country_before", "seen_asn_before", "seen_subnet_before", "seen_device_before",
    "consecutive_failures_prior", "new_entities_10min", "new_entities_1hour"]
SUPERVISED_COLS = list(BEHAVIOUR_FEATURES) + GF_USER + GRAPH_ENTITY_FEATURES


def q(name, spark_fn, sql=None, doubles=(), ints=(), section="2.12"):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


def _splits(s, d):
    f = materialize(temporal_split(features(s, d)))
    return f.where("split = 'train'"), f.where("split = 'val'"), f.where("split = 'test'")


_FITTED: dict[tuple[str, str, str], str] = {}


def _fitted(s, d, kind) -> bool:
    key = (s.sparkContext.applicationId, d, kind)
    return key in _FITTED and exists(s, _FITTED[key])  # else not fitted, or released in between


def detector(s, d, kind="rf", splits=None) -> bundle.LoginDetectorModel:
    """The detector of a kind, fitted once per application and input at its full settings, saved, and read back. ``splits``: what
    :func:`_splits` returned, from a query that scores a part too, so that it writes the features once (its training part may be the sample)."""
    key = (s.sparkContext.applicationId, d, kind)
    if not _fitted(s, d, kind):
        tr, va, _ = splits or _splits(s, d)
        path = scratch_path(s, "models")
        bundle.train(tr, va, SUPERVISED_COLS, kind=kind).write().overwrite().save(path)
        _FITTED[key] = path
    return bundle.LoginDetectorModel.load(_FITTED[key])


def _test_part(s, d, splits=None):
    return (splits or _splits(s, d))[2].select("event_id", "is_ato", "device_type", *SUPERVISED_COLS)


def _scored_test_part(s, d, kind):
    splits = _splits(s, d)
    return detector(s, d, kind, splits).transform(_test_part(s, d, splits)).select("event_id", "is_ato", "model_score", "model_flag")


def _score(kind):
    return lambda s, d: _scored_test_part(s, d, kind)


q("rf_score", _score("rf"))
q("rf_balanced_score", _score("rf_balanced"))
q("gbt_score", _score("gbt"))


def _compare(s, d):
    """Both detectors are fitted side by side, on one sample: the boosting rounds, one after another, do not fill the cores."""
    splits = _splits(s, d)
    kinds = {"random_forest": "rf_balanced", "gradient_boosting": "gbt"}
    if not all(_fitted(s, d, kind) for kind in kinds.values()):
        splits = (bundle.training_sample(splits[0], [*SUPERVISED_COLS, "device_type"]), *splits[1:])
    models = bundle.side_by_side([partial(detector, s, d, kind, splits) for kind in kinds.values()])
    return bundle.compare(dict(zip(kinds, models, strict=True)), splits[1])


q("model_compare", _compare)
q("top_features", lambda s, d: bundle.top_features(detector(s, d), s, 15), section="2.10")


def _persist_roundtrip(s, d):
    """Scores, flags and inputs of a detector saved and loaded again, less those of the first: nothing differs."""
    splits = _splits(s, d)
    m, te = detector(s, d, splits=splits), _test_part(s, d, splits)
    path = scratch_path(s, "models")
    m.write().overwrite().save(path)
    again = bundle.LoginDetectorModel.load(path)
    if (again.names(), again.words(), again.calibration(), again.uid) != (m.names(), m.words(), m.calibration(), m.uid):
        raise RuntimeError("the loaded detector differs")
    x = m.transform(te).select("event_id", "model_score", "model_flag")
    y = again.transform(te).select("event_id", F.col("model_score").alias("s2"), F.col("model_flag").alias("f2"))
    return x.join(y, "event_id").select("event_id", (F.col("model_score") - F.col("s2")).alias("score_diff"),
                                        (F.col("model_flag") - F.col("f2")).alias("flag_diff"))


_TEST_IDS = ", P AS (SELECT event_id, row_number() OVER (ORDER BY login_us, event_id) - 1 AS pos, count(*) OVER () AS n FROM L)"
q("model_save_load", _persist_roundtrip, O.with_ctes(O.fixture_ctes(True)) + _TEST_IDS
  + "\nSELECT event_id, 0.0 AS score_diff, 0 AS flag_diff FROM P WHERE pos >= floor(n * 0.8)", ["score_diff"], ["event_id", "flag_diff"], section="2.1")


def _training_sample(s, d):
    """The ids that the detector is fitted on."""
    from ..operators.sampling import hard_negative_sample
    return hard_negative_sample(_splits(s, d)[0].select("event_id", "is_ato", "gf_user_drift_score")).select("event_id", "part")


q("model_training_sample", _training_sample, O.with_ctes(O.fixture_ctes(True), O.history_ctes())
  + ", P AS (SELECT event_id, is_ato, gf_user_drift_score, row_number() OVER (ORDER BY login_us, event_id) - 1 AS pos, count(*) OVER () AS n FROM HF),"
  " T AS (SELECT * FROM P WHERE pos < floor(n * 0.7)), N AS (SELECT *, row_number() OVER (ORDER BY gf_user_drift_score DESC, event_id) AS r,"
  " count(*) OVER () AS c FROM T WHERE is_ato = 0), R AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || ':42'), event_id) AS r"
  " FROM N WHERE c <= 25000 OR r > 25000)\nSELECT event_id, 'positive' AS part FROM T WHERE is_ato = 1 UNION ALL"
  " SELECT event_id, 'hard' FROM N WHERE c > 25000 AND r <= 25000 UNION ALL SELECT event_id, 'random' FROM R WHERE r <= 150000",
  [], ["event_id"], section="2.9")


def _plain_figures(x):
    """The figures of a report as one window over the scores gives them, apart from the operators. The area is the share of all pairs
    of a positive and a negative that stand in order, ties half; they are counted by score, not formed."""
    x.createOrReplaceTempView("_scores_to_check")
    return x.sparkSession.sql("""
      WITH c AS (SELECT sum(is_ato) AS p, count(*) AS n, sum(model_flag * is_ato) AS tp, sum(model_flag * (1 - is_ato)) AS fp FROM _scores_to_check),
      b AS (SELECT is_ato, row_number() OVER (ORDER BY model_score DESC, event_id) AS rk FROM (
        SELECT * FROM _scores_to_check ORDER BY model_score DESC, event_id LIMIT 500)),
      k AS (SELECT sum(CASE WHEN rk <= 50 THEN is_ato END) / 50 AS p50, sum(is_ato) AS h500 FROM b),
      t AS (SELECT model_score, sum(is_ato) AS h, count(*) AS m FROM _scores_to_check GROUP BY model_score),
      u AS (SELECT h, m, sum(h) OVER w AS tp, sum(m) OVER w AS k FROM t WINDOW w AS (ORDER BY model_score DESC)),
      a AS (SELECT sum(h * tp / k) AS ap, sum(CAST(h AS DOUBLE) * ((k - tp) - 0.5D * (m - h))) AS above FROM u)
      SELECT c.*, k.p50, k.h500 / c.p AS r500, a.ap / c.p AS ap, 1 - a.above / nullif(CAST(c.p AS DOUBLE) * (c.n - c.p), 0) AS auc FROM c, k, a""")


def _report_check(s, d):
    """The detector's report on the test part less the same figures by one window over its written scores: nothing differs."""
    splits = _splits(s, d)
    m = detector(s, d, splits=splits)
    x = materialize(m.transform(_test_part(s, d, splits)).select("event_id", "is_ato", "model_score", "model_flag", F.lit("rf").alias("model")))
    r = bundle.report(x, "is_ato", "model_score", m._get("threshold"))
    plain = _plain_figures(x)
    return r.crossJoin(F.broadcast(plain)).select(  # one row each
        *[F.abs(F.col(a).cast("double") - F.col(b).cast("double")).alias(f"{a}_diff") for a, b in (
            ("roc_auc", "auc"), ("pr_auc", "ap"))], *[F.abs(r[a].cast("double") - plain[b].cast("double")).alias(f"{a}_diff")
                                                     for a, b in (("tp", "tp"), ("fp", "fp"), ("p_at_50", "p50"), ("r_at_500", "r500"))])


q("model_report_check", _report_check, "SELECT " + ", ".join(f"0.0 AS {c}_diff" for c in ("roc_auc", "pr_auc", "tp", "fp", "p_at_50", "r_at_500")),
  [f"{c}_diff" for c in ("roc_auc", "pr_auc", "tp", "fp", "p_at_50", "r_at_500")], section="2.14")


def _stream_model(s, d):
    """Logins scored by the fitted detector as a stream, less the batch scores of the same logins."""
    base, m = scratch_path(s, "stream-model"), detector(s, d)
    src = write_log_files(fixture_logins(s, d, True), f"{base}/in", 6)
    run_states(s, src, f"{base}/rows", 2, f"{base}/ck", with_entities=True, state_partitions=state_parts(fixture_logins(s, d, True)))
    score_logins(s, f"{base}/rows", fixture_logins(s, d, True).select("event_id", "device_type", "is_ato"), m, f"{base}/scores", f"{base}/top", 500)
    batch = m.transform(materialize(features(s, d))).select("event_id", F.col("model_score").alias("b"))
    return read_scores(s, f"{base}/scores").join(batch, "event_id").select("event_id", "is_ato", (F.col("model_score") - F.col("b")).alias("score_diff"))


q("stream_model_score", _stream_model, O.with_ctes(O.fixture_ctes(True)) + "\nSELECT event_id, is_ato, 0.0 AS score_diff FROM L",
  ["score_diff"], ["event_id", "is_ato"], section="2.15")


def _embedding_ablation(s, d):
    """The detector's report with and without all 54 embedding inputs, at its own settings; the vectors are the SVD of the
    training part's graph. The sample is drawn before its rows get their embeddings (the same rows: it does not look at them),
    and both variants are fitted side by side."""
    from ..operators import graph as G
    tr, va, te = _splits(s, d)
    vectors = materialize(G.graph_svd_fit(G.tripartite_edges(tr), k=16)[0])
    sample = bundle.training_sample(tr, [*SUPERVISED_COLS, "device_type", "user_id", "subnet", "device"]).rows
    needed = ["event_id", "is_ato", "device_type", *SUPERVISED_COLS, "user_id", "subnet", "device"]
    tr, va, te = (materialize(G.flat_embeddings(x.select(*needed), vectors, 16)) for x in (sample, va, te))

    def variant(name, extra):
        m = bundle.train(bundle.Sample(tr), va, SUPERVISED_COLS + extra)
        sc = materialize(m.transform(te).select("event_id", "is_ato", "model_score", F.lit(name).alias("model")))
        return materialize(bundle.report(sc, "is_ato", "model_score", m._get("threshold")).withColumnRenamed("model", "variant"))
    return reduce(DataFrame.unionByName, bundle.side_by_side([
        partial(variant, name, extra) for name, extra in (("without_embeddings", []), ("with_embeddings", G.embedding_columns(16)))]))


q("embedding_ablation", _embedding_ablation)


def _iforest(s, d):
    tr, va, te = _splits(s, d)
    normal = tr.where("is_ato = 0")
    scaled_tr, stats = P.robust_scale(normal, IFOREST_COLS)
    cols = [f"{c}_rob" for c in IFOREST_COLS]
    model = iforest.fit(scaled_tr.select("event_id", *cols), cols)
    va_s = iforest.decision(P.robust_scale(va, IFOREST_COLS, stats)[0].select("event_id", "is_ato", *cols), model)
    bounds, _ = iforest.calibrate(va_s.where("is_ato = 0"), "iso_decision")
    te_s = iforest.decision(P.robust_scale(te, IFOREST_COLS, stats)[0].select("event_id", "is_ato", *cols), model)
    return iforest.normalize(te_s, "iso_decision", bounds).select("event_id", "is_ato", "graph_anomaly_score")


q("iforest_score", _iforest)


def _recon(s, d):
    tr, va, te = _splits(s, d)
    normal = tr.where("is_ato = 0")
    sc_tr, stats = P.standard_scale(normal, RECON_COLS)
    cols = [f"{c}_std" for c in RECON_COLS]
    ws, hist = recon.fit(sc_tr.select(*cols), P.standard_scale(va.where("is_ato = 0"), RECON_COLS, stats)[0]
                         .select(*cols), cols)
    te_s = recon.score(P.standard_scale(te, RECON_COLS, stats)[0].select("event_id", "is_ato", *cols), cols, ws)
    return te_s.select("event_id", "is_ato", "recon_mse")


q("recon_score", _recon)

# ---- calibrations on fixed scores (value-checked) -------------------------------------
q("iforest_calibrate_fixed", lambda s, d: (lambda x: iforest.normalize(
    x, "graph_anomaly_score", iforest.calibrate(x.where("is_ato = 0"), "graph_anomaly_score")[0], "norm_score")
    .select("event_id", "norm_score"))(scored(s, d)),
  SC() + ", BD AS (SELECT quantile_cont(graph_anomaly_score, 0.01) AS low, quantile_cont(graph_anomaly_score, 0.99)"
  " AS high0 FROM SC WHERE is_ato = 0), B2 AS (SELECT low, CASE WHEN high0 <= low THEN low + 1e-6 ELSE high0 END AS high"
  " FROM BD)\nSELECT event_id, 1.0 - least(greatest((graph_anomaly_score - low) / (high - low), 0.0), 1.0) AS norm_score"
  " FROM SC, B2", ["norm_score"], ["event_id"])
q("recon_calibrate_fixed", lambda s, d: recon.calibrate(scored(s, d).where("is_ato = 0"), "model_score"),
  SC() + "\nSELECT quantile_cont(model_score, 0.99) AS threshold_99, quantile_cont(model_score, 0.5) AS threshold_50,"
  " quantile_cont(model_score, 0.1) AS threshold_10 FROM SC WHERE is_ato = 0",
  ["threshold_99", "threshold_50", "threshold_10"], [])
q("recon_flag_fixed", lambda s, d: recon.flag(scored(s, d).select("event_id", "model_score"), "model_score")
  .select("event_id", "recon_flag"),
  SC() + ", T AS (SELECT quantile_cont(model_score, 0.95) AS t FROM SC)\n"
  "SELECT event_id, CAST(model_score > t AS INTEGER) AS recon_flag FROM SC, T", [], ["event_id", "recon_flag"])
