"""Registered queries: evaluation metrics (§2.14), predicates (§2.3) and the fusion ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion as FU
from ..operators import metrics as M
from ..plans.ordering import exact_quantiles
from . import oracle as O
from .catalog import add, finalize
from .frames import scored

SC = lambda: O.with_ctes(O.fixture_ctes(False), O.scored_ctes())
THRESHOLD = 0.5
KS = (10, 50, 100, 500, 1000)


def q(name, spark_fn, sql, doubles=(), ints=(), section=""):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


def _pred(s, d):
    return scored(s, d).select("event_id", "is_ato", "model_score",
                               M.threshold_predict("model_score", THRESHOLD).alias("pred"))


q("threshold_predict", lambda s, d: _pred(s, d).select("event_id", "pred"),
  SC() + "\nSELECT event_id, CAST(model_score >= 0.5 AS INTEGER) AS pred FROM SC", [], ["event_id", "pred"], "2.3")
q("filter_attack", lambda s, d: scored(s, d).where("is_ato = 1").select("event_id", "user_id", "model_score"),
  SC() + "\nSELECT event_id, user_id, model_score FROM SC WHERE is_ato = 1", ["model_score"],
  ["event_id", "user_id"], "2.3")
q("filter_normal_count", lambda s, d: scored(s, d).where("is_ato = 0").agg(F.count(F.lit(1)).alias("normal_rows")),
  SC() + "\nSELECT count(*) AS normal_rows FROM SC WHERE is_ato = 0", [], ["normal_rows"], "2.3")

_CONF_SQL = ("SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1"
             " FROM (SELECT tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,"
             " CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM (SELECT"
             " sum(CASE WHEN {y} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN {y} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS fp,"
             " sum(CASE WHEN {y} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN {y} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS fn"
             " FROM {t}))")
q("confusion_at_threshold", lambda s, d: M.confusion(_pred(s, d), "is_ato", "pred"),
  SC() + ", PR AS (SELECT is_ato, CAST(model_score >= 0.5 AS INTEGER) AS pred FROM SC)\n"
  + _CONF_SQL.format(y="is_ato", p="pred", t="PR"), ["precision", "recall", "f1"], ["tp", "fp", "tn", "fn"], "2.14")
q("classification_report", lambda s, d: M.classification_report(_pred(s, d), "is_ato", "pred"),
  SC() + ", PR AS (SELECT is_ato, CAST(model_score >= 0.5 AS INTEGER) AS pred FROM SC)\n"
  + " UNION ALL ".join(f"SELECT {c} AS class, precision, recall, f1, tp + fn AS support FROM ("
                       + _CONF_SQL.format(y=f"CAST(is_ato = {c} AS INTEGER)", p=f"CAST(pred = {c} AS INTEGER)", t="PR")
                       + ")" for c in (0, 1)),
  ["precision", "recall", "f1"], ["class", "support"], "2.14")

_AUC_SQL = ("SELECT sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END)"
            " / (count(DISTINCT p.i) * count(DISTINCT n.i)) AS roc_auc"
            " FROM (SELECT event_id AS i, model_score AS s FROM SC WHERE is_ato = 1) p,"
            " (SELECT event_id AS i, model_score AS s FROM SC WHERE is_ato = 0) n")
q("roc_auc", lambda s, d: M.roc_auc(scored(s, d), "is_ato", "model_score"), SC() + "\n" + _AUC_SQL,
  ["roc_auc"], [], "2.14")
_AP_SQL = ("SELECT avg((SELECT count(*) FROM SC x WHERE x.model_score >= p.model_score AND x.is_ato = 1)"
           " / (SELECT count(*) FROM SC x WHERE x.model_score >= p.model_score)) AS pr_auc FROM SC p WHERE p.is_ato = 1")
q("pr_auc", lambda s, d: M.average_precision(scored(s, d), "is_ato", "model_score"), SC() + "\n" + _AP_SQL,
  ["pr_auc"], [], "2.14")
q("best_threshold", lambda s, d: M.best_threshold(scored(s, d), "is_ato", "model_score"),
  SC() + ", T AS (SELECT DISTINCT model_score AS t FROM SC), C AS (SELECT t, sum(is_ato) AS tp, count(*) AS n,"
  " (SELECT sum(is_ato) FROM SC) AS P FROM T JOIN SC ON SC.model_score >= T.t GROUP BY t),"
  " B AS (SELECT t FROM C WHERE tp / P >= 0.7 ORDER BY tp / n DESC, t LIMIT 1)\n"
  "SELECT COALESCE((SELECT t FROM B), 0.3) AS threshold", ["threshold"], [], "2.14")
q("precision_recall_at_k", lambda s, d: M.precision_recall_at_k(scored(s, d), "is_ato", "model_score", KS),
  SC() + ", R AS (SELECT is_ato, row_number() OVER (ORDER BY model_score DESC, event_id) AS r FROM SC),"
  " K AS (SELECT * FROM (VALUES (10), (50), (100), (500), (1000)) v(k))\n"
  "SELECT k, sum(CASE WHEN r <= k THEN is_ato ELSE 0 END) AS hits,"
  " sum(CASE WHEN r <= k THEN is_ato ELSE 0 END) / least(k, (SELECT count(*) FROM SC)) AS precision_at_k,"
  " CASE WHEN (SELECT sum(is_ato) FROM SC) > 0 THEN sum(CASE WHEN r <= k THEN is_ato ELSE 0 END)"
  " / (SELECT sum(is_ato) FROM SC) ELSE 0.0 END AS recall_at_k FROM K, R GROUP BY k",
  ["precision_at_k", "recall_at_k"], ["k", "hits"], "2.14")
q("medians_by_label", lambda s, d: exact_quantiles(scored(s, d), "model_score", [0.5], ["is_ato"])
  .select(F.col("is_ato").alias("label"), F.col("quantile").alias("median_score")),
  SC() + "\nSELECT is_ato AS label, quantile_cont(model_score, 0.5) AS median_score FROM SC GROUP BY is_ato",
  ["median_score"], ["label"], "2.14")
q("pr_curve", lambda s, d: M.pr_curve(scored(s, d), "is_ato", "model_score"),
  SC() + ", T AS (SELECT DISTINCT model_score AS t FROM SC)\nSELECT t AS threshold, sum(is_ato) / count(*) AS precision,"
  " sum(is_ato) / (SELECT sum(is_ato) FROM SC) AS recall FROM T JOIN SC ON SC.model_score >= T.t GROUP BY t",
  ["threshold", "precision", "recall"], [], "2.14")


# ---- fusion ablation --------------------------------------------------------------------
def _ablation(s, d) -> DataFrame:
    sc = scored(s, d)
    modes = F.explode(F.array(*[F.lit(m) for m in FU.ABLATION_MODES])).alias("mode")
    x = sc.select("event_id", "is_ato", "model_score", "graph_anomaly_score", "rule_score", modes)
    x = x.select("event_id", "is_ato", "mode", FU.ablation_score(F.col("mode")).alias("score"))
    auc = M.roc_auc(x, "is_ato", "score", ["mode"])
    ap = M.average_precision(x, "is_ato", "score", ["mode"])
    pk = M.precision_recall_at_k(x, "is_ato", "score", (50, 100, 500), group="mode",
                                 group_values=FU.ABLATION_MODES)
    pk = pk.groupBy("mode").pivot("k", [50, 100, 500]).agg(F.first("precision_at_k"))
    pk = pk.select("mode", *[F.col(str(k)).alias(f"p_at_{k}") for k in (50, 100, 500)])
    cm = M.confusion(x.select("*", M.threshold_predict("score", THRESHOLD).alias("pred")), "is_ato", "pred", ["mode"])
    return reduce(lambda a, b: a.join(b, "mode"), [auc, ap, pk, cm.select("mode", "tp", "fp")])


_GATE = ("least(greatest(greatest(0.8 * model_score + CASE WHEN {g} > 0.92 AND model_score >= 0.15 AND "
         "model_score <= 0.70 THEN 0.15 ELSE 0.0 END + CASE WHEN {g} > 0.98 THEN 0.10 ELSE 0.0 END, {r} * 0.7), 0.0), 1.0)")
_ABL = (SC() + ", MS AS (SELECT mode, event_id, is_ato, CASE mode WHEN 'rf_only' THEN model_score"
        f" WHEN 'rf_graph' THEN {_GATE.format(g='graph_anomaly_score', r='0.0')}"
        f" WHEN 'rf_rules' THEN {_GATE.format(g='0.0', r='rule_score')}"
        f" ELSE {_GATE.format(g='graph_anomaly_score', r='rule_score')} END AS score FROM SC,"
        " (VALUES ('rf_only'), ('rf_graph'), ('rf_rules'), ('full')) v(mode)),"
        " AUC AS (SELECT p.mode, sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)"
        " / (count(DISTINCT p.event_id) * count(DISTINCT n.event_id)) AS roc_auc FROM MS p JOIN MS n ON p.mode = n.mode"
        " AND p.is_ato = 1 AND n.is_ato = 0 GROUP BY p.mode),"
        " AP AS (SELECT p.mode, avg((SELECT count(*) FROM MS x WHERE x.mode = p.mode AND x.score >= p.score AND x.is_ato = 1)"
        " / (SELECT count(*) FROM MS x WHERE x.mode = p.mode AND x.score >= p.score)) AS pr_auc FROM MS p"
        " WHERE p.is_ato = 1 GROUP BY p.mode),"
        " RK AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, event_id) AS r FROM MS),"
        " PK AS (SELECT mode, sum(CASE WHEN r <= 50 THEN is_ato ELSE 0 END) / 50 AS p_at_50,"
        " sum(CASE WHEN r <= 100 THEN is_ato ELSE 0 END) / 100 AS p_at_100,"
        " sum(CASE WHEN r <= 500 THEN is_ato ELSE 0 END) / 500 AS p_at_500,"
        " sum(CASE WHEN is_ato = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS tp,"
        " sum(CASE WHEN is_ato = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS fp FROM RK GROUP BY mode)\n"
        "SELECT * FROM AUC JOIN AP USING (mode) JOIN PK USING (mode)")
q("fusion_ablation", _ablation, _ABL, ["roc_auc", "pr_auc", "p_at_50", "p_at_100", "p_at_500"], ["tp", "fp"], "2.13")
