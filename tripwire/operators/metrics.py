"""Ranking and classification quality, computed distributed.

ROC-AUC and step average precision aggregate by distinct score first, then take running
sums over the score order with the skew-safe bucketed prefix (scores are bucketed by
value). Top-k metrics use bounded ``limit`` (TakeOrderedAndProject) per group value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import global_prior_sums

KS = (10, 50, 100, 500, 1000)


def _grp(group):
    return list(group or [])


def score_curve(df: DataFrame, label: str, score: str, group=None) -> DataFrame:
    """One row per (group, distinct score): pos, neg and the counts strictly below it."""
    g = _grp(group)
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in g]) if g else F.lit("")
    agg = df.groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    # running counts over (group, distinct score), split at range bounds: however scores pile up, no task holds a pile
    r = global_prior_sums(agg.select("*", key.alias("_gk")), ["_gk", "_s"], ["pos", "neg"], "_cum_")
    tot = r.groupBy("_gk").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                               F.min("_cum_pos").alias("_p0"), F.min("_cum_neg").alias("_n0"))
    r = r.join(F.broadcast(tot) if not g else tot, "_gk")
    return r.select(*[c for c in r.columns if c[:2] not in ("_c", "_p", "_n")],
                    (F.col("_cum_pos") - F.col("_p0")).alias("below_pos"), (F.col("_cum_neg") - F.col("_n0")).alias("below_neg"))


def roc_auc(df: DataFrame, label: str, score: str, group=None) -> DataFrame:
    """Mann-Whitney form: ties count one half. Null when a class is missing."""
    g = _grp(group)
    c = score_curve(df, label, score, g)
    contrib = F.col("pos") * (F.col("below_neg") + 0.5 * F.col("neg"))
    return c.groupBy(*g).agg(
        F.when((F.first("P") > 0) & (F.first("N") > 0), F.sum(contrib) / (F.first("P") * F.first("N")))
        .alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, group=None) -> DataFrame:
    """Step average precision: sum over thresholds of (R_n - R_(n-1)) * P_n."""
    g = _grp(group)
    c = score_curve(df, label, score, g)
    tp = F.col("P") - F.col("below_pos")
    fp = F.col("N") - F.col("below_neg")
    term = F.when(F.col("pos") > 0, (F.col("pos") / F.col("P")) * (tp / (tp + fp))).otherwise(F.lit(0.0))
    return c.groupBy(*g).agg(F.when(F.first("P") > 0, F.sum(term)).alias("pr_auc"))


def pr_curve(df: DataFrame, label: str, score: str, group=None) -> DataFrame:
    """Precision and recall at every distinct score used as threshold (score >= t)."""
    g = _grp(group)
    c = score_curve(df, label, score, g)
    tp = F.col("P") - F.col("below_pos")
    fp = F.col("N") - F.col("below_neg")
    return c.select(*g, F.col("_s").alias("threshold"), (tp / (tp + fp)).alias("precision"),
                    F.when(F.col("P") > 0, tp / F.col("P")).alias("recall"))


def best_threshold(df: DataFrame, label: str, score: str, target_recall: float = 0.70,
                   fallback: float = 0.30) -> DataFrame:
    """Highest precision among thresholds with recall >= target; lowest threshold on ties."""
    cur = pr_curve(df, label, score).where(F.col("recall") >= target_recall)
    best = cur.agg(F.min_by("threshold", F.struct(-F.col("precision"), F.col("threshold"))).alias("t"))
    return best.select(F.coalesce(F.col("t"), F.lit(fallback)).alias("threshold"))


def confusion(df: DataFrame, label: str, pred: str, group=None) -> DataFrame:
    g = _grp(group)
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    agg = df.groupBy(*g).agg(
        F.sum(((y == 1) & (p == 1)).cast("bigint")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("bigint")).alias("fp"),
        F.sum(((y == 0) & (p == 0)).cast("bigint")).alias("tn"),
        F.sum(((y == 1) & (p == 0)).cast("bigint")).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    x = agg.select("*", prec.alias("precision"), rec.alias("recall"))
    return x.select("*", F.when(F.col("precision") + F.col("recall") > 0,
                                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                    .otherwise(F.lit(0.0)).alias("f1"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class: precision, recall, F1, support (each class in turn taken as positive)."""
    parts = []
    for cls in (0, 1):
        x = df.select((F.col(label).cast("int") == cls).cast("int").alias("_y"),
                      (F.col(pred).cast("int") == cls).cast("int").alias("_p"))
        c = confusion(x, "_y", "_p")
        parts.append(c.select(F.lit(cls).alias("class"), "precision", "recall", "f1",
                              (F.col("tp") + F.col("fn")).alias("support")))
    return reduce(DataFrame.unionByName, parts)


def top_k_rows(df: DataFrame, score: str, k: int, tie: str = "event_id") -> DataFrame:
    """The k best rows by score (ties: lower id first); bounded, no single-task merge at scale."""
    from ..plans.ordering import top_k
    return top_k(df, score, k, tie)


def precision_recall_at_k(df: DataFrame, label: str, score: str, ks=KS, tie: str = "event_id",
                          group: str | None = None, group_values=None) -> DataFrame:
    """P@k = hits in the top min(k, n) / min(k, n); R@k = hits / positives (0 without positives).

    Only the best max(ks) rows per group value are ranked (a bounded ``limit``)."""
    kmax = max(ks)
    frames = [(None, df)] if group is None else [(v, df.where(F.col(group) == v)) for v in group_values]
    outs = []
    for v, d in frames:
        top = top_k_rows(d, score, kmax, tie).select(F.col(label).cast("int").alias("_y"),
                                                      F.col(score).alias("_s"), F.col(tie).alias("_t"))
        # bounded: at most kmax rows, so one ordered window is fine here
        top = top.select("_y", F.row_number().over(Window.orderBy(F.col("_s").desc(), F.col("_t"))).alias("_r"))
        hits = top.agg(*[F.coalesce(F.sum(F.when(F.col("_r") <= k, F.col("_y"))), F.lit(0)).alias(f"h{k}")
                         for k in ks]).withColumn("_j", F.lit(1))
        tot = d.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0))
                    .alias("_P")).withColumn("_j", F.lit(1))
        x = hits.join(tot, "_j").select("_n", "_P", F.explode(F.array(*[
            F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("_e"))
        ke = F.least(F.col("_e.k"), F.col("_n"))
        o = x.select(
            F.col("_e.k").alias("k"), F.col("_e.hits").cast("bigint").alias("hits"),
            F.when(ke > 0, F.col("_e.hits") / ke).otherwise(F.lit(0.0)).alias("precision_at_k"),
            F.when(F.col("_P") > 0, F.col("_e.hits") / F.col("_P")).otherwise(F.lit(0.0)).alias("recall_at_k"))
        if group is not None:
            o = o.select(F.lit(v).alias(group), "*")
        outs.append(o)
    return reduce(DataFrame.unionByName, outs)


def threshold_predict(score: str, t) -> Column:
    return (F.col(score) >= (t if isinstance(t, Column) else F.lit(t))).cast("int")
