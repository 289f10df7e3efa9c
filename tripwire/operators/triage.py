"""Alert tiers, queues and roll-ups (what the analyst console shows), as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordering import exact_quantiles, top_k, with_position

# fixed values: tier cut-offs, queue sizes and console labels
CRITICAL_CUT = 0.50
SUSPICIOUS_TOP = 1000
ALERT_CUT = 0.40
ALERT_LIST_TOP = 5000
SCORE_BINS = [(0.0, 0.2, "0-20%"), (0.2, 0.4, "20-40%"), (0.4, 0.6, "40-60%"), (0.6, 0.8, "60-80%"),
              (0.8, 1.0, "80-100%")]
SECONDARY_MODEL, SECONDARY_GRAPH = 0.75, 0.95


def critical_tier(df: DataFrame, score: str = "final_score") -> DataFrame:
    """All rows with score > 0.50, ranked 1.. by score desc (ties: lower event_id).

    The tier is unbounded, so the rank is a global position, not a one-partition window.
    """
    x = df.where(F.col(score) > CRITICAL_CUT)
    x = with_position(x, [F.col(score).desc(), F.col("event_id").asc()], "_pos")
    return x.select(F.lit("CRITICAL").alias("alert_tier"), (F.col("_pos") + 1).alias("alert_rank"),
                    *[c for c in x.columns if c != "_pos"])


def suspicious_tier(df: DataFrame, score: str = "model_score", top: int = SUSPICIOUS_TOP) -> DataFrame:
    """The ``top`` rows by model score, ranked (exact bounded top-k, then a small window)."""
    t = top_k(df, score, top)
    r = F.row_number().over(Window.orderBy(F.col(score).desc(), F.col("event_id").asc()))
    return t.select(F.lit("SUSPICIOUS").alias("alert_tier"), r.alias("alert_rank"), *df.columns)


def alert_feed(critical: DataFrame, suspicious: DataFrame) -> DataFrame:
    return critical.unionByName(suspicious)


def top_alerts(df: DataFrame, risk: str = "final_risk", cut: float = ALERT_CUT, top: int = ALERT_LIST_TOP) -> DataFrame:
    return top_k(df.where(F.col(risk) >= cut), risk, top)


def user_risk(df: DataFrame, risk: str = "final_risk", model: str = "model_score",
              graph: str = "graph_anomaly_score") -> DataFrame:
    return df.groupBy("user_id").agg(
        F.max(risk).alias("max_risk"), F.avg(risk).alias("avg_risk"), F.count(F.lit(1)).alias("alert_count"),
        F.max(model).alias("max_model_score"), F.max(graph).alias("max_graph_score"))


def asn_risk_top(alerts: DataFrame, score: str = "final_score", top: int = 10) -> DataFrame:
    g = alerts.where(F.col("asn").isNotNull()).groupBy("asn").agg(F.avg(score).alias("risk"))
    return g.orderBy(F.col("risk").desc(), F.col("asn").asc()).limit(top)


def country_alerts_top(alerts: DataFrame, top: int = 8) -> DataFrame:
    """Alerts per country (nulls dropped), top ``top``, with each bar's share of the largest."""
    g = alerts.where(F.col("country").isNotNull()).groupBy("country").agg(F.count(F.lit(1)).alias("alerts"))
    t = g.orderBy(F.col("alerts").desc(), F.col("country").asc()).limit(top)
    return t.select("*", (F.col("alerts") / F.max("alerts").over(Window.partitionBy(F.lit(1)))).alias("share"))


def risky_users_top(alerts: DataFrame, score: str = "final_score", top: int = 10) -> DataFrame:
    g = alerts.groupBy("user_id").agg(F.avg(score).alias("risk"), F.count(F.lit(1)).alias("alerts"))
    t = g.orderBy(F.col("risk").desc(), F.col("user_id").asc()).limit(top)
    return t.select(S.mask_user("user_id").alias("user"), "user_id", "risk", "alerts",
                    F.when(F.col("risk") > 0.6, "CRITICAL_WATCH").otherwise("ELEVATED").alias("label"))


def score_histogram(alerts: DataFrame, score: str = "final_score") -> DataFrame:
    """Five right-closed bins (0 itself falls in none); empty bins are kept with 0."""
    s = F.col(score)
    b = None
    for lo, hi, name in SCORE_BINS:
        cond = (s > lo) & (s <= hi)
        b = F.when(cond, name) if b is None else b.when(cond, name)
    counts = alerts.select(b.alias("range")).where(F.col("range").isNotNull()).groupBy("range") \
        .agg(F.count(F.lit(1)).alias("n"))
    bins = alerts.sparkSession.createDataFrame([(i, n) for i, (_, _, n) in enumerate(SCORE_BINS)], "bin int, range string")
    return F.broadcast(bins).join(counts, "range", "left").select(
        "bin", "range", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"))


def attack_clusters(alerts: DataFrame, score: str = "final_score", top: int = 5) -> DataFrame:
    """ASN and device groups shared by more than one user: users, alerts, mean score."""
    asn = alerts.where(F.col("asn").isNotNull()).groupBy("asn").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("alerts"),
                                    F.avg(score).alias("risk")).where(F.col("users") > 1)
    asn = asn.orderBy(F.col("users").desc(), F.col("asn").asc()).limit(top).select(
        F.lit("ASN_NETWORK").alias("type"), F.concat(F.lit("AS"), F.col("asn").cast("string"))
        .alias("value"), "users", "alerts", "risk",
        F.when(F.col("risk") > 0.6, "CRITICAL").otherwise("HIGH").alias("severity"))
    dev = alerts.groupBy("device").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("alerts"),
                                       F.avg(score).alias("risk")).where(F.col("users") > 1)
    dev = dev.orderBy(F.col("users").desc(), F.col("device").asc()).limit(top).select(
        F.lit("DEVICE_FINGERPRINT").alias("type"), S.os_of_combo("device").alias("value"), "users", "alerts",
        "risk", F.lit("HIGH").alias("severity"))
    return asn.unionByName(dev)


def risk_timeline(alerts: DataFrame) -> DataFrame:
    """Alerts per hour of day, all 24 hours present."""
    counts = alerts.groupBy(F.hour("login_ts").alias("hour")).agg(F.count(F.lit(1)).alias("alerts"))
    hours = alerts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return F.broadcast(hours).join(counts, "hour", "left").select(
        "hour", F.format_string("%02d:00", "hour").alias("label"),
        F.coalesce(F.col("alerts"), F.lit(0)).cast("bigint").alias("alerts"))


def severity_counts(alerts: DataFrame, col: str = "alert_severity") -> DataFrame:
    return alerts.agg(F.sum((F.col(col) == "CRITICAL").cast("bigint")).alias("critical"),
                      F.sum((F.col(col) == "HIGH").cast("bigint")).alias("high"),
                      F.count(F.lit(1)).alias("total"))


def rank_queues(alerts: DataFrame, model: str = "model_score", graph: str = "graph_anomaly_score") -> DataFrame:
    """Console queues over the (bounded) alert list: primary by model score, secondary (model > 0.75
    and graph > 0.95) by their sum, anomaly by graph score; rank within each queue."""
    def q(name, d, key):
        # the alert list is bounded (top 5000), so one ordered window per queue is fine
        r = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(key.desc(), F.col("event_id")))
        return d.select(F.lit(name).alias("queue"), "event_id", r.alias("queue_rank"))
    sec = alerts.where((F.col(model) > SECONDARY_MODEL) & (F.col(graph) > SECONDARY_GRAPH))
    return q("primary", alerts, F.col(model)).unionByName(
        q("secondary", sec, F.col(model) + F.col(graph))).unionByName(q("anomaly", alerts, F.col(graph)))


def alert_for_user(critical: DataFrame, suspicious: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """First alert of each user: the critical tier before the suspicious one, then by rank."""
    feed = critical.withColumn("_tier", F.lit(0)).unionByName(suspicious.withColumn("_tier", F.lit(1)))
    if users is not None:
        feed = feed.join(users.select("user_id").distinct(), "user_id", "left_semi")
    # min_by is a partial aggregate: a user with very many alerts is reduced map-side
    cols = [c for c in feed.columns if c not in ("user_id", "_tier")]
    best = feed.groupBy("user_id").agg(F.min_by(F.struct(*cols), F.struct("_tier", "alert_rank")).alias("_a"))
    return best.select("user_id", *[F.col(f"_a.{c}").alias(c) for c in cols])


def label_distribution(df: DataFrame, label: str = "is_ato", by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    g = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("rows"))
    tot = F.sum("rows").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return g.select("*", (F.col("rows") / tot).alias("share"))


def run_stats(df: DataFrame, critical_n: DataFrame, suspicious_n: DataFrame, label: str = "is_ato",
              model: str = "model_score", final: str = "final_score") -> DataFrame:
    base = df.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.col(label).cast("bigint")).alias("known_atos"),
                  F.max(model).alias("rf_score_max"), F.max(final).alias("final_score_max"),
                  F.min(final).alias("final_score_min"), F.min(model).alias("rf_score_min"))
    rows = [base, critical_n.agg(F.count(F.lit(1)).alias("critical_alerts")), suspicious_n.agg(F.count(F.lit(1)).alias("suspicious_alerts"))]
    for name, col in (("rf", model), ("final", final)):
        rows.append(exact_quantiles(df, col, [0.5]).agg(F.max("quantile").alias(f"{name}_score_median")))
        for k, out in ((50, f"{name}_p_at_50"), (500, f"_{name}_hits")):
            rows.append(top_k(df.select("event_id", label, col), col, k).agg(F.sum(F.col(label).cast("double")).alias(out)))
    one = [r.withColumn("_j", F.lit(1)) for r in rows]  # one row each
    out = one[0]
    for r in one[1:]:
        out = out.join(F.broadcast(r), "_j")
    for name in ("rf", "final"):
        out = out.withColumn(f"{name}_p_at_50", F.col(f"{name}_p_at_50") / 50)
        out = out.withColumn(f"{name}_r_at_500", F.try_divide(F.col(f"_{name}_hits"), F.col("known_atos")))
    return out.drop("_j", "_rf_hits", "_final_hits")
