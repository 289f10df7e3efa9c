"""Score fusion and severity assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: severity cut-offs and lane names
LINEAR_SEVERITY = [(0.85, "CRITICAL"), (0.65, "HIGH"), (0.40, "MEDIUM")]
LINEAR_DEFAULT = "LOW"
LANES = ("CRITICAL - Policy Violation", "HIGH - Known ATO Pattern", "HIGH - Novel Structural Anomaly",
         "MEDIUM - Behavioral Review", "LOW - Baseline")


def fuse_linear(m="model_score", g="graph_anomaly_score", r="rule_score") -> Column:
    """0.5 model + 0.3 graph + 0.2 rule, but at least 0.8 rule."""
    m, g, r = F.col(m), F.col(g), F.col(r)
    return F.greatest(0.5 * m + 0.3 * g + 0.2 * r, r * 0.8)


def severity_linear(risk="final_risk") -> Column:
    out = None
    for cut, name in LINEAR_SEVERITY:
        out = (F.when(F.col(risk) >= cut, name) if out is None else out.when(F.col(risk) >= cut, name))
    return out.otherwise(LINEAR_DEFAULT)


def fuse_gated(m="model_score", g="graph_anomaly_score", r="rule_score") -> Column:
    """0.8 model; +0.15 when graph > 0.92 and model in [0.15, 0.70]; +0.10 when graph > 0.98;
    at least 0.7 rule; clipped to [0, 1]."""
    m, g, r = (F.lit(0.0) if x == "__zero__" else F.col(x) for x in (m, g, r))
    gb = F.when((g > 0.92) & (m >= 0.15) & (m <= 0.70), F.lit(0.15)).otherwise(F.lit(0.0))
    ex = F.when(g > 0.98, F.lit(0.10)).otherwise(F.lit(0.0))
    fused = F.greatest(0.8 * m + gb + ex, r * 0.7)
    return F.least(F.greatest(fused, F.lit(0.0)), F.lit(1.0))


def severity_lane(m="model_score", g="graph_anomaly_score", r="rule_score", risk="final_risk") -> Column:
    """First matching lane: rule > 0.8; model > 0.75; graph > 0.95 and model < 0.3; risk > 0.5; else."""
    m, g, r, f = F.col(m), F.col(g), F.col(r), F.col(risk)
    return (F.when(r > 0.8, LANES[0]).when(m > 0.75, LANES[1]).when((g > 0.95) & (m < 0.3), LANES[2])
            .when(f > 0.5, LANES[3]).otherwise(LANES[4]))


def sigmoid_fusion(weights: dict[str, float], bias: float = 0.0) -> Column:
    """sigma(bias + sum w_i * s_i) over the named score columns."""
    z = F.lit(bias)
    for c, w in weights.items():
        z = z + F.lit(w) * F.col(c)
    return 1.0 / (1.0 + F.exp(-z))


def fuse(df: DataFrame, mode: str = "linear", m="model_score", g="graph_anomaly_score",
         r="rule_score") -> DataFrame:
    if mode == "linear":
        x = df.select("*", fuse_linear(m, g, r).alias("final_risk"))
        return x.select("*", severity_linear().alias("alert_severity"))
    x = df.select("*", fuse_gated(m, g, r).alias("final_risk"))
    return x.select("*", severity_lane(m, g, r).alias("alert_severity"))


# ablation modes of the fusion comparison: which scores enter the gated fusion
ABLATION_MODES = ("rf_only", "rf_graph", "rf_rules", "full")


def ablation_score(mode: Column, m="model_score", g="graph_anomaly_score", r="rule_score") -> Column:
    """Model score alone; gated fusion with rules zeroed; with the graph zeroed; or in full."""
    zero = "__zero__"
    return (F.when(mode == "rf_only", F.col(m))
            .when(mode == "rf_graph", fuse_gated(m, g, zero))
            .when(mode == "rf_rules", fuse_gated(m, zero, r))
            .otherwise(fuse_gated(m, g, r)))
