"""Benchmark: end-to-end login-risk plan at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf", ...}.
``value`` is the wall time of the headline run (features -> rules -> boost -> tiers);
rows/s of that run and of the feature stage alone are reported beside it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tripwire.operators import triage as T  # noqa: E402
from tripwire.operators.history import user_history  # noqa: E402
from tripwire.operators.infra import graph_features  # noqa: E402
from tripwire.operators.metrics import average_precision, roc_auc  # noqa: E402
from tripwire.plans import queries_models  # noqa: E402
from tripwire.plans.frames import featured, scored  # noqa: E402
from tripwire.session import build_session, release  # noqa: E402
from tripwire.sources.logins import load_fixture  # noqa: E402


def run(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(f"local[{cpus}]", int(cpus))
    n_rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    timings = {}

    def timed(name, build):
        t = time.time()
        df = build()
        run(df)
        timings[name] = round(time.time() - t, 3)
        release(spark)

    # warm-up (JVM, codegen caches) on the smallest pieces, not timed
    run(load_fixture(spark, sf_dir, True).select("event_id"))

    timings_start = time.time()
    # all columns, so that the optimiser drops none of the windows
    timed("user_history", lambda: user_history(load_fixture(spark, sf_dir, True)))
    timed("graph_features", lambda: graph_features(user_history(load_fixture(spark, sf_dir, True))))
    t0 = time.time()
    f = featured(spark, sf_dir)
    crit = T.critical_tier(f)
    susp = T.suspicious_tier(f)
    run(crit.select("alert_rank", "event_id", "final_score"))
    run(susp.select("alert_rank", "event_id"))
    timings["triage_end_to_end"] = round(time.time() - t0, 3)
    timed("fusion_user_risk", lambda: T.user_risk(
        scored(spark, sf_dir).selectExpr("*", "greatest(0.5 * model_score + 0.3 * graph_anomaly_score + 0.2 * rule_score,"
                                         " rule_score * 0.8) AS final_risk")))
    timed("roc_auc", lambda: roc_auc(scored(spark, sf_dir), "is_ato", "model_score"))
    timed("pr_auc", lambda: average_precision(scored(spark, sf_dir), "is_ato", "model_score"))
    timed("rollups", lambda: T.attack_clusters(T.critical_tier(featured(spark, sf_dir))))
    timed("forest_fit_score", lambda: queries_models.detector(spark, sf_dir).transform(queries_models._test_part(spark, sf_dir)))
    total = round(time.time() - timings_start, 3)
    e2e = timings["triage_end_to_end"]
    out = {
        "metric": "end_to_end_triage_sec",
        "value": e2e,
        "unit": "sec",
        "queries": timings,
        "total_sec": total,
        "sf": sf,
        "rows": n_rows,
        "rows_per_sec_end_to_end": round(n_rows / e2e, 1) if e2e else None,
        "rows_per_sec_features": round(n_rows / timings["graph_features"], 1),
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
