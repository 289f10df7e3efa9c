"""Registered queries: splits and samples (§2.9) and drift (§2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import sampling as SP
from ..operators import triage as T
from ..operators.history import user_history
from ..sources.logins import load_fixture
from . import oracle as O
from .catalog import add, finalize
from .frames import features

LQ = lambda dense=False: O.with_ctes(O.fixture_ctes(dense))
HQ = lambda: O.with_ctes(O.fixture_ctes(True), O.history_ctes())
MD5 = "md5(CAST(event_id AS VARCHAR) || ':42')"

# test-scale parameters (the fixture has 10 000 rows at sf0.01, the log 31M): the
# operators keep the reference defaults; these queries pass scaled block/edge sizes
FIX_BLOCK = 1000
FIX_EDGE = 2000
FIX_BLOCKS = (0, 5, 9)


def q(name, spark_fn, sql, doubles=(), ints=(), section=""):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


def logins(s, d, dense=False):
    return load_fixture(s, d, dense)


q("temporal_split", lambda s, d: SP.temporal_split(logins(s, d)).select("event_id", "split"),
  LQ() + ", P AS (SELECT event_id, row_number() OVER (ORDER BY login_us, event_id) - 1 AS pos, count(*) OVER () AS n FROM L)\n"
  "SELECT event_id, CASE WHEN pos < floor(n * 0.70e0) THEN 'train' WHEN pos < floor(n * 0.80e0) THEN 'val'"
  " ELSE 'test' END AS split FROM P", [], ["event_id"], "2.9")
q("label_distribution", lambda s, d: T.label_distribution(SP.temporal_split(logins(s, d)), "is_ato", "split"),
  LQ() + ", P AS (SELECT *, row_number() OVER (ORDER BY login_us, event_id) - 1 AS pos, count(*) OVER () AS n FROM L),"
  " S AS (SELECT *, CASE WHEN pos < floor(n * 0.70e0) THEN 'train' WHEN pos < floor(n * 0.80e0) THEN 'val' ELSE 'test' END"
  " AS split FROM P), G AS (SELECT split, is_ato, count(*) AS rows FROM S GROUP BY split, is_ato)\n"
  "SELECT split, is_ato, rows, rows / sum(rows) OVER (PARTITION BY split) AS share FROM G",
  ["share"], ["is_ato", "rows"], "2.5")


def _bal_sql(per, mn):
    return (LQ() + f", C AS (SELECT sum(is_ato) AS p, sum(1 - is_ato) AS q FROM L), W AS (SELECT CASE WHEN least(p * {per}, q)"
            f" < {mn} THEN least({mn}, q) ELSE least(p * {per}, q) END AS want FROM C),"
            f" N AS (SELECT event_id, row_number() OVER (ORDER BY {MD5}, event_id) - 1 AS r FROM L WHERE is_ato = 0)\n"
            "SELECT event_id, 1 AS is_ato FROM L WHERE is_ato = 1 UNION ALL SELECT event_id, 0 FROM N"
            " WHERE r < (SELECT want FROM W)")


q("balanced_sample", lambda s, d: SP.balanced_sample(logins(s, d)).select("event_id", "is_ato"),
  _bal_sql(50, 50000), [], ["event_id", "is_ato"], "2.9")
q("balanced_sample_small", lambda s, d: SP.balanced_sample(logins(s, d), neg_per_pos=10, min_neg=500)
  .select("event_id", "is_ato"), _bal_sql(10, 500), [], ["event_id", "is_ato"], "2.9")
q("stratified_split", lambda s, d: SP.stratified_split(logins(s, d)).select("event_id", "split"),
  LQ() + f", R AS (SELECT event_id, row_number() OVER (PARTITION BY is_ato ORDER BY {MD5}, event_id) - 1 AS r,"
  " count(*) OVER (PARTITION BY is_ato) AS c FROM L)\n"
  "SELECT event_id, CASE WHEN r < floor(c * 0.2e0) THEN 'val' ELSE 'train' END AS split FROM R", [], ["event_id"], "2.9")


def _hard_sql(nh, nr):
    return (HQ() + f", NEG AS (SELECT * FROM HF WHERE is_ato = 0), H AS (SELECT event_id FROM NEG WHERE"
            f" (SELECT count(*) FROM NEG) > {nh} ORDER BY gf_user_drift_score DESC, event_id LIMIT {nh}),"
            f" R AS (SELECT event_id, row_number() OVER (ORDER BY {MD5}, event_id) - 1 AS r FROM NEG"
            " WHERE event_id NOT IN (SELECT event_id FROM H))\n"
            "SELECT event_id, 'positive' AS part FROM HF WHERE is_ato = 1 UNION ALL SELECT event_id, 'hard' FROM H"
            f" UNION ALL SELECT event_id, 'random' FROM R WHERE r < {nr}")


def _hist(s, d):
    return user_history(load_fixture(s, d, True))


q("hard_negative_sample", lambda s, d: SP.hard_negative_sample(_hist(s, d)).select("event_id", "part"),
  _hard_sql(25000, 150000), [], ["event_id"], "2.9")
q("hard_negative_sample_small", lambda s, d: SP.hard_negative_sample(_hist(s, d), n_hard=500, n_random=2000)
  .select("event_id", "part"), _hard_sql(500, 2000), [], ["event_id"], "2.9")
q("chunked_case_control", lambda s, d: SP.chunked_case_control(logins(s, d), block=FIX_BLOCK)
  .select("event_id", "block", "is_ato"),
  LQ() + f", P AS (SELECT event_id, is_ato, (row_number() OVER (ORDER BY login_us, event_id) - 1) // {FIX_BLOCK} AS block"
  " FROM L), B AS (SELECT block, sum(is_ato) AS bp FROM P GROUP BY block),"
  f" N AS (SELECT p.event_id, p.block, row_number() OVER (PARTITION BY p.block ORDER BY {MD5.replace('event_id', 'p.event_id')},"
  " p.event_id) - 1 AS r, b.bp FROM P p JOIN B b ON p.block = b.block WHERE p.is_ato = 0)\n"
  "SELECT event_id, block, 1 AS is_ato FROM P WHERE is_ato = 1 AND block > 0 UNION ALL"
  " SELECT event_id, block, 0 FROM N WHERE block > 0 AND r < CASE WHEN bp > 0 THEN bp * 100 ELSE 5000 END",
  [], ["event_id", "block", "is_ato"], "2.9")


# ---- drift --------------------------------------------------------------------------------
def _drift_sql():
    feats = D.DRIFT_FEATURES + ["label_prevalence"]
    src = {f: f for f in D.DRIFT_FEATURES}
    src["label_prevalence"] = "is_ato"
    lg = " UNION ALL ".join(f"SELECT part, '{f}' AS feature, CAST({src[f]} AS DOUBLE) AS value FROM B" for f in feats)
    cols = ["mean", "median", "p95", "p99", "max"]
    return (HQ() + ", P AS (SELECT *, row_number() OVER (ORDER BY login_us, event_id) - 1 AS pos, count(*) OVER () AS"
            f" total_n FROM HF), B AS (SELECT 'early' AS part, * FROM P WHERE pos < {FIX_EDGE} UNION ALL SELECT 'late', *"
            f" FROM P WHERE pos >= total_n - {FIX_EDGE}), LG AS ({lg}), S AS (SELECT feature, part, avg(value) AS mean,"
            " quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,"
            " max(value) AS max FROM LG GROUP BY feature, part)\n"
            "SELECT e.feature, " + ", ".join(f"e.{c} AS early_{c}" for c in cols) + ", "
            + ", ".join(f"l.{c} AS late_{c}" for c in cols) + ", "
            + ", ".join(f"l.{c} / (e.{c} + 1e-9) AS ratio_{c}" for c in ("mean", "p99", "max"))
            + " FROM S e JOIN S l ON e.feature = l.feature AND e.part = 'early' AND l.part = 'late'")


_DRIFT_D = [f"{p}_{c}" for p in ("early", "late") for c in ("mean", "median", "p95", "p99", "max")] + \
    [f"ratio_{c}" for c in ("mean", "p99", "max")]
q("drift_early_late", lambda s, d: D.drift_early_late(_hist(s, d), edge=FIX_EDGE), _drift_sql(), _DRIFT_D, [], "2.15")


def _block_sql():
    lg = " UNION ALL ".join(f"SELECT block, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM B"
                            for f in D.BLOCK_FEATURES)
    return (HQ() + f", B AS (SELECT *, (row_number() OVER (ORDER BY login_us, event_id) - 1) // {FIX_BLOCK} AS block"
            f" FROM HF), LG AS (SELECT * FROM ({lg}) WHERE block IN {tuple(FIX_BLOCKS)})\n"
            "SELECT block, feature, min(value) AS min, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95)"
            " AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max FROM LG GROUP BY block, feature")


q("drift_by_block", lambda s, d: D.drift_by_block(_hist(s, d), block=FIX_BLOCK, blocks=FIX_BLOCKS), _block_sql(),
  ["min", "median", "p95", "p99", "max"], ["block"], "2.15")


def _no_hard_sql(n):
    return (HQ() + f", H AS (SELECT event_id FROM HF WHERE is_ato = 0 ORDER BY gf_user_drift_score DESC, event_id LIMIT {n})\n"
            "SELECT event_id FROM HF WHERE is_ato = 0 AND event_id NOT IN (SELECT event_id FROM H)")


q("drop_hard_negatives", lambda s, d: SP.drop_hard_negatives(_hist(s, d)).select("event_id"), _no_hard_sql(SP.HARD_NEGATIVES), [], ["event_id"], "2.4")
# with a number that the smaller fixtures exceed
q("drop_hard_negatives_500", lambda s, d: SP.drop_hard_negatives(_hist(s, d), n_hard=500).select("event_id"), _no_hard_sql(500), [], ["event_id"], "2.4")
