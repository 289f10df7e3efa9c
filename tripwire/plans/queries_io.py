"""Registered queries for sources, sinks and streaming (§2.1, §2.15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import triage as T
from ..operators.history import BEHAVIOUR_FEATURES
from ..operators.infra import GRAPH_ENTITY_FEATURES
from ..session import materialize
from ..sources import sinks as K
from ..sources.logins import fixture_logins, prepare_logins, read_logins
from ..streaming.runner import (
    append_scores,
    children,
    chunk_paths,
    land_chunks,
    login_stream,
    read_scores,
    run_states,
    run_user_state,
    running_top_k,
    score_batches,
    scratch,
    tracked,
    write_log_files,
)
from ..streaming.user_state import UserHistory
from . import oracle as O
from .catalog import add, finalize
from .frames import featured, surrogate_scores
from .queries_graph import INT_COLS
from .queries_history import DOUBLE_FEATURES

LQ = lambda dense=False: O.with_ctes(O.fixture_ctes(dense))
FTQ = lambda: O.with_ctes(O.fixture_ctes(True), O.history_ctes(), O.graph_ctes(), O.featured_ctes())


def q(name, spark_fn, sql=None, doubles=(), ints=(), section="2.1"):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


_RAW_COLS = ["event_id", "user_id", "login_us", "ip", "country", "asn", "device_type", "os_name", "browser",
             "success", "rtt_ms", "is_attack_ip", "is_ato"]


def _csv_roundtrip(s, d):
    path = scratch(s, "raw-csv")
    K.write_raw_logins_csv(fixture_logins(s, d), path)
    back = prepare_logins(read_logins(s, path, "csv"))
    # the CSV has no event id: the file position stands in; compare on the content
    return back.select(*[c for c in _RAW_COLS if c != "event_id"])


q("read_logins_csv", _csv_roundtrip,
  LQ() + "\nSELECT user_id, login_us, ip, country, asn, device_type, os_name, browser, success, rtt_ms, is_attack_ip,"
  " is_ato FROM L", ["rtt_ms"], ["user_id", "login_us", "asn", "success", "is_attack_ip", "is_ato"])


def _full_log(s, d):
    """The raw log's own 15 columns in its order, one half with dates, one with epoch seconds; read as a table and as a stream."""
    base, rows = scratch(s, "full-csv"), fixture_logins(s, d)
    K.write_full_log_csv(rows.where("event_id % 2 = 0"), f"{base}/a")
    K.write_full_log_csv(rows.where("event_id % 2 = 1"), f"{base}/b", epoch_seconds=True)
    cols = [c for c in _RAW_COLS if c != "event_id"]
    a = prepare_logins(read_logins(s, f"{base}/a", "csv")).select(cols)
    out = f"{base}/out"
    w = prepare_logins(login_stream(s, f"{base}/b", 2, "csv", repeats_share_id=True)).writeStream.format("parquet").option("path", out)
    w.option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    return a.unionByName(s.read.parquet(out).select(cols))


q("read_logins_full_header", _full_log,
  LQ() + "\nSELECT user_id, login_us, ip, country, asn, device_type, os_name, browser, success, rtt_ms, is_attack_ip,"
  " is_ato FROM L", ["rtt_ms"], ["user_id", "login_us", "asn", "success", "is_attack_ip", "is_ato"])


_CONTENT = ["user_id", "login_us", "ip", "country", "asn", "device_type", "os_name", "browser", "success"]


def _repeats(s, d):
    """A log that holds every row twice, in one file: all rows are read, each with an id of its own."""
    path, rows = scratch(s, "twice-csv"), fixture_logins(s, d)
    K.write_raw_logins_csv(rows.unionByName(rows).coalesce(1), path)
    back = materialize(prepare_logins(read_logins(s, path, "csv")))
    again = prepare_logins(read_logins(s, path, "csv")).select("event_id")
    if again.exceptAll(back.select("event_id")).limit(1).count():
        raise RuntimeError("ids changed between two reads")
    return back.groupBy(*_CONTENT).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_ids"))


q("read_logins_repeated_rows", _repeats,
  LQ() + f"\nSELECT {', '.join(_CONTENT)}, 2 * count(*) AS n_rows, 2 * count(*) AS n_ids FROM L GROUP BY ALL",
  [], ["user_id", "login_us", "asn", "success", "n_rows", "n_ids"])


def _table_roundtrip(s, d):
    path = scratch(s, "critical")
    K.write_table(T.critical_tier(featured(s, d)).select("alert_tier", "alert_rank", "event_id", "final_score",
                                                          "reason_tags"), path)
    return K.read_alerts(s, path, "final_score", 100)


q("write_read_alerts", _table_roundtrip,
  FTQ() + ", CR AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, event_id) AS alert_rank FROM FT"
  " WHERE final_score > 0.50)\nSELECT 'CRITICAL' AS alert_tier, alert_rank, event_id, final_score, reason_tags FROM CR"
  " ORDER BY final_score DESC, event_id LIMIT 100", ["final_score"], ["alert_rank", "event_id"])


def _json_report(s, d):
    f = featured(s, d)
    stats = T.run_stats(f, T.critical_tier(f), T.suspicious_tier(f)).select(
        "total_rows", "known_atos", "rf_score_max", "final_score_max", "final_score_min", "critical_alerts", "suspicious_alerts")
    path = scratch(s, "report")
    K.write_json_report(stats, path)
    return K.read_json_report(s, path, stats.schema)


q("write_json_report", _json_report,
  FTQ() + ", CR AS (SELECT * FROM FT WHERE final_score > 0.50)\nSELECT count(*) AS total_rows, sum(is_ato) AS known_atos,"
  " max(model_score) AS rf_score_max, max(final_score) AS final_score_max, min(final_score) AS final_score_min,"
  " (SELECT count(*) FROM CR) AS critical_alerts, least(1000, count(*)) AS suspicious_alerts FROM FT",
  ["rf_score_max", "final_score_max", "final_score_min"],
  ["total_rows", "known_atos", "critical_alerts", "suspicious_alerts"])


# ---- streaming: deterministic, and equal to the batch plans, so checked against the same SQL ----
HQ = lambda: O.with_ctes(O.fixture_ctes(True), O.history_ctes())
GQ = lambda: O.with_ctes(O.fixture_ctes(True), O.graph_ctes())


#: Parts of the state at least (the fixture's log is small), logins that are worth a part, and logins of a part at most on average.
STATE_PARTITIONS = 4
ROWS_OF_A_PART = 50_000
MOST_ROWS_OF_A_PART = 200_000


def state_parts(logins: DataFrame) -> int:
    """Parts of the state of a log: they grow with it, so that no task's rows do, in full rounds of the cores. A part has its own
    store, which every batch opens and commits, so small parts are made only as far as there are cores for them."""
    n, cores = logins.count(), logins.sparkSession.sparkContext.defaultParallelism
    return max(STATE_PARTITIONS, min(-(-n // ROWS_OF_A_PART), -(-n // (MOST_ROWS_OF_A_PART * cores)) * cores))


def _stream(s, d, entities=False):
    """Ten files in time order, three a batch: four batches, and one that ends the input."""
    base = scratch(s, "stream")
    src = write_log_files(fixture_logins(s, d, True), f"{base}/in", 10)
    return run_user_state(s, src, f"{base}/out", 3, with_entities=entities, state_partitions=state_parts(fixture_logins(s, d, True)))


def _late(s, d):
    """Four files with interleaved times, one per batch: all rows come out, the late ones marked."""
    base = scratch(s, "late")
    src = write_log_files(fixture_logins(s, d, True), f"{base}/in", 4, F.col("event_id") % 4)
    return run_user_state(s, src, f"{base}/out", 1, state_partitions=state_parts(fixture_logins(s, d, True)))


_SU = ["event_id", "user_id", *BEHAVIOUR_FEATURES]
_SE = ["event_id", *GRAPH_ENTITY_FEATURES]
q("stream_user_state", lambda s, d: _stream(s, d).select(*_SU),
  HQ() + f"\nSELECT {', '.join(_SU)} FROM HF", [c for c in _SU if c in DOUBLE_FEATURES], [c for c in _SU if c not in DOUBLE_FEATURES], "2.15")
q("stream_entity_state", lambda s, d: _stream(s, d, True).select(*_SE),
  GQ() + f"\nSELECT {', '.join(_SE)} FROM GF", [c for c in _SE[1:] if c not in INT_COLS], ["event_id", *sorted(INT_COLS)], "2.15")
# a row is late if its user has let through a later one: one from an earlier batch, older than the watermark of that time
q("stream_late_rows", lambda s, d: _late(s, d).select("event_id", "user_id", "late"),
  O.with_ctes(O.fixture_ctes(True), "W AS (SELECT b, (SELECT max(login_us // 1000) FROM L WHERE event_id % 4 < b) AS wm FROM range(4) t(b))")
  + "\nSELECT e.event_id, e.user_id, CASE WHEN EXISTS (SELECT 1 FROM L o, W w WHERE w.b = e.event_id % 4 - 1 AND o.user_id = e.user_id"
  " AND o.event_id % 4 <= w.b AND o.login_us // 1000 < w.wm AND (o.login_us > e.login_us OR (o.login_us = e.login_us AND o.event_id > e.event_id)))"
  " THEN 1 ELSE 0 END AS late FROM L e", [], ["event_id", "user_id", "late"], "2.15")


def _states(s, d, end):
    base = scratch(s, "states")
    src = write_log_files(fixture_logins(s, d, True), f"{base}/in", 6)
    return run_states(s, src, f"{base}/out", 2, with_entities=True, end=end, state_partitions=state_parts(fixture_logins(s, d, True)))


def _state_size(s, d):
    """Keys and map entries that the operators hold after the stream, read from their state."""
    at = _states(s, d, True)
    keys = tracked(s, at["entity"], "totals").groupBy(F.col("key.kind").alias("state")).agg(F.count(F.lit(1)).alias("keys"))
    members = tracked(s, at["entity"], "users", True).groupBy(F.concat(F.col("key.kind"), F.lit("_users")).alias("state")).agg(
        F.sum(F.col("user_map_value.n")[0]).alias("keys"))
    seen = tracked(s, at["user"], "seen", True).select(F.inline(F.arrays_zip("user_map_value.part", "user_map_value.n"))).groupBy(
        F.concat(F.lit("user_"), F.col("part")).alias("state")).agg(F.sum("n").alias("keys"))
    users = tracked(s, at["user"], "totals").agg(F.lit("user").alias("state"), F.count(F.lit(1)).alias("keys"))
    rows = {"recent": "list_element.n", "waiting": "value.waiting"}
    held = [tracked(s, at[op], "recent" if state == "recent" else "totals").agg(
        F.lit(f"{op}_{state}").alias("state"), F.coalesce(F.sum(n), F.lit(0)).alias("keys")) for op in ("user", "entity") for state, n in rows.items()]
    return reduce(DataFrame.unionByName, [keys, members, seen, users, *held])


def _state_size_sql():
    cols = {"country": "country_key", "asn": "asn_key", "subnet": "subnet", "device": "device"}
    pairs = {"country_device": ("country_key", "device"), "asn_device": ("asn_key", "device"),
             "subnet_device": ("subnet", "device"), "country_asn": ("country_key", "asn_key")}
    out = [f"SELECT '{k}' AS state, count(DISTINCT {c}) AS keys FROM L UNION ALL SELECT '{k}_users', count(*) FROM (SELECT DISTINCT {c}, user_id FROM L)"
           f" UNION ALL SELECT 'user_{k}', count(*) FROM (SELECT DISTINCT {c}, user_id FROM L)" for k, c in cols.items()]
    out += [f"SELECT 'user_{k}', count(*) FROM (SELECT DISTINCT {a}, {b}, user_id FROM L)" for k, (a, b) in pairs.items()]
    out += ["SELECT 'user', count(DISTINCT user_id) FROM L"]
    out += [f"SELECT '{op}_{st}', 0" for op in ("user", "entity") for st in ("recent", "waiting")]
    return "\n" + " UNION ALL ".join(out)


q("state_size", _state_size, O.with_ctes(O.fixture_ctes(True)) + _state_size_sql(), [], ["keys"], "2.5")


def _evicted(s, d):
    """Keys that still hold events of the last hour, the input not ended: timers emptied all others."""
    at = _states(s, d, False)
    return reduce(DataFrame.unionByName, [tracked(s, at[op], "recent").select("key").distinct().agg(
        F.lit(op).alias("operator"), F.count(F.lit(1)).alias("keys")) for op in ("user", "entity")])


_KEPT = "login_us // 1000 < wm AND login_us >= wm * 1000 - 3600000000"
q("evict_expired", _evicted,
  O.with_ctes(O.fixture_ctes(True), "W AS (SELECT max(login_us // 1000) AS wm FROM L)")
  + f"\nSELECT 'user' AS operator, count(DISTINCT user_id) AS keys FROM L, W WHERE {_KEPT} UNION ALL SELECT 'entity', count(*) FROM ("
  + " UNION ALL ".join(f"SELECT DISTINCT '{k}', {c} FROM L, W WHERE {_KEPT}" for k, c in (
      ("country", "country_key"), ("asn", "asn_key"), ("subnet", "subnet"), ("device", "device"))) + ")", [], ["keys"], "2.15")

CHUNK, CHUNKS = 400, 2
#: Batches of a run to the end at most: a batch takes more whole chunks as there are more of them.
MAX_BATCHES = 32


def _chunks(s, d):
    """Chunks of exactly CHUNK rows in order, stopped after CHUNKS of them and then run to the end: what each chunk held."""
    base = scratch(s, "chunks")
    src = land_chunks(fixture_logins(s, d, True), f"{base}/in", CHUNK)
    per_batch = max(1, -(-len([n for n in children(s, src) if n.startswith("chunk=")]) // MAX_BATCHES))

    def each(batch, batch_id):
        batch.groupBy(F.regexp_extract("_file", "chunk=([0-9]+)/", 1).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"),
                  F.max("event_id").alias("last_id"), F.sum("event_id").alias("sum_id")).write.mode("overwrite").parquet(f"{base}/out/{batch_id}")

    def run(first):
        rows = login_stream(s, chunk_paths(s, src, first), per_batch)
        rows.select("*", F.col("_metadata.file_path").alias("_file")).writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/ck") \
            .trigger(availableNow=True).start().awaitTermination()
        return s.read.parquet(f"{base}/out/*").count()
    if run(CHUNKS) != CHUNKS:
        raise RuntimeError("the stream did not stop after its chunks")
    run(None)
    return s.read.parquet(f"{base}/out/*")


q("stream_row_chunks", _chunks,
  O.with_ctes(O.fixture_ctes(True), "P AS (SELECT event_id, (row_number() OVER (ORDER BY login_us, event_id) - 1) // 400 AS batch FROM L)")
  + "\nSELECT batch, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id, sum(event_id) AS sum_id FROM P GROUP BY batch",
  [], ["batch", "n_rows", "first_id", "last_id", "sum_id"], "2.1")


def _scorer(s, d):
    labels = materialize(fixture_logins(s, d, True).select("event_id", "is_ato", "is_attack_ip"))  # every batch reads it
    return lambda batch: surrogate_scores(batch.join(labels, "event_id"))


def _stream_score(s, d):
    """At least 12 micro-batches of scored rows."""
    base = scratch(s, "score")
    src = write_log_files(fixture_logins(s, d, True), f"{base}/in", 4)
    user_out = f"{base}/feat"
    run_states(s, src, user_out, 1, state_partitions=state_parts(fixture_logins(s, d, True)))
    n = len([f for f in children(s, user_out) if f.endswith(".parquet")])
    stream = s.readStream.schema(UserHistory.OUTPUT).option("maxFilesPerTrigger", max(1, n // 12)).parquet(user_out)
    scores, topk, conf = f"{base}/scores", f"{base}/topk", f"{base}/conf"
    score_batches(s, stream, _scorer(s, d), scores, topk, k=500, confusion_out=conf)
    return running_top_k(s, topk), s.read.parquet(conf), scores


def _scores_read_back(s, d):
    """The score table after a batch that was replayed and one that broke off before its commit."""
    scores = _stream_score(s, d)[2]
    again = materialize(s.read.parquet(f"{scores}/batch_id=3"))  # the batch's folder is overwritten
    append_scores(again.select("event_id", "user_id", "login_us"), 3, _scorer(s, d), scores, f"{scores}-top", 500)
    again.write.parquet(f"{scores}/batch_id=9999")
    return read_scores(s, scores).select("event_id", "user_id", "model_score", "is_ato")


_SCQ = lambda: O.with_ctes(O.fixture_ctes(True), O.scored_ctes())
q("stream_score_topk", lambda s, d: _stream_score(s, d)[0].select("event_id", "model_score", "is_ato"),
  _SCQ() + "\nSELECT event_id, model_score, is_ato FROM SC ORDER BY model_score DESC, event_id LIMIT 500",
  ["model_score"], ["event_id", "is_ato"], "2.15")
q("stream_confusion", lambda s, d: _stream_score(s, d)[1].agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]),
  _SCQ() + "\nSELECT sum(CASE WHEN is_ato = 1 AND model_score >= 0.5 THEN 1 ELSE 0 END) AS tp,"
  " sum(CASE WHEN is_ato = 0 AND model_score >= 0.5 THEN 1 ELSE 0 END) AS fp,"
  " sum(CASE WHEN is_ato = 0 AND model_score < 0.5 THEN 1 ELSE 0 END) AS tn,"
  " sum(CASE WHEN is_ato = 1 AND model_score < 0.5 THEN 1 ELSE 0 END) AS fn FROM SC", [], ["tp", "fp", "tn", "fn"], "2.15")
q("stream_scores_read_back", _scores_read_back, _SCQ() + "\nSELECT event_id, user_id, model_score, is_ato FROM SC",
  ["model_score"], ["event_id", "user_id", "is_ato"], "2.1")
