"""What must not grow with the input: round trips to the state, rows of a task, batches of a stream."""

from collections import Counter

from pyspark.sql import functions as F

from tripwire.operators import history, sweep
from tripwire.operators.detectors import recon
from tripwire.operators.history import user_history
from tripwire.operators.infra import entity_counts, graph_features
from tripwire.plans import queries_io
from tripwire.session import materialize, parts_for
from tripwire.sources.logins import load_fixture, prepare_logins
from tripwire.streaming.event_time import Slots

from .conftest import SF001


class _State:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, Counter()

    def getMapState(self, *_):
        return self

    def getValue(self, k):
        self.calls["get"] += 1
        return self.held.get(k)

    def updateValue(self, k, v):
        self.calls["put"] += 1
        self.held[k] = v

    def removeKey(self, k):
        self.held.pop(k, None)


def test_slots_hold_a_map_of_any_size_in_few_calls():
    state, size, want = _State(), (1, 0), {}
    slots = Slots(state, "m", "kind string, value string", "last_us long")
    for batch in range(5):
        slots.begin(*size)
        state.calls.clear()
        for i in range(batch * 1000, batch * 1000 + 1500):  # a third of them known from the batch before
            k = ("a" if i % 2 else "b", f"v{i}é")
            assert slots.get(k) == want.get(k)
            want[k] = (i + batch,)
            slots.put(k, want[k])
        size = slots.end()
        assert size[1] == len(want) and size[0] * Slots.FULL >= len(want)
        assert sum(state.calls.values()) <= 2 * size[0] + size[0]
    slots.begin(*size)
    slots.forget(lambda v: v[0] < 3000)
    size = slots.end()
    slots.begin(*size)
    left = {k: v for k, v in want.items() if v[0] >= 3000}
    assert {k: slots.get(k) for k in want} == {k: left.get(k) for k in want} and size[1] == len(left)


def test_rows_of_a_task_are_set_by_their_number(spark):
    """The user windows and the entity sweep ask for partitions by rows, not by the bytes of a shuffle."""
    h = user_history(load_fixture(spark, SF001, True), max_rows=20)
    assert "REPARTITION_BY_NUM" in h._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in entity_counts(h)._jdf.queryExecution().sparkPlan().toString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(spark, 10) <= parts and parts_for(spark, 600_000_000) >= 10_000


def _shuffles(df):
    return [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in ln]


def test_rows_of_uncut_users_are_shuffled_once(spark):
    """The constant bucket of uncut users must not bring a second shuffle, whose partitions are set by bytes."""
    shuffles = _shuffles(user_history(load_fixture(spark, SF001, True)))
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0], shuffles


def test_feature_join_shuffles_by_rows_only(spark):
    """Both sides of the wide join have the same partitions: neither is shuffled again to the session's number."""
    joined = [ln for ln in _shuffles(graph_features(user_history(load_fixture(spark, SF001, True)))) if "hashpartitioning(event_id" in ln]
    assert len(joined) == 2 and all("REPARTITION_BY_NUM" in ln for ln in joined), joined


def test_sorts_of_cut_users_follow_on_shuffles_by_rows(spark, monkeypatch):
    """No table of the cut users is sorted in partitions set by bytes, nor as a task reads it from a file."""
    written = []
    plain = history.materialize
    monkeypatch.setattr(history, "materialize", lambda d, *a: (written.append(d), plain(d, *a))[1])
    rows, _ = history.split_users(load_fixture(spark, SF001, True), 20)
    written.append(history._carried(rows))
    for d in written:
        assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()
        for ln in _shuffles(d):
            # by bytes: only counts of a user or a bucket, combined before
            assert "REPARTITION_BY_NUM" in ln or "[user_id" not in ln.split("ENSURE_REQUIREMENTS")[1].split("plan_id")[0], ln
        p = d._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in p or "REPARTITION_BY_NUM" in p


def test_cut_users_with_null_and_repeated_keys(spark):
    """Null users, rows that repeat their id and rows of one instant: cut users have the features of whole ones."""
    x = spark.range(240).selectExpr(
        "id div 2 AS event_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS user_id",
        "timestampadd(MINUTE, CAST(id div 2 * 7 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS login_ts",
        "concat('10.0.', id % 5, '.1') AS ip", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('C', id % 4) END AS country", "CAST(1 AS BIGINT) AS asn",
        "'d' AS device_type", "'o' AS os_name", "concat('b', id % 2) AS browser", "CAST(id % 4 > 0 AS INT) AS success", "1.0D AS rtt_ms",
        "0 AS is_attack_ip", "0 AS is_ato")
    x = materialize(prepare_logins(x.dropDuplicates(["event_id", "user_id"])))
    cols = ["event_id", "user_id", *history.BEHAVIOUR_FEATURES]
    whole, cut = (sorted(map(str, user_history(x, max_rows=m).select(*cols).collect())) for m in (1000, 8))
    assert whole == cut and len(whole) == x.count()


def test_narrower_buckets_give_the_same_counts(spark, monkeypatch):
    h = materialize(user_history(load_fixture(spark, SF001, True)))
    want = sorted(map(tuple, entity_counts(h).collect()))
    buckets = []
    plain = sweep.running_prior_sums
    monkeypatch.setattr(sweep, "running_prior_sums", lambda *a, **k: (buckets.append(a[5]), plain(*a, **k))[1])
    monkeypatch.setattr(sweep, "MAX_BUCKET_ROWS", 30)
    assert sorted(map(tuple, entity_counts(h).collect())) == want
    assert buckets[0] < sweep.DEFAULT_BUCKET_US / 5


def test_a_step_of_the_network_reads_its_own_rows(spark):
    x = spark.range(5000).select(F.col("id").cast("double").alias("a"), F.xxhash64("id").alias("_key"))
    seen = []
    for epoch in (0, 1):
        path = recon._deal(x, epoch, 4, 5000)
        parts = {s: {r["a"] for r in spark.read.schema(x.schema).parquet(f"{path}/_s={s}").collect()} for s in range(4)}
        assert sum(map(len, parts.values())) == 5000 and len(set().union(*parts.values())) == 5000
        assert parts[0] == {r["a"] for r in x.where(F.pmod(F.xxhash64("_key", F.lit(epoch)), F.lit(4)) == 0).collect()}
        seen.append(parts[0])
    assert seen[0] != seen[1]


def test_many_chunks_come_in_few_batches(spark, monkeypatch):
    """Ten chunks, three batches: each chunk is told apart, none is cut or joined."""
    batches = []
    plain = queries_io.login_stream
    monkeypatch.setattr(queries_io, "MAX_BATCHES", 3)
    monkeypatch.setattr(queries_io, "CHUNK", 100)
    monkeypatch.setattr(queries_io, "login_stream", lambda s, p, n: (batches.append(n), plain(s, p, n))[1])
    got = {r["batch"]: (r["n_rows"], r["sum_id"]) for r in queries_io._chunks(spark, SF001).collect()}
    ids = [r["event_id"] for r in load_fixture(spark, SF001, True).orderBy("login_us", "event_id").collect()]
    assert got == {i: (len(c), sum(c)) for i in range(-(-len(ids) // 100)) for c in [ids[100 * i:100 * i + 100]]}
    assert batches == [-(-len(got) // 3)] * 2
