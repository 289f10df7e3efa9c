"""Stream = batch: the stateful streams give the batch plans' values for several chunkings of the log, for rows in
any order within the watermark's delay, and across a restart from the checkpoint."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tripwire.operators.history import BEHAVIOUR_FEATURES, user_history
from tripwire.operators.infra import GRAPH_ENTITY_FEATURES, graph_features
from tripwire.sources.logins import fixture_logins, load_fixture, prepare_logins, read_logins
from tripwire.streaming.runner import (
    append_scores,
    children,
    land_chunks,
    latest_batch,
    login_stream,
    read_scores,
    run_states,
    run_user_state,
    running_top_k,
    score_batches,
    tracked,
    write_log_files,
)

from .conftest import SF001

@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


COLS = [*BEHAVIOUR_FEATURES, *GRAPH_ENTITY_FEATURES]


@pytest.fixture(scope="module")
def batch(spark):
    h = graph_features(user_history(load_fixture(spark, SF001, True))).select("event_id", *COLS)
    return {r["event_id"]: tuple(r[c] for c in COLS) for r in h.collect()}


def read(out, cols=COLS):
    return {r["event_id"]: tuple(r[c] for c in cols) for r in out.collect()}


def assert_same(got, batch):
    assert got.keys() == batch.keys()
    diff = [e for e in got if got[e] != pytest.approx(batch[e], abs=1e-9)]
    assert not diff, (len(diff), diff[:5])


# 3 batches; 10 batches
@pytest.mark.parametrize("files,per_trigger", [(9, 3), (10, 1)])
def test_stream_equals_batch(spark, batch, files, per_trigger):
    d = tempfile.mkdtemp(prefix="tw-stream-")
    src = write_log_files(fixture_logins(spark, SF001, True), os.path.join(d, "in"), files)
    out = run_user_state(spark, src, os.path.join(d, "out"), per_trigger, with_entities=True)
    assert_same(read(out), batch)
    assert out.where("late = 1 or late_at_entity = 1").count() == 0


def test_rows_in_any_order_within_the_delay(spark, batch):
    """Files with interleaved times: each batch spans all the time, the watermark's delay covers it."""
    d = tempfile.mkdtemp(prefix="tw-stream-")
    src = write_log_files(fixture_logins(spark, SF001, True), os.path.join(d, "in"), 4, F.col("event_id") * 7 % 4)
    out = run_user_state(spark, src, os.path.join(d, "out"), 1, with_entities=True, delay="4 hours")
    assert_same(read(out), batch)
    assert out.where("late = 1 or late_at_entity = 1").count() == 0


def test_restart_from_checkpoint(spark, batch):
    d = tempfile.mkdtemp(prefix="tw-stream-")
    src = write_log_files(fixture_logins(spark, SF001, True), os.path.join(d, "in"), 6)
    ck, out = os.path.join(d, "ck"), os.path.join(d, "out")
    first = run_user_state(spark, src, out, 1, checkpoint=ck, max_batches=2)
    n = first.count()
    assert 0 < n < len(batch)
    res = run_user_state(spark, src, out, 1, checkpoint=ck, with_entities=True)  # resumes where it stopped
    assert_same(read(res), batch)


def test_late_rows_come_out_marked_and_counted(spark, batch):
    """Files in reverse time order: every row comes out once, late ones marked, none lost."""
    d = tempfile.mkdtemp(prefix="tw-stream-")
    rows = fixture_logins(spark, SF001, True)
    src = write_log_files(rows, os.path.join(d, "in"), 4, 3 - F.floor(F.col("event_id") * 4 / rows.count()))
    at = run_states(spark, src, os.path.join(d, "out"), 1, f"{d}/ck", with_entities=True)
    out = run_user_state(spark, src, os.path.join(d, "out"), 1, f"{d}/ck", with_entities=True)  # nothing new
    got = {r["event_id"]: r for r in out.collect()}
    assert out.count() == len(got) == len(batch)
    late = [r for r in got.values() if r["late"]]
    assert late and len(late) < len(got)
    assert all(r["time_since_last_login_sec"] == 0 for r in late)  # a negative gap counts as 0
    counted = tracked(spark, at["user"], "place").agg(F.sum("value.late")).first()[0]
    assert counted == len(late)


def test_a_timer_forgets_without_new_rows(spark):
    """Two users; one stops, the other goes on for hours: the first one's last hour is emptied, the totals stay."""
    from tripwire.sources.logins import LOGIN_SCHEMA
    d = tempfile.mkdtemp(prefix="tw-stream-")
    for i in range(4):
        spark.sql(f"""SELECT id AS event_id, CASE WHEN id = 0 THEN 1 ELSE 2 END AS user_id,
          TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 50 * id) AS login_ts, '1.2.3.4' AS ip, 'C' AS country, 1L AS asn, 'd' AS device_type,
          'o' AS os_name, 'b' AS browser, 1 AS success, 1D AS rtt_ms, 0 AS is_attack_ip, 0 AS is_ato FROM range({i}, {i + 1})""") \
            .select([F.col(f.name).cast(f.dataType) for f in LOGIN_SCHEMA.fields]).coalesce(1).write.mode("append").parquet(f"{d}/in")
    at = run_states(spark, f"{d}/in", f"{d}/out", 1, f"{d}/ck", with_entities=True, end=False)
    held = {r["key"][0] for r in tracked(spark, at["user"], "recent").collect()}
    assert held == {2}
    assert {r["key"][0] for r in tracked(spark, at["user"], "totals").collect()} == {1, 2}
    users = tracked(spark, at["entity"], "recent").where("key.kind = 'country'").collect()
    assert "2" in str(users) and spark.read.parquet(f"{d}/out").count() == 3  # the last row waits for the watermark


def test_forgetting_by_event_time(spark):
    """``ttl_us`` bounds the maps: entities not used for an hour go."""
    d = tempfile.mkdtemp(prefix="tw-stream-")
    src = write_log_files(fixture_logins(spark, SF001, True), os.path.join(d, "in"), 3)
    kept = run_states(spark, src, f"{d}/a", 1, f"{d}/cka")
    less = run_states(spark, src, f"{d}/b", 1, f"{d}/ckb", ttl_us=3600 * 1_000_000)
    assert 0 <= tracked(spark, less["user"], "seen", True).count() < tracked(spark, kept["user"], "seen", True).count()


def test_chunks_hold_exactly_n_rows(spark):
    d = tempfile.mkdtemp(prefix="tw-stream-")
    src = land_chunks(fixture_logins(spark, SF001, True), f"{d}/in", 300)
    sizes = {n: spark.read.parquet(f"{src}/{n}").count() for n in children(spark, src) if n.startswith("chunk=")}
    assert sizes == {"chunk=0": 300, "chunk=1": 300, "chunk=2": 300, "chunk=3": 100}


def test_a_replayed_batch_counts_once(spark):
    d = tempfile.mkdtemp(prefix="tw-stream-")
    rows = load_fixture(spark, SF001, True)

    def score(b):
        return b.withColumn("model_score", F.col("event_id") / 1000)
    for batch_id in (0, 1, 1, 0):
        append_scores(rows.where(F.col("event_id") % 2 == batch_id), batch_id, score, f"{d}/s", f"{d}/t", 20, confusion_out=f"{d}/c")
    rows.limit(5).write.parquet(f"{d}/s/batch_id=7")  # a batch that broke off before its commit
    got = read_scores(spark, f"{d}/s")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in rows.select("event_id").collect())


@pytest.mark.parametrize("prefix", ["", "file:"])
def test_running_top_k_and_confusion_over_many_batches(spark, prefix):
    d = prefix + tempfile.mkdtemp(prefix="tw-stream-")
    rows = fixture_logins(spark, SF001, True)
    src = write_log_files(rows, f"{d}/in", 14)
    feats = prepare_logins(login_stream(spark, src, 1))

    def score(b):
        return b.withColumn("model_score", F.col("event_id") * 7919 % 1009 / 1009)
    score_batches(spark, feats, score, f"{d}/s", f"{d}/t", k=50, confusion_out=f"{d}/c")
    assert latest_batch(spark, f"{d}/t") >= 12
    want = score(load_fixture(spark, SF001, True)).orderBy(F.col("model_score").desc(), "event_id").limit(50)
    assert [r["event_id"] for r in want.collect()] == [r["event_id"] for r in running_top_k(spark, f"{d}/t").orderBy(
        F.col("model_score").desc(), "event_id").collect()]
    c = spark.read.parquet(f"{d}/c").groupBy().sum("tp", "fp", "tn", "fn").first()
    assert sum(c) == rows.count() == spark.read.parquet(f"{d}/s").count()


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace

    from tripwire.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)


def test_release_deletes_intermediate_tables(spark):
    from tripwire.session import materialize, release
    release(spark)
    t = materialize(spark.range(5))
    path = t.inputFiles()[0][len("file://"):]
    assert os.path.exists(path) and release(spark) == 1 and not os.path.exists(path)


def test_a_log_lacking_a_column_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="tw-csv-")
    spark.createDataFrame([("1", "x")], "`User ID` string, Extra string").write.option("header", True).csv(d + "/l")
    with pytest.raises(ValueError, match="Login Timestamp"):
        read_logins(spark, d + "/l")


class _Handle:
    """The states of one key in memory, every value through a copy, and how often they were called."""

    def __init__(self):
        self.made, self.calls, self.timers = {}, 0, set()

    def getValueState(self, name, schema):
        return self.made.setdefault(name, _Kept(self))

    getListState = getMapState = lambda self, name, *schema: self.made.setdefault(name, _Kept(self))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class _Kept:
    def __init__(self, handle):
        self.handle, self.value, self.map = handle, None, {}

    def _call(self):
        self.handle.calls += 1

    def get(self):
        self._call()
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, v):
        self._call()
        self.value = v

    def put(self, v):
        self._call()
        self.handle.values = getattr(self.handle, "values", 0) + len(v)
        self.value = list(v)

    def appendList(self, v):
        self.put((self.value or []) + list(v))

    def clear(self):
        self._call()
        self.value = []

    def getValue(self, k):
        self._call()
        return self.map.get(k)

    def updateValue(self, k, v):
        self._call()
        self.map[k] = v

    def removeKey(self, k):
        self.map.pop(k, None)


def _walked(rows):
    """Prior counts of one entity, row by row."""
    for i, (t, eid, member, _) in enumerate(rows):
        prior = rows[:i]
        last = {m: u for u, _, m, _ in prior}
        yield (eid, len(last), i, sum(r[3] for r in prior), len({r[2] for r in prior if r[3]}),
               sum(u >= t - 600_000_000 for u in last.values()), sum(u >= t - 3_600_000_000 for u in last.values()))


def test_a_busy_entity_crosses_to_the_state_in_pieces():
    """Windows with gaps of hours, ties, equal times of one user; thousands of rows wait as a few values, and come out right."""
    import pickle
    import random

    from tripwire.streaming.entity_state import EntityHistory
    from tripwire.streaming.event_time import PIECE, pack
    rng, t, rows = random.Random(4), 10**12, []
    for i in range(1200):
        t += rng.choice([0, 0, 10**6, 60 * 10**6, 650 * 10**6, 3600 * 10**6 + rng.randrange(-1, 2), 9000 * 10**6 if i % 97 == 0 else 0])
        rows.append((t, i, f"u{rng.randrange(25)}", int(rng.random() < 0.3)))
    h = _Handle()
    p = EntityHistory()
    p.init(h)
    got = []
    for lo in range(0, 1200, 400):
        batch = rows[lo:lo + 400]
        rng.shuffle(batch)
        mark = (rows[lo - 1][0] // 1000 if lo else 0)
        packed = [{"packed": pack(batch[i:i + 100])} for i in range(0, 400, 100)]
        got += [(r.n, r.numbers, r.words) for r in p._pass(("country", "C"), p.rows_of(iter(packed)), mark)]
    got += [(r.n, r.numbers, r.words) for r in p._pass(("country", "C"), [], 10**12)]
    assert sum(n for n, *_ in got) == 1200 and len(got) <= 4 and h.values < 12  # not a value for each row
    flat = [v for _, numbers, _ in got for v in numbers]
    out = [tuple(flat[i:i + 9]) for i in range(0, len(flat), 9)]  # event_id, login_us, late, users, events, fails, failed, 10 min, hour
    assert [(o[0], *o[3:]) for o in out] == list(_walked(rows)) and not any(o[2] for o in out)
    assert pickle.loads(h.made["totals"].value[1])[3] is None and not h.made["recent"].value and PIECE >= 400


def test_state_parts_follow_cores_and_rows(spark, monkeypatch):
    from tripwire.plans import queries_io as Q
    monkeypatch.setattr(Q, "ROWS_OF_A_PART", 10)
    monkeypatch.setattr(Q, "MOST_ROWS_OF_A_PART", 40)
    cores = spark.sparkContext.defaultParallelism
    assert [Q.state_parts(spark.range(n)) for n in (0, 35, 40 * cores, 40 * cores + 1)] == [4, 4, cores, 2 * cores]
