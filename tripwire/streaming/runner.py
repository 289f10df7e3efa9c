"""Stream plumbing: logins landing as files, the stateful feature queries on event time, and a
``foreachBatch`` scorer that appends scores, keeps a running top-k and confusion counters."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import with_position
from ..session import scratch_path
from ..sources.logins import LOGIN_SCHEMA, parse_raw, prepare_logins
from .entity_state import EntityHistory, entity_state
from .entity_state import features as entity_features
from .event_time import END_OF_TIME, use_state_store, watermarked
from .user_state import UserHistory, user_state
from .user_state import features as user_features

#: Modification time of the first landed chunk.
FIRST_LANDING_MS = 1_600_000_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, name)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, on any file system; none if it does not exist."""
    fs, p = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def write_log_files(raw_logins: DataFrame, path: str, files: int, chunk: Column | None = None) -> str:
    """Write raw logins as files that land one after the other: file i holds an earlier time range than
    file i + 1, or the rows whose ``chunk`` is i. The file source takes files in the order they were
    written, so this works on any file system. The time cuts are approximate quantiles (any cuts will do)."""
    if chunk is None:
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', login_ts)")
        cuts = raw_logins.agg(F.percentile_approx(us, [i / files for i in range(1, files)], 1000)).first()[0] or []
        chunk = reduce(lambda c, x: c + F.when(us > x, 1).otherwise(0), cuts, F.lit(0))
    # one pass deals the rows out; a file is then its own chunk's rows only
    spark = raw_logins.sparkSession
    dealt = scratch(spark, "dealt")
    raw_logins.withColumn("_chunk", chunk.cast("long")).write.partitionBy("_chunk").parquet(dealt)
    made = set(children(spark, dealt))
    for i in range(files):
        rows = spark.read.schema(raw_logins.schema).parquet(f"{dealt}/_chunk={i}") if f"_chunk={i}" in made else raw_logins.limit(0)
        rows.repartition(1).write.mode("append").parquet(path)
    return path


def land_chunks(raw_logins: DataFrame, path: str, rows: int, order: tuple[str, ...] = ("login_ts", "event_id")) -> str:
    """Write raw logins as chunks of exactly ``rows`` rows in order (the last may be shorter), one file each, in one job.

    A row's chunk comes from its global position, so no task holds more than a chunk. The file source takes files by
    modification time, which is set to the chunk's place (the file system must allow that)."""
    spark = raw_logins.sparkSession
    placed = with_position(raw_logins, list(order), "_pos").withColumn("chunk", F.floor(F.col("_pos") / rows).cast("long")).drop("_pos")
    placed.repartition("chunk").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("chunk").parquet(path)
    fs, p = _file_system(spark, path)
    for name in children(spark, path):
        if name.startswith("chunk="):
            for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(p, name)):
                fs.setTimes(f.getPath(), FIRST_LANDING_MS + 1000 * int(name.split("=")[1]), -1)
    return path


def chunk_paths(spark: SparkSession, path: str, first: int | None = None) -> str:
    """The chunks that :func:`land_chunks` wrote (the ``first`` of them) as a path for the file source."""
    names = sorted((n for n in children(spark, path) if n.startswith("chunk=")), key=lambda n: int(n.split("=")[1]))
    return f"{path}/{{{','.join(names[:first])}}}"


def first_files(spark: SparkSession, path: str, n: int) -> str:
    """The ``n`` files of a folder that the file source takes first, as a path for it."""
    fs, p = _file_system(spark, path)
    files = [f for f in fs.listStatus(p) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    files.sort(key=lambda f: (f.getModificationTime(), f.getPath().getName()))
    return f"{path}/{{{','.join(f.getPath().getName() for f in files[:n])}}}"


def login_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, fmt: str = "parquet", id_col: str | None = None,
                 repeats_share_id: bool = False) -> DataFrame:
    """Files of logins as a stream: Parquet in our schema, or CSV under the log's headers (of the files there now), with
    ``id_col`` or where no two rows of a file are equal (``repeats_share_id``)."""
    r = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        return parse_raw(r.option("header", True).schema(spark.read.option("header", True).csv(path).schema).csv(path), id_col, repeats_share_id)
    return r.schema(LOGIN_SCHEMA).parquet(path)


def _end_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of closing rows, none as yet."""
    fs, p = _file_system(spark, folder)
    fs.mkdirs(p)
    return spark.readStream.schema("event_time timestamp").parquet(folder)


def _end_input(spark: SparkSession, folder: str) -> None:
    if not children(spark, folder):
        spark.sql(f"SELECT TIMESTAMP '{END_OF_TIME}' AS event_time").coalesce(1).write.mode("append").parquet(folder)


@contextmanager
def _setting(spark: SparkSession, key: str, value):
    before = spark.conf.get(key)
    if value is not None:
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_states(spark: SparkSession, path: str, out: str, files_per_trigger: int = 1, checkpoint: str | None = None,
               max_batches: int | None = None, with_entities: bool = False, delay: str = "0 seconds",
               end: bool = True, ttl_us: int | None = None, state_partitions: int | None = None) -> dict[str, str]:
    """Run the stateful streams over what is in ``path`` now; the checkpoint of each operator.

    User rows go to ``out``, and ``with_entities`` entity rows to ``<out>-entities``, both as streams of their own over the
    same files. Rows wait for the watermark (``delay`` behind the latest event); ``end`` says that the input has
    ended, which lets all of them through. ``max_batches`` stops after that many batches by offering no more files
    than they take; a later run with the same checkpoint goes on behind them. ``state_partitions`` is how many parts the
    state has (fixed by the first run; default: the session's shuffle partitions)."""
    ck = checkpoint or scratch(spark, "stream-ckpt")
    use_state_store(spark)
    source = first_files(spark, path, max_batches * files_per_trigger) if max_batches else path
    made = {"user": (user_state, out)}
    if with_entities:
        made["entity"] = (entity_state, f"{out}-entities")
    at = {}
    for name, (state, sink) in made.items():
        at[name] = f"{ck}/{name}"
        for step in ("rows", "end") if end and not max_batches else ("rows",):
            if step == "end":
                _end_input(spark, f"{ck}/{name}-end")
            rows = prepare_logins(login_stream(spark, source, files_per_trigger))
            x = state(watermarked(rows, delay, _end_stream(spark, f"{ck}/{name}-end")), ttl_us)
            with _setting(spark, "spark.sql.shuffle.partitions", state_partitions):
                w = x.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at[name])
                w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return at


def run_user_state(spark: SparkSession, path: str, out: str, files_per_trigger: int = 1,
                   checkpoint: str | None = None, max_batches: int | None = None,
                   with_entities: bool = False, **options) -> DataFrame:
    """:func:`run_states`, and its output with all behaviour features (and graph features, ``with_entities``)."""
    run_states(spark, path, out, files_per_trigger, checkpoint, max_batches, with_entities, **options)
    rows = user_features(spark.read.schema(UserHistory.OUTPUT).parquet(out))
    if with_entities:
        e = entity_features(spark.read.schema(EntityHistory.OUTPUT).parquet(f"{out}-entities"))
        rows = rows.join(e.withColumnRenamed("late", "late_at_entity"), "event_id")
    return rows


def tracked(spark: SparkSession, checkpoint: str, state: str, flat: bool = False) -> DataFrame:
    """What an operator's state holds after its last batch, read from the state store itself."""
    r = spark.read.format("statestore").option("stateVarName", state)
    return (r.option("flattenCollectionTypes", "true") if flat else r).load(checkpoint)


def score_batches(spark: SparkSession, features: DataFrame, score_fn, scores_out: str, topk_out: str, k: int = 5000,
                  checkpoint: str | None = None, threshold: float = 0.5, confusion_out: str | None = None):
    """foreachBatch scorer: (event, user, score, label) of each micro-batch, the running top-k and the batch's
    confusion counts at ``threshold``. Everything is written to ``batch_id=<n>`` with overwrite, so a batch that
    Spark replays after a failure counts once, and a batch's commit is written last (:func:`read_scores`). The running
    top-k of a batch is merged from its own best ``k`` and the folder of the latest earlier batch (at most 2k rows)."""
    ck = checkpoint or scratch(spark, "score-ckpt")

    def each(batch: DataFrame, batch_id: int):
        append_scores(batch, batch_id, score_fn, scores_out, topk_out, k, threshold, confusion_out)

    q = features.writeStream.foreachBatch(each).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()


def append_scores(batch: DataFrame, batch_id: int, score_fn, scores_out: str, topk_out: str, k: int, threshold: float = 0.5,
                  confusion_out: str | None = None) -> None:
    """One batch of :func:`score_batches`; doing it again changes nothing."""
    spark = batch.sparkSession
    order = [F.col("model_score").desc(), F.col("event_id")]
    part = f"batch_id={batch_id}"
    s = score_fn(batch).select("event_id", "user_id", "login_us", "model_score", "is_ato")
    s.write.mode("overwrite").parquet(f"{scores_out}/{part}")
    s = spark.read.schema(s.schema).parquet(f"{scores_out}/{part}")
    if confusion_out:
        p, y = (F.col("model_score") >= threshold).cast("int"), F.col("is_ato")
        cell = lambda a, b: F.coalesce(F.sum(((y == a) & (p == b)).cast("long")), F.lit(0))
        s.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn")) \
            .write.mode("overwrite").parquet(f"{confusion_out}/{part}")
    best = s.orderBy(*order).limit(k)
    before = latest_batch(spark, topk_out, batch_id)
    if before is not None:
        best = best.unionByName(spark.read.schema(s.schema).parquet(f"{topk_out}/batch_id={before}"))
    best.orderBy(*order).limit(k).write.mode("overwrite").parquet(f"{topk_out}/{part}")
    s.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("rows")) \
        .write.mode("overwrite").parquet(f"{scores_out}/_commits/{batch_id}")


def read_scores(spark: SparkSession, scores_out: str) -> DataFrame:
    """The rows of committed batches, with ``batch_id``; what an unfinished batch left is not read."""
    commits = spark.read.schema("batch_id long, rows long").parquet(f"{scores_out}/_commits/*")
    rows = spark.read.option("basePath", scores_out).parquet(f"{scores_out}/batch_id=*")
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(commits.select("batch_id"), "batch_id", "left_semi")


def score_logins(spark: SparkSession, rows: str, logins: DataFrame, model, scores_out: str, topk_out: str, k: int = 5000,
                 files_per_trigger: int = 1000, checkpoint: str | None = None, confusion_out: str | None = None) -> None:
    """Score what :func:`run_states` (``with_entities``) put out at ``rows`` with a fitted detector, as a stream.

    A batch of user rows meets the entity rows and the ``logins`` columns (labels, device type) of its own time span only: the
    bounds are pushed down to the entity files, which are written in time order."""
    entities = spark.read.schema(EntityHistory.OUTPUT).parquet(f"{rows}-entities")

    def score(batch: DataFrame) -> DataFrame:
        lo, hi = batch.agg(F.min("login_us"), F.max("login_us")).first()
        near = entity_features(entities.where(F.col("login_us").between(F.lit(lo), F.lit(hi))))
        x = user_features(batch).join(near.drop("late"), "event_id").join(logins, "event_id")
        return model.transform(x)

    stream = spark.readStream.schema(UserHistory.OUTPUT).option("maxFilesPerTrigger", files_per_trigger).parquet(rows)
    score_batches(spark, stream, score, scores_out, topk_out, k, checkpoint, model.getOrDefault(model.threshold), confusion_out)


def latest_batch(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Largest batch number with a folder below ``path`` (less than ``before``)."""
    ids = [int(n.split("=")[1]) for n in children(spark, path) if n.startswith("batch_id=")]
    return max((i for i in ids if before is None or i < before), default=None)


def running_top_k(spark: SparkSession, topk_out: str) -> DataFrame:
    """The running top-k after the last batch."""
    return spark.read.parquet(f"{topk_out}/batch_id={latest_batch(spark, topk_out)}")
