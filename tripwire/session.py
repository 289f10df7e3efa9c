"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_HANDED_OUT: list[str] = []

# Settings the library depends on for determinism (UTC calendar functions,
# adaptive re-planning for skew and partition coalescing).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tripwire", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass master=None and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(REQUIRED_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume to an existing session."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - static conf on some deployments
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``tripwire`` importable in the Python workers (pandas UDFs, stateful streaming).

    The package is zipped once per application on the driver and registered with
    ``addPyFile``; Spark's own file server hands it to every executor, whatever the file system
    of the checkpoint folder is."""
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_tripwire_pyfile", None):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="tripwire-py-"), "tripwire.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("tripwire", os.path.relpath(full, pkg)))
    sc.addPyFile(zpath)
    sc._tripwire_pyfile = zpath


def is_local(spark: SparkSession) -> bool:
    """One machine: the driver and all tasks share its folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The deployment sets it on a cluster (a file system that all executors reach); without it a
    cluster session is an error, since a folder of one machine would lose rows. Only a
    ``local[...]`` session, as in tests, gets a scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tripwire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if getattr(sc, "_tripwire_ckpt", None) != d:
        sc.setCheckpointDir(d)
        sc._tripwire_ckpt = d
    return d


def materialize(df, enabled: bool = True):
    """Cut the lineage: write ``df`` as Parquet under the shared checkpoint folder, read it back.

    Used where a frame feeds several branches (so it is not recomputed), where range bounds
    or generated ids must stay fixed between two reads, and before long chains (a lost
    executor then replays from the files, not from the source). One job writes it; an eager
    ``checkpoint()`` would compute the plan twice (count, then write).
    """
    if not enabled:
        return df
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task of a shuffle is given on average where many sorts or windows follow on it.
ROWS_OF_A_TASK = 60_000


def parts_for(spark: SparkSession, rows: int, most: int = ROWS_OF_A_TASK) -> int:
    """Shuffle partitions for ``rows`` rows: as many as they ask for, so that no task's share grows with the input, however
    few partitions the session has (it may also have more than the rows fill). More tasks than cores come in full rounds."""
    cores, need = spark.sparkContext.defaultParallelism, -(-rows // most)
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), cores), need if need <= cores else -(-need // cores) * cores)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; :func:`release` deletes all that were handed out."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path that :func:`scratch_path` handed out, before :func:`release` would."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _HANDED_OUT:
        _HANDED_OUT.remove(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release(spark: SparkSession) -> int:
    """Delete the written intermediate tables of the session (call it when their results are
    stored). Uses Spark's file system API, so that any URI works. Returns how many went."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _HANDED_OUT:
        p = jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n
