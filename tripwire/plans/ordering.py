"""Global order without one partition: positions and running sums over a total order.

``repartitionByRange`` spreads the rows over ordered partitions; the row's place inside
its partition comes from ``monotonically_increasing_id`` (low 33 bits), and per-partition
counts (one row per partition, a bounded table) give the offsets. No
``Window.orderBy`` without ``partitionBy`` is ever applied to unbounded data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sweep import running_prior_sums
from ..session import materialize

LOW33 = (1 << 33) - 1


def _parts(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: list[Column | str], name: str = "pos",
                  num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add a 0-based global position by ``order`` (make it total, e.g. end with an id)."""
    r = (df.repartitionByRange(_parts(df, num_partitions), *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    r = materialize(r, checkpoint)  # range bounds are sampled: fix them before two reads
    r = r.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_lid", F.col("_mid").bitwiseAND(F.lit(LOW33)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # bounded: one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(offs), "_pid")
    return out.select(*df.columns, (F.col("_off") + F.col("_lid")).alias(name))


def cut_rows(df: DataFrame, order: list[str], positions: list[int]) -> list[tuple | None]:
    """The ``order`` values of the rows at some 0-based positions (None beyond the end).

    Only the ``order`` columns are sorted and written; a wide frame is then cut by comparing
    with these few tuples (:func:`before`) and is not shuffled at all."""
    at = with_position(df.select(*order), list(order), "_pos").where(F.col("_pos").isin([int(p) for p in positions]))
    got = {r["_pos"]: tuple(r[c] for c in order) for r in at.collect()}  # at most one row per position
    return [got.get(int(p)) for p in positions]


def before(order: list[str], cut: tuple | None) -> Column:
    """Whether a row stands before ``cut`` in ``order``."""
    if cut is None:
        return F.lit(True)
    return F.struct(*[F.col(c) for c in order]) < F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cut, strict=True)])


def global_prior_sums(df: DataFrame, order: list[str], values: list[str], prefix: str = "cum_",
                      num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """For each row, sums of ``values`` over all rows strictly before it in ``order``."""
    r = df.repartitionByRange(_parts(df, num_partitions), *order).withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_one", F.lit(0))
    r = materialize(r, checkpoint)
    out = running_prior_sums(r, "_one", order, values, "_pid", bucket_us=1, prefix=prefix)
    return out.drop("_one", "_pid")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], group: list[str] | None = None,
                    checkpoint: bool = True) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy 'linear', SQL ``quantile_cont``).

    Equal values are counted first (``groupBy(group, value).count()``, combined on the map side), so
    a value that most rows share is one row; cumulative counts over the distinct values, split at
    range bounds of (group, value), then tell which value holds each order statistic. Neither a
    group nor a value is ever gathered into one task. Output: group columns, ``prob``, ``quantile``.
    """
    group = group or []
    base = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counted = materialize(base.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")), checkpoint)
    cum = global_prior_sums(counted, [*group, "_v"], ["_c"], "_before_", checkpoint=checkpoint)
    cum = cum.withColumnRenamed("_before__c", "_before")
    info = cum.groupBy(*group).agg(F.sum("_c").alias("_n"), F.min("_before").alias("_start")) if group else \
        cum.agg(F.sum("_c").alias("_n"), F.min("_before").alias("_start")).where("_n is not null")
    t = info.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    t = t.select(*group, "prob", "_start", ((F.col("_n") - 1) * F.col("prob")).alias("_h"))
    t = t.select("*", F.floor("_h").cast("bigint").alias("_lo"), F.ceil("_h").cast("bigint").alias("_hi"))
    # one row per group and probability, against the distinct values of its group
    j = F.lit(1).alias("_j")
    values, asked = cum.select(*group, "_v", "_c", "_before", j), materialize(t.select(*group, "prob", "_start", "_lo", "_hi", "_h", j), checkpoint)
    if not group or asked.count() <= 20_000:
        asked = F.broadcast(asked)
    rank = F.col("_before") - F.col("_start")
    near = values.join(asked, [*group, "_j"]).where((rank <= F.col("_hi")) & (rank + F.col("_c") > F.col("_lo")))
    holds = lambda c: (rank <= F.col(c)) & (rank + F.col("_c") > F.col(c))
    piv = near.groupBy(*group, "prob").agg(F.max(F.when(holds("_lo"), F.col("_v"))).alias("_vlo"), F.max(F.when(holds("_hi"), F.col("_v"))).alias("_vhi"),
                                           F.first("_h").alias("_h"), F.first("_lo").alias("_lo"))
    return piv.select(*group, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.col("_lo"))).alias("quantile"))


def top_k(df: DataFrame, score: str, k: int, tie: str = "event_id", slack: int = 4,
          merge_limit: int = 1_000_000, accuracy: int = 100_000) -> DataFrame:
    """Exactly the ``k`` best rows by ``score`` desc, ties by ``tie`` asc, at any input size.

    ``orderBy().limit(k)`` merges (partitions x k) rows in one task. Instead: an approximate
    quantile (a bounded sketch) gives a threshold a few times k from the top; only rows at or
    above it are ranked, with ``limit`` when they are few, else with global positions (hot
    ties at the threshold are still spread over all tasks). Falls back to all rows when the
    sketch overshoots. Scalars (counts, the threshold) are the only things on the driver.
    """
    order = [F.col(score).desc(), F.col(tie).asc()]
    # one pass: the row count and a few upper quantiles from the same sketch
    fracs = [10.0 ** -e for e in range(9, 0, -1)]
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.percentile_approx(score, [1.0 - f for f in fracs], accuracy).alias("q")).collect()[0]
    n = row["n"]
    if n <= max(slack * k, merge_limit):
        return df.orderBy(*order).limit(k)
    # the highest threshold expected to keep at least slack * k rows
    i = next((j for j, f in enumerate(fracs) if f * n >= slack * k), len(fracs) - 1)
    cand = df.where(F.col(score) >= F.lit(row["q"][i]))
    c = cand.count()
    if c < k:
        cand, c = df, n
    if c <= max(slack * k, merge_limit):
        return cand.orderBy(*order).limit(k)
    return with_position(cand, order, "_rk").where(F.col("_rk") < k).drop("_rk")
