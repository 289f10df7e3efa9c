"""Splits and samples. Randomness is a hash order (``md5(id:seed)``) so runs repeat exactly
and any engine can reproduce them; ranks come from global positions, never one partition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import before, cut_rows, top_k, with_position
from ..session import materialize

# fixed values: sampling sizes and ratios
NEG_PER_POS = 50
MIN_NEGATIVES = 50_000
HARD_NEGATIVES = 25_000
RANDOM_NEGATIVES = 150_000
CASE_CONTROL_RATIO = 100
CASE_CONTROL_EMPTY = 5_000
CASE_CONTROL_BLOCK = 1_000_000
SEED = 42

BROADCAST_IDS = 50_000


def hash_order(seed: int = SEED, id_col: str = "event_id"):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def temporal_split(df: DataFrame, train: float = 0.70, val: float = 0.80) -> DataFrame:
    """By time position: first floor(0.70 n) train, up to floor(0.80 n) val, rest test.

    Two cut points of (login_us, event_id) decide; the wide rows are not sorted."""
    order = ["login_us", "event_id"]
    n = df.count()
    a, b = cut_rows(df, order, [math.floor(n * train), math.floor(n * val)])
    return df.select("*", F.when(before(order, a), "train").when(before(order, b), "val").otherwise("test").alias("split"))


def _first_by_hash(df: DataFrame, k: int, seed: int) -> DataFrame:
    """The first ``k`` rows in hash order (ties by id)."""
    x = df.withColumn("_h", hash_order(seed))
    order = ["_h", "event_id"]
    return x.where(before(order, cut_rows(x, order, [k])[0])).drop("_h")


def _rank_within(df: DataFrame, part: str, seed: int) -> DataFrame:
    """0-based rank of each row inside ``part`` by hash order (global positions + group start)."""
    x = df.select("*", hash_order(seed).alias("_h"))
    pos = with_position(x, [part, "_h", "event_id"], "_pos")
    start = pos.groupBy(part).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    return pos.join(start, part).select("*", (F.col("_pos") - F.col("_start")).alias("_rank"))


def balanced_sample(df: DataFrame, label: str = "is_ato", seed: int = SEED,
                    neg_per_pos: int = NEG_PER_POS, min_neg: int = MIN_NEGATIVES) -> DataFrame:
    """All positives plus min(50 pos, neg) hash-ordered negatives (at least min(50 000, neg))."""
    y = F.col(label).cast("bigint")
    c = df.agg(F.coalesce(F.sum(y), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - y), F.lit(0)).alias("q")).first()
    want = max(min(c["p"] * neg_per_pos, c["q"]), min(min_neg, c["q"]))
    return df.where(F.col(label) == 1).unionByName(_first_by_hash(df.where(F.col(label) == 0), want, seed))


def stratified_split(df: DataFrame, label: str = "is_ato", test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Per label, the first floor(0.2 n_label) rows in hash order are 'val', the rest 'train'."""
    x = df.withColumn("_h", hash_order(seed))
    order, val = ["_h", "event_id"], F.lit(False)
    for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per label
        mine = F.col(label).eqNullSafe(F.lit(r[label]))
        cut = cut_rows(x.where(mine), order, [math.floor(r["n"] * test)])[0]
        val = val | (mine & before(order, cut))
    return x.select(*df.columns, F.when(val, "val").otherwise("train").alias("split"))


def without(df: DataFrame, drop: DataFrame, most: int = 50_000) -> DataFrame:
    """``df`` without the event ids of ``drop``; these are broadcast only if at most ``most`` are counted."""
    ids = drop.select("event_id")
    if ids.limit(most + 1).count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, "event_id", "left_anti")


def drop_hard_negatives(df: DataFrame, label: str = "is_ato", hard_col: str = "gf_user_drift_score",
                        n_hard: int = HARD_NEGATIVES) -> DataFrame:
    """The negatives without the ``n_hard`` of them with the highest ``hard_col``."""
    negs = df.where(F.col(label) == 0)
    return without(negs, top_k(negs, hard_col, n_hard))


def hard_negative_sample(df: DataFrame, label: str = "is_ato", hard_col: str = "gf_user_drift_score",
                         n_hard: int = HARD_NEGATIVES, n_random: int = RANDOM_NEGATIVES, seed: int = SEED) -> DataFrame:
    """Positives + the n_hard negatives with the highest ``hard_col`` (only when there are more
    negatives than n_hard) + n_random hash-ordered negatives of the rest. Column ``part`` tells which."""
    df = materialize(df)  # several branches read it
    pos = df.where(F.col(label) == 1).withColumn("part", F.lit("positive"))
    negs = df.where(F.col(label) == 0)
    # bounded: at most n_hard rows (exact top-k)
    hard = top_k(negs, hard_col, n_hard) if negs.count() > n_hard else negs.limit(0)
    hard = materialize(hard)
    rand = _first_by_hash(without(negs, hard), n_random, seed)
    return pos.unionByName(hard.withColumn("part", F.lit("hard"))).unionByName(rand.withColumn("part", F.lit("random")))


def chunked_case_control(df: DataFrame, label: str = "is_ato", block: int = CASE_CONTROL_BLOCK,
                         ratio: int = CASE_CONTROL_RATIO, empty: int = CASE_CONTROL_EMPTY, seed: int = SEED,
                         skip_first: bool = True) -> DataFrame:
    """Per block of ``block`` rows in time order (block 0 skipped): positives + ratio x positives
    negatives, or ``empty`` negatives when the block has none; hash order, without replacement."""
    x = with_position(df.select("login_us", "event_id", label), ["login_us", "event_id"], "_gpos")
    x = x.select("event_id", label, F.floor(F.col("_gpos") / block).cast("bigint").alias("block"))
    if skip_first:
        x = x.where(F.col("block") > 0)
    per = x.groupBy("block").agg(F.sum(F.col(label).cast("bigint")).alias("_bp"))
    negs = _rank_within(x.where(F.col(label) == 0), "block", seed).join(per, "block")
    want = F.when(F.col("_bp") > 0, F.col("_bp") * ratio).otherwise(F.lit(empty))
    chosen = x.where(F.col(label) == 1).select("event_id", "block") \
        .unionByName(negs.where(F.col("_rank") < want).select("event_id", "block"))
    chosen = materialize(chosen)  # ids and blocks only; the wide rows are joined, not sorted
    small = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(chosen) if small else chosen, "event_id").select(*df.columns, "block")
