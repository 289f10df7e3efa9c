"""Exact top-k search by inner product with a three-phase uniform threshold.

The components are cut into ``nodes`` slices, each a row of its own, so that a task of a node holds one slice of
its vectors and never the others. A candidate's score is the sum of one partial score from each node.

1. Every node gathers its local list: the LIST * k best partial scores for each query, and its least
   one. Partial scores count from that least one, so that they are never negative.
2. The lists' candidates, a bounded number for each query, get the partial scores that they lack, and the k-th
   best of their totals is a lower bound of the k-th best of all. A candidate that reaches it has a partial score
   of at least 1 / nodes of it at some node: this uniform threshold goes to all nodes as a safe cutoff, and every
   node returns its entries at or above it.
3. What a returned candidate has at least (the least score where it is unseen) may give a better bound, and what it
   can reach at most (less than the cutoff where it is unseen) is compared with the better of the two. The candidates
   left get the partial scores that they lack from those nodes' slices, and are ranked exactly.

Candidates and queries are dealt in blocks of bounded size, so a task holds one block of each. Of candidates with equal
vectors, which score alike, only the k + 1 with the smallest ids can be among the k best of a query (itself may be
one of them), so the others are left out before the blocks, by a limit that works ahead of the shuffle. Entries of
a query are limited to k ahead of each shuffle, or dealt by query and salt. Ties go to the smaller id. Vectors of
different lengths are not compared.

Defined results: vectors that are null or hold null or non-finite components take no part, neither
do rows without an id; rows that repeat an id are separate queries, and candidates also of each other (a row is never
its own candidate); a query with fewer than k candidates gets all of them; scaled components beyond +-10^14 count
as that; scores are exact whole numbers of any size, ranked as such and shown as the nearest 64-bit number;
empty tables give an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_package

#: Candidates and queries of a block.
CANDIDATES, QUERIES = 4096, 512
NODES = 2
#: Entries of a local list, in multiples of k: they decide how good the bound is, never the result.
LIST = 4
#: Largest scaled component.
LARGEST = 10 ** 14
WIDE = "decimal(38,0)"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, dim): v = floor(scale * x) as longs; only vectors that take part."""
    x = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    most = F.lit(float(LARGEST))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, most), -most)).cast("long"))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v")) \
        .withColumn("dim", F.size("v"))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """The lists of one length as rows."""
    return np.array(col.combine_chunks().flatten(), np.int64).reshape(len(col), -1)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles below 2 ** 53, in longs, or as whole numbers of any size."""
    top = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1) * max(q.shape[1], 1)
    if top < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T if top < 1 << 63 else q.astype(object) @ c.T.astype(object)


def _numbers(values: np.ndarray, wide: bool) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0)) if wide else pa.array(values.astype(np.int64))


def _given(col: pa.ChunkedArray, wide: bool) -> np.ndarray:
    return np.array([int(x) for x in col.to_pylist()], object) if wide else np.asarray(col)


def _node_lists(k: int, wide: bool):
    """Phase 1 at one node in one block pair: for each query, LIST * k local entries and the least partial score."""
    kind = pa.decimal128(38, 0) if wide else pa.int64()
    schema = pa.schema([("q", pa.int64()), ("node", pa.int32()), ("c", pa.int64()), ("s", kind), ("least", kind)])

    def run(cand: pa.Table, ask: pa.Table) -> pa.Table:
        if not cand.num_rows or not ask.num_rows:
            return schema.empty_table()
        qr, cr = np.asarray(ask["rid"]), np.asarray(cand["rid"])
        s = _product(_matrix(ask["v"]), _matrix(cand["v"]))
        s = s.astype(object) if wide else s
        own, far = qr[:, None] == cr[None, :], 1 << (200 if wide else 62)
        least = np.where(own, far, s).min(axis=1)
        t = np.where(own, -far, s)
        n = min(LIST * k, len(cr))
        best = (np.argsort(t, axis=1, kind="stable") if wide else np.argpartition(t, len(cr) - n, axis=1))[:, len(cr) - n:]
        i, j = np.repeat(np.arange(len(qr)), n), best.ravel()
        i, j = i[~own[i, j]], j[~own[i, j]]
        return pa.Table.from_arrays([pa.array(qr[i]), pa.array(np.full(len(i), ask["node"][0].as_py()), pa.int32()), pa.array(cr[j]),
                                     _numbers(s[i, j], wide), _numbers(least[i], wide)], schema=schema)
    return run


def _sufficient(wide: bool):
    """Phase 2 at one node in one block pair: the entries at or above the cutoff."""
    kind = pa.decimal128(38, 0) if wide else pa.int64()
    schema = pa.schema([("q", pa.int64()), ("node", pa.int32()), ("c", pa.int64()), ("id", pa.int64()),
                        ("s", kind), ("above_least", kind), ("above_cut", kind)])

    def run(cand: pa.Table, ask: pa.Table) -> pa.Table:
        if not cand.num_rows or not ask.num_rows:
            return schema.empty_table()
        qr, cr = np.asarray(ask["rid"]), np.asarray(cand["rid"])
        cut, least = _given(ask["cut"], wide), _given(ask["least"], wide)
        s = _product(_matrix(ask["v"]), _matrix(cand["v"]))
        i, j = np.nonzero((s >= cut[:, None]) & (qr[:, None] != cr[None, :]))
        t = s[i, j]
        return pa.Table.from_arrays([
            pa.array(qr[i]), pa.array(np.full(len(i), ask["node"][0].as_py()), pa.int32()), pa.array(cr[j]), cand["id"].take(pa.array(j)),
            _numbers(t, wide), _numbers(t - least[i], wide), _numbers(t - cut[i], wide)], schema=schema)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, nodes: int = NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row that ``is_query`` (of ``id``) marks."""
    ship_package(vectors.sparkSession)
    rows = materialize(quantised(vectors, id_col, vec_col, scale).withColumn("rid", F.monotonically_increasing_id()))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("nq"), F.max("dim").alias("dim"),
                    F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    cb, qb = max(1, -(-size["n"] // CANDIDATES)), max(1, -(-size["nq"] // QUERIES))
    # sums and differences of two scores in longs, or in decimals
    wide = (size["dim"] or 0) * (size["top"] or 0) ** 2 >= 1 << 61
    kind = WIDE if wide else "long"
    asked = rows.where(is_query)

    # a row for each node: its slice of the vector
    start = lambda node: F.floor(node * F.col("dim") / nodes).cast("int")
    part = F.slice("v", start(F.col("node")) + 1, start(F.col("node") + 1) - start(F.col("node")))

    def slices(df: DataFrame) -> DataFrame:
        return df.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)))).select("dim", "node", "rid", "id", part.alias("v"))

    deal = lambda b, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(b)).cast("int")
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id", "rid"))
    unlike = materialize(rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy"))
    at = ["dim", "node", "qb", "cb"]
    cand = slices(unlike).withColumn("cb", deal(cb, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    ask = slices(asked).withColumn("qb", deal(qb, 2))
    to_all = F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))

    # 1. local lists
    lists = materialize(cand.groupBy(*at).cogroup(ask.withColumn("cb", to_all).groupBy(*at)).applyInArrow(
        _node_lists(k, wide), f"q long, node int, c long, s {kind}, least {kind}"))
    least = lists.groupBy("q", "node").agg(F.min("least").alias("least"))
    # the partial scores that pairs (q, c, s, nodes seen as bits) lack
    number = lambda x: x.cast(kind)
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: (number(a) * b).cast(kind)), F.lit(0).cast(kind), lambda a, b: (a + b).cast(kind))
    bit = F.sum(F.expr("shiftleft(1L, node)")).alias("at")

    def resolved(pairs: DataFrame) -> DataFrame:
        unseen = F.filter(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda n: F.call_function("getbit", F.col("at"), n) == 0)
        more = pairs.select("q", "c", F.explode(unseen).alias("node")) \
            .join(slices(unlike).select(F.col("rid").alias("c"), "node", "v"), ["c", "node"]) \
            .join(slices(asked).select(F.col("rid").alias("q"), "node", F.col("v").alias("w")), ["q", "node"]) \
            .groupBy("q", "c").agg(F.sum(dot).alias("more"))
        return pairs.join(more, ["q", "c"], "left").withColumn("score", F.col("s") + F.coalesce("more", F.lit(0)))

    # 2. bound, cutoff, sufficient entries
    place = F.row_number().over(Window.partitionBy("q", "node").orderBy(F.desc("s"), "c"))
    local = lists.select("q", "node", "c", "s").withColumn("place", place).where(F.col("place") <= LIST * k)
    local = materialize(local.groupBy("q", "c").agg(F.sum("s").alias("s"), bit))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    bound = resolved(local).select("q", "c", "score").withColumn("place", place).where(F.col("place") == k) \
        .select("q", F.col("score").alias("bound"))
    total = least.groupBy("q").agg(F.sum("least").alias("from")).join(bound, "q", "left")
    above = F.greatest(F.coalesce(F.col("bound") - F.col("from"), F.lit(0)), F.lit(0))
    share = F.floor(above / nodes) if wide else F.call_function("div", above, F.lit(nodes))
    cut = materialize(least.join(total, "q").select(F.col("q").alias("rid"), "node", "least", "bound",
                                                    (F.col("least") + share).cast(kind).alias("cut")))
    ask = ask.join(cut.select("rid", "node", "least", "cut"), ["rid", "node"]).withColumn("cb", to_all)
    entries = cand.groupBy(*at).cogroup(ask.groupBy(*at)).applyInArrow(
        _sufficient(wide), f"q long, node int, c long, id long, s {kind}, above_least {kind}, above_cut {kind}")
    seen = materialize(entries.groupBy("q", "c").agg(
        F.first("id").alias("id"), F.sum("s").alias("s"), F.sum("above_least").alias("low"),
        F.sum(F.col("above_cut") + 1).alias("high"), bit))
    # 3. the better bound; the rest exactly. low counts from all least scores, high from all cutoffs less one
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "c"))
    floor = seen.select("q", "c", "low").withColumn("place", place).where(F.col("place") == k).select("q", "low")
    sums = cut.groupBy(F.col("rid").alias("q")).agg(F.sum("least").alias("from"), F.sum(F.col("cut") - 1).alias("to"),
                                                    F.first("bound").alias("bound"))
    floor = sums.join(floor, "q", "left").select("q", (F.greatest(F.col("low") + F.col("from"), "bound") - F.col("to")).alias("floor"),
                                                 F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("salt"))
    left = seen.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(cb)).cast("int")).join(floor, ["q", "salt"], "left") \
        .where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    scored = resolved(materialize(left.select("q", "c", "id", "s", "at")))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "c"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= k)
    shown = F.least(F.greatest("score", F.lit(-(1 << 63)).cast(WIDE)), F.lit((1 << 63) - 1).cast(WIDE)) if wide else F.col("score")
    return best.join(asked.select(F.col("rid").alias("q"), F.col("id").alias("query_id")), "q").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), shown.cast("long").alias("score"))
