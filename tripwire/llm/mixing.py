"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Targets. Sources, in code point order (null last), take the weights in turn and share
   ``share`` of all words; a target stops at ``most`` times its source's words and the excess is
   shared again by weight until none is above. A round is one aggregate row.
2. Blocks. A source's documents are dealt by a hash of id and text into permuted blocks of about
   ``block_words`` words (at most MAX_BLOCKS in all, so that block tables stay bounded however
   large the corpus). A target is some whole passes over the source and a rest; the rest draws
   blocks 0, 1, ... of the permutation, then part of the next block in hash order. What is still missing
   is filled from the rest of the source, passing over documents larger than the gap, in at most
   MAX_ROUNDS rounds until a thousandth of the target is missing, and last the untaken document that
   fits best. Where none fits before, the smallest is taken and the last drawn ones that its
   excess holds are left out, if that comes nearer to the target.
3. Shards. The drawn blocks are quotas (source, blocks). Each node of a binary tree keeps a random
   half of its blocks on the left, which is a multivariate hypergeometric draw of the left
   quotas; the leaves are the output shards. Blocks of a shard are disjoint from those of others.
4. Rows are shuffled inside their shard by a hash.

A document is taken whole, at most ``most`` times. Everything follows from hashes of the rows, so
reruns agree whatever the partitions.

Defined results: a null source is a source of its own; null or blank texts have size 0 and take
part without weight; repeated rows share one place in the permutation and are taken
together; null ids are told apart by their text; an empty table gives an empty mix. Other columns
of the input pass through (names that begin with two underscores are reserved).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import with_position
from .common import bounded_broadcast, materialize, words_of

WEIGHTS = (5, 2, 1)
SHARE_PCT = 150
MOST = 2
#: Words of a block, unless MAX_BLOCKS would not hold the corpus.
BLOCK_WORDS = 20_000
MAX_BLOCKS = 1 << 20
#: Rounds that fill a gap, at most.
MAX_ROUNDS = 16
#: A node of the splitting tree is ranked in 2 ** RANK_BITS parts.
RANK_BITS = 8


def _key(source: Column) -> Column:
    """A join key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source))


def targets(sources: DataFrame, weights=WEIGHTS, share_pct: int = SHARE_PCT, most: int = MOST) -> DataFrame:
    """(skey, words, weight, target) for a table (skey, words) of one row per source."""
    ranked = with_position(sources, [F.col("skey")], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = materialize(ranked.select("skey", "words", w.alias("weight")))
    total = t.agg(F.sum("words").alias("w")).first()["w"] or 0
    goal, level = total * share_pct / 100, 0.0
    full, capped = F.lit(False), None
    while True:
        r = t.where(~full).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
        spent = t.where(full).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
        if spent["n"] == capped or not r["n"]:
            break
        capped = spent["n"]
        level = (goal - most * spent["s"]) / r["w"]
        full = F.col("weight") * level >= F.col("words") * most
    return t.select("skey", "words", "weight", F.when(full, (F.col("words") * most).cast("double"))
                    .otherwise(F.col("weight") * level).alias("target"))


@dataclass
class Mix:
    """A plan: ``sources`` holds one row per source with all that decides a document's copies."""
    sources: DataFrame
    text_col: str
    id_col: str
    source_col: str
    most: int
    block_words: int

    def sized(self, docs: DataFrame) -> DataFrame:
        return docs.select("*", *_row_keys(docs, self.id_col, self.text_col, self.source_col))

    def decide(self, sized: DataFrame) -> DataFrame:
        """Adds ``__words, __target, __blk, __copies`` to rows that hold the row keys (see sized)."""
        s = self.sources
        small, _ = bounded_broadcast(s.select(*[F.col(c).alias(f"__s_{c}") for c in s.columns]))
        j = sized.join(small, F.col("__skey") == F.col("__s_skey"))
        blk = _block(F.col("__h"), F.col("__s_blocks"))
        extra = ((_in(F.col("__h"), F.col("__size"), F.col("__s_fill")) & ~_in(F.bitwise_not("__h"), F.col("__size"), F.col("__s_drop")))
                 | (F.col("__h") == F.col("__s_pick_h")))
        return j.select(*_all(sized), F.col("__s_words").alias("__words"), F.col("__s_target").alias("__target"),
                        blk.alias("__blk"), (F.col("__s_passes") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0))
                        .cast("int").alias("__copies"))


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _row_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [words_of(docs[text_col]).alias("__size"), _key(docs[source_col].cast("string")).alias("__skey"),
            F.xxhash64(docs[id_col], docs[text_col], F.lit(8)).alias("__h")]


def _block(h: Column, blocks: Column) -> Column:
    """The block of a hash: equal parts of the hash range, in order (the hash is the permutation)."""
    return F.floor((h.cast("double") / float(1 << 64) + 0.5) * blocks).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, share_pct: int = SHARE_PCT, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[Mix, DataFrame]:
    """The mix of a table, and its narrow rows (id, __size, __skey, __h), written once."""
    rows = materialize(docs.select(F.col(id_col), *_row_keys(docs, id_col, text_col, source_col)))
    src = rows.groupBy(F.col("__skey").alias("skey")).agg(F.sum("__size").alias("words"))
    src = targets(materialize(src), weights, share_pct, most)
    total = src.agg(F.sum("words").alias("w")).first()["w"] or 0
    per = max(block_words, -(-total // MAX_BLOCKS))
    src = src.withColumn("goal", F.least(F.round("target").cast("long"), F.col("words") * most))
    src = src.withColumn("passes", F.when(F.col("words") > 0, F.expr("goal div words")).otherwise(0).cast("int"))
    src = src.withColumn("rest", F.col("goal") - F.col("passes") * F.col("words"))
    src = materialize(src.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(per))).cast("long")))

    # equal hashes (repeated rows) are one unit
    units = rows.where("__size > 0").groupBy(F.col("__skey").alias("skey"), F.col("__h").alias("h")).agg(
        F.sum("__size").alias("size"), F.max("__size").alias("row"))
    small, _ = bounded_broadcast(src.where("rest > 0").select("skey", "blocks"))
    units = materialize(units.join(small, "skey").withColumn("blk", _block(F.col("h"), F.col("blocks"))))
    least = F.expr("goal div 1000").alias("least")
    fill = _fill(units, src.where("rest > 0").select("skey", F.col("rest").alias("gap"), least))

    # the document that fits best; where none fits, one too many, and taken units left out for its excess
    short, _ = bounded_broadcast(fill.where("gap > 0"))
    at = units.join(short, "skey")
    taken = _in(F.col("h"), F.col("row"), F.struct("rules", "skip", "one"))
    miss = F.abs(F.col("gap") - F.col("size"))
    near = F.when(F.col("gap") <= F.col("least"), F.when(miss < F.col("gap"), miss)).otherwise(F.when(F.col("size") > F.col("gap"), F.col("size")))
    over = materialize(at.where(~taken).withColumn("near", near).where("near is not null").groupBy("skey")
                       .agg(F.min(F.struct("near", "size", "h")).alias("p"), F.first("gap").alias("short"), F.first("least").alias("least"))
                       .select("skey", "short", F.col("p.h").alias("pick_h"), (F.col("p.size") - F.col("short")).alias("gap"), "least"))
    few, _ = bounded_broadcast(over.where("gap > least").select("skey"))
    # last drawn, first left out: the permutation backwards
    held = at.where(taken).join(few, "skey").select("skey", "size", "row", "blocks", F.bitwise_not("h").alias("h"))
    drop = _fill(held.withColumn("blk", _block(F.col("h"), F.col("blocks"))), over.select("skey", "gap", "least"))
    drop = drop.drop("least").join(over.select("skey", "short", "pick_h"), "skey").where("abs(gap) < short")

    rules = lambda t, name: t.select("skey", F.struct("rules", "skip", "one").alias(name))
    src = (src.join(rules(fill, "fill"), "skey", "left").join(rules(drop, "drop"), "skey", "left")
           .join(drop.select("skey", "pick_h"), "skey", "left"))
    mix = Mix(materialize(src.select("skey", "words", "weight", "target", "passes", "blocks", "fill", "drop", "pick_h")),
              text_col, id_col, source_col, most, per)
    return mix, rows


def _in(h: Column, row: Column, f: Column) -> Column:
    """Whether ``f`` (of _fill) takes the rows of size ``row`` and hash ``h``; false for a null ``f``."""
    by = F.exists(f["rules"], lambda r: (row <= r["upto"]) & (h <= r["cut"])) & ~F.array_contains(f["skip"], h)
    return F.coalesce(by, F.lit(False)) | F.coalesce(h == f["one"], F.lit(False))


def _fill(units: DataFrame, gaps: DataFrame) -> DataFrame:
    """Fill each source's gap (skey, gap, least) by its units (skey, h, blk, size, row): (skey, gap, least, rules, skip, one).

    A round passes over the units larger than the gap and draws the others in hash order up to the first that
    exceeds it, until at most ``least`` is missing; a unit that fits the gap exactly ends a source at once. A unit
    is taken if a rule (upto, cut) holds its row size and hash, or it is ``one``. Rules know the size of a row only:
    repeated rows that are too large together are passed over by ``skip``, one a round.
    ``gap`` is what is missing after the last round.
    """
    none = [F.array().cast("array<struct<upto:bigint,cut:bigint>>").alias("rules"), F.array().cast("array<bigint>").alias("skip"),
            F.lit(None).cast("long").alias("one")]
    state, free = materialize(gaps.select("skey", "gap", "least", *none)), units
    for _ in range(MAX_ROUNDS):
        few, _ = bounded_broadcast(state.where("gap > least"))
        open_ = (F.col("row") <= F.col("gap")) & ~F.array_contains("skip", F.col("h"))
        free = free.select("skey", "h", "blk", "size", "row").join(few, "skey")
        free = materialize(free.where(open_ & ~_in(F.col("h"), F.col("row"), F.struct("rules", "skip", "one")))
                           .select("skey", "h", "blk", "size", "row", "gap"))
        if not free.head(1):
            break
        block = free.groupBy("skey", "blk").agg(F.sum("size").alias("size"), F.max("h").alias("last"), F.first("gap").alias("gap"),
                                                F.min(F.when(F.col("size") == F.col("gap"), F.col("h"))).alias("fits"))
        # at most MAX_BLOCKS narrow rows in all, besides one for each source
        done = F.sum("size").over(Window.partitionBy("skey").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0))
        border = materialize(block.withColumn("done", done).groupBy("skey").agg(
            F.min(F.when(F.col("done") > F.col("gap"), F.col("blk"))).alias("border"), F.min("fits").alias("fits"),
            F.max(F.when(F.col("done") <= F.col("gap"), F.struct("done", "last"))).alias("full")))
        few, _ = bounded_broadcast(border.select("skey", "border", F.coalesce("full.done", F.lit(0)).alias("before")))
        inside = free.join(few, "skey").where("blk = border")  # one block of each source
        run = F.sum("size").over(Window.partitionBy("skey").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
        inside = inside.withColumn("run", run).groupBy("skey").agg(
            F.max(F.when(F.col("run") <= F.col("gap"), F.struct("run", "h"))).alias("cut"),
            F.min(F.when(F.col("run") > F.col("gap"), F.struct("h", "row"))).alias("stop"))
        drawn = border.join(inside, "skey", "left").select(
            "skey", "fits", F.coalesce("cut.run", "full.done", F.lit(0)).alias("got"), F.coalesce("cut.h", "full.last").alias("cut"), "stop")
        fits = F.col("fits").isNotNull()
        rule = F.array(F.struct(F.col("gap").alias("upto"), "cut"))
        new = state.join(drawn, "skey", "left").withColumn("left", F.when(fits, 0).otherwise(F.col("gap") - F.coalesce("got", F.lit(0))))
        state = materialize(new.select(
            "skey", F.col("left").cast("long").alias("gap"), "least",
            F.when(fits | F.col("cut").isNull(), F.col("rules")).otherwise(F.concat("rules", rule)).alias("rules"),
            F.when(~fits & (F.col("stop.row") <= F.col("left")), F.concat("skip", F.array("stop.h"))).otherwise(F.col("skip")).alias("skip"),
            F.coalesce("fits", "one").alias("one")))
    return state


def shards(mix: Mix, decided: DataFrame, n: int) -> DataFrame:
    """(skey, blk, copy, shard): the splitting tree over the drawn blocks of ``decided`` rows.

    A block table of at most ``most`` * (MAX_BLOCKS + sources) narrow rows; a level of the tree ranks the
    blocks of each node by a fresh hash and sends the first half (by share of the shards) to the left, so that the
    number of each source's blocks there is a multivariate hypergeometric draw. A node is ranked in 2 ** RANK_BITS parts of the
    hash's range, each counting on from the parts before it.
    """
    drawn = (decided.where("__copies > 0").select("__skey", "__blk", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))
             .groupBy(F.col("__skey").alias("skey"), F.col("__blk").alias("blk"), "copy").agg(F.count(F.lit(1)).alias("docs")))
    node = materialize(drawn.select("skey", "blk", "copy", F.lit(0).alias("lo"), F.lit(n).alias("hi")))
    level = 0
    while (1 << level) < n:
        h = F.xxhash64("skey", "blk", "copy", F.lit(100 + level))
        node = node.withColumn("h", h).withColumn("part", F.shiftright("h", 64 - RANK_BITS))
        parts = node.groupBy("lo", "hi", "part").agg(F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy("lo", "hi")
        parts = parts.select("lo", "hi", "part", F.sum("n").over(whole).alias("all"),
                             (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"))
        inside = F.row_number().over(Window.partitionBy("lo", "hi", "part").orderBy("h", "skey", "blk", "copy"))
        t = node.withColumn("inside", inside).join(parts, ["lo", "hi", "part"]).withColumn("mid", F.expr("(lo + hi) div 2").cast("int"))
        rank = F.col("before") + F.col("inside")
        left = rank <= F.round(F.col("all") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        one = F.col("hi") - F.col("lo") <= 1
        node = t.select("skey", "blk", "copy", F.when(one | left, F.col("lo")).otherwise(F.col("mid")).alias("lo"),
                        F.when(one | ~left, F.col("hi")).otherwise(F.col("mid")).alias("hi"))
        level += 1
    return node.select("skey", "blk", "copy", F.col("lo").alias("shard"))


def taken(mix: Mix, decided: DataFrame, n: int) -> DataFrame:
    """``decided`` rows with ``__shards``: where the tree puts each copy, in order; empty for a document not taken."""
    tree = shards(mix, decided, n).groupBy(F.col("skey").alias("__t_skey"), F.col("blk").alias("__t_blk")).agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("__placed"))  # at most ``most`` a block
    tree, _ = bounded_broadcast(materialize(tree))
    out = decided.join(tree, (F.col("__skey") == F.col("__t_skey")) & (F.col("__blk") == F.col("__t_blk")), "left")
    own = F.filter(F.coalesce("__placed", F.array().cast("array<struct<copy:int,shard:int>>")), lambda p: p["copy"] <= F.col("__copies"))
    return out.select(*_all(decided), own["shard"].alias("__shards"))


def mixed(docs: DataFrame, n_shards: int = 8, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for every copy taken, dealt to ``n_shards`` ranges of
    partitions and shuffled inside each."""
    mix, rows = plan(docs, **options)
    tree = shards(mix, mix.decide(rows), n_shards)
    tree, _ = bounded_broadcast(materialize(tree.select(
        F.col("skey").alias("__t_skey"), F.col("blk").alias("__t_blk"), F.col("copy").alias("__t_copy"), F.col("shard").alias("__t_shard"))))
    taken = (mix.decide(mix.sized(docs)).where("__copies > 0")
             .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))
    taken = taken.join(tree, (F.col("__skey") == F.col("__t_skey")) & (F.col("__blk") == F.col("__t_blk"))
                       & (F.col("__copy") == F.col("__t_copy")))
    out = taken.select(*_all(docs), "__t_shard", F.xxhash64("__h", "__copy", F.lit(9)).alias("__order"))
    return (out.repartitionByRange(F.col("__t_shard"), F.col("__order")).sortWithinPartitions("__t_shard", "__order")
            .select(*_all(docs)))
