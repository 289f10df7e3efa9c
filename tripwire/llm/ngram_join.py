"""N-gram Jaccard join by grouped prefixes.

1. Every text becomes its set of distinct n-word shingles (64-bit hashes). Texts with equal
   sets are one *class*.
2. Shingles have one global order, rare before frequent: frequency is read from a histogram
   of hash slots that is counted over all documents, with a bounded number of slots; ties by
   the hash. Any fixed order is exact, the histogram only makes it selective.
3. The prefix of a set of size s is its first ``s - ceil(t * s) + 1`` shingles. Two sets with
   Jaccard >= t share a prefix shingle. Classes of equal size and prefix form a *group* (of
   bounded membership: larger ones are dealt out by hash, and meet again through shingles).
4. Group pairs that share a prefix shingle pass a size filter and a count filter: with c common
   prefix shingles the overlap is at most ``c + max(size - prefix length)``.
5. Surviving pairs expand to members, which are verified on their whole texts.

A shingle that stands in many prefixes (copies with scattered edits) never emits its pairs:
its groups are dealt to blocks of bounded size, block pairs that share such a shingle go to a
task each, and the task returns a spanning forest of the links it verified, so that what is
written grows with the members. Links feed :func:`components`.

Defined results: null or blank texts have an empty set, are linked with nothing and keep their
own id; a null id takes part but never names a component (its component id is null unless a
linked row has an id); repeated rows are copies and each keeps its row; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, give_back, materialize, ship_package
from .components import Forest, components
from .texthash import mix, shingle_sets, slices

#: A shingle in the prefixes of more groups than this is handled in blocks instead of pairs;
#: also the members of a group.
PAIR_LIMIT = 32
#: Documents of a block.
BLOCK = 384
#: Bounds of the histogram's slots (a power of two, about four to a document between them).
MIN_BITS, MAX_BITS = 16, 24
_CHUNK = 1 << 12
#: Shingles of a block that are compared at once.
_COLUMNS = 1 << 10


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def shingle_histogram(docs: DataFrame, text: str, n: int, bits: int) -> np.ndarray:
    """In how many documents a shingle of each hash slot occurs; 2 ** bits counts, over all documents."""
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for s in slices(b.column(0)):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(s, n)
                total += np.bincount(_slot(np.concatenate(sets), bits), minlength=1 << bits)
        pid = TaskContext.get().partitionId()
        k = len(total) // _CHUNK
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(np.arange(k, dtype=np.int32)), "part": pa.array(np.full(k, pid, np.int32)),
            "counts": pa.array([x.astype(np.uint32).tobytes() for x in total.reshape(k, -1)], pa.binary())})
        del total
        give_back()

    def add(p: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros(_CHUNK, np.uint64)
        for x in p["counts"]:
            t += np.frombuffer(x, np.uint32)
        return pd.DataFrame({"chunk": p["chunk"].iloc[:1], "part": p["part"].iloc[:1],
                             "counts": [np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes()]})

    schema = "chunk int, part int, counts binary"
    parts = docs.select(F.col(text)).mapInArrow(count, schema)
    # two levels, so that no task adds up the chunks of all tasks
    first = parts.withColumn("part", F.shiftright("part", 7)).groupBy("chunk", "part").applyInPandas(add, schema)
    rows = first.groupBy("chunk").applyInPandas(add, schema).select("chunk", "counts").collect()  # 4 bytes a slot
    out = np.zeros(1 << bits, np.uint32)
    for r in rows:
        out[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.uint32)
    return out


def prefix_length(size: int, pct: int) -> int:
    return size - -(-size * pct // 100) + 1


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def _signatures(docs: DataFrame, n: int, pct: int, hist: np.ndarray, bits: int) -> DataFrame:
    """id, key of the text, set size, 128-bit digest of the set, digest of the prefix, prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(hist)  # at most 2 ** MAX_BITS counts

    def sign(b: pa.RecordBatch):
        counts = shared.value
        size, d1, d2, pd_, prefix, ends = [], [], [], [], [], [0]
        with np.errstate(over="ignore"):
            for s in slices(b.column(2)):
                for x in shingle_sets(s, n):
                    size.append(len(x))
                    p = prefix_length(len(x), pct) if len(x) else 0
                    first = x[np.lexsort((x, counts[_slot(x, bits)]))[:p]]
                    m = mix(x ^ np.uint64(0x5851F42D4C957F2D))
                    d1.append(_signed(m.sum() if len(x) else 0))
                    d2.append(_signed(mix(m).sum() if len(x) else 0))
                    pd_.append(_signed(mix(first).sum() if p else 0))
                    prefix.append(first.view(np.int64))
                    ends.append(ends[-1] + p)
        flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
             pa.array(pd_, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["id", "tk", "size", "d1", "d2", "pd", "prefix"])

    return arrow_map(docs, sign, "id long, tk long, size int, d1 long, d2 long, pd long, prefix array<long>")


def _links_of(sets: list[np.ndarray], pairs, pct: int, forest: Forest, ids: list[int]) -> None:
    """Join in ``forest`` the pairs (positions) whose sets reach the threshold; connected pairs need no check."""
    for i, j in pairs:
        if forest.root(ids[i]) != forest.root(ids[j]):
            a, b = sets[i], sets[j]
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= pct * (len(a) + len(b) - common):
                forest.join(ids[i], ids[j])


def _sets(texts, n: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [x for s in slices(pa.array(texts, pa.large_string())) for x in shingle_sets(s, n)]


def _verify(n: int, pct: int):
    def run(parts):
        last: tuple[int, np.ndarray] | None = None
        for p in parts:
            u, v = [], []
            right = _sets(p["tb"], n)
            for a, b, ta, y in zip(p["a"].tolist(), p["b"].tolist(), p["ta"], right, strict=True):
                if last is None or last[0] != a:
                    last = (a, _sets([ta], n)[0])
                common = len(np.intersect1d(last[1], y, assume_unique=True))
                if 100 * common >= pct * (len(last[1]) + len(y) - common):
                    u.append(a)
                    v.append(b)
            yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})
        give_back()
    return run


def _common(prefixes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that each prefix at ``i`` has in common with each at ``j``. Only shingles of several prefixes are looked at,
    ``_COLUMNS`` at a time, so that the tables stay small however different the texts are."""
    _, at, n = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
    several = n[at] > 1
    row, at = row[several], (np.cumsum(n > 1) - 1)[at[several]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    c = np.zeros((len(i), len(j)), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        lo, hi = np.searchsorted(at, [first, first + _COLUMNS])
        has = np.zeros((len(prefixes), _COLUMNS), np.float32)
        has[row[lo:hi], at[lo:hi] - first] = 1
        c += has[i] @ has[j].T
    return c


def _block_links(n: int, pct: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        ids, size = p["gid"].tolist(), p["size"].to_numpy(np.int64)
        same, left = p["b1"].iloc[0] == p["b2"].iloc[0], (p["blk"] == p["b1"]).to_numpy()
        pre = [np.asarray(x, np.int64) for x in p["prefix"]]
        length = np.array([len(x) for x in pre], np.int64)
        i, j = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        c = _common(pre, i, j)
        si, sj = size[i][:, None], size[j][None, :]
        need = -(-pct * (si + sj) // (100 + pct)) - np.maximum((size - length)[i][:, None], (size - length)[j][None, :])
        ok = (c >= np.maximum(need, 1)) & (100 * np.minimum(si, sj) >= pct * np.maximum(si, sj))
        if same:
            ok = np.triu(ok, 1)
        r, s = np.nonzero(ok)
        best = np.argsort(need[r, s] - c[r, s], kind="stable")  # likely links first: they spare later checks
        forest = Forest()
        _links_of(_sets(p["text"], n), zip(i[r[best]].tolist(), j[s[best]].tolist(), strict=True), pct, forest, ids)
        u, v = forest.links()
        return pd.DataFrame({"u": u, "v": v})
    return run


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                     threshold_pct: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): each row's class, each class, and links between classes.

    rows: id, tk (hash of the text), size, gid (null for an empty set); classes: gid, size, min_id,
    rep (its first row by id, null last); links: u, v, a
    subset of the pairs at or above the threshold with the same connected components.
    """
    n, pct = words, threshold_pct
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tk"),
                       F.col(text_col).cast("string").alias("text"))
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(4 * docs.count() + 1))))
    signed = materialize(_signatures(docs, n, pct, shingle_histogram(docs, "text", n, bits), bits))

    classes = (signed.where("size > 0").groupBy("size", "d1", "d2")
               .agg(F.min(F.struct(F.col("id").isNull().alias("noid"), "id", "tk")).alias("rep"), F.min("id").alias("min_id"),
                    F.first("pd").alias("pd"), F.first("prefix").alias("prefix")))
    classes = materialize(classes.withColumn("gid", F.monotonically_increasing_id()))
    rows = signed.select("id", "tk", "size", "d1", "d2").join(
        classes.select("size", "d1", "d2", "gid"), ["size", "d1", "d2"], "left").select("id", "tk", "size", "gid")

    # groups: equal size and prefix, at most about PAIR_LIMIT classes each
    narrow = classes.select("gid", "size", "pd")
    shared = narrow.groupBy("size", "pd").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = narrow.join(shared, ["size", "pd"]).withColumn(
        "salt", F.pmod(F.xxhash64("gid"), F.ceil(F.col("m") / F.lit(PAIR_LIMIT))))
    groups = dealt.groupBy("size", "pd", "salt").agg(F.min("gid").alias("qid"))
    member = materialize(dealt.join(groups, ["size", "pd", "salt"]).select("gid", "qid"))  # of groups of several
    others = member.where("gid <> qid").select("gid")

    tokens = (classes.select("gid", "size", "prefix").join(others, "gid", "left_anti")
              .select(F.col("gid").alias("qid"), "size", F.size("prefix").alias("p"), F.explode("prefix").alias("token")))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # only shingles that stand in two prefixes or more
    tokens = materialize(tokens.join(often, "token"))

    # shingles in many prefixes: blocks
    hot = tokens.where(F.col("k") > PAIR_LIMIT)
    hot_docs = hot.groupBy("qid").agg(F.count(F.lit(1)).alias("hot"), F.first("size").alias("size"),
                                      F.max(F.struct("k", "token")).alias("anchor"))
    hot_docs = materialize(hot_docs.select(
        "qid", "hot", "anchor.token", F.floor(F.log(F.col("size")) / -math.log(pct / 100)).cast("int").alias("band")))

    # the others: pairs, counted by common prefix shingles
    few = tokens.where(F.col("k") <= PAIR_LIMIT).select("token", "qid", "size", "p")
    a, b = (few.select("token", *(F.col(c).alias(f"{c}{x}") for c in ("qid", "size", "p"))) for x in "ab")
    near = (a.join(b, "token").where(F.col("qida") < F.col("qidb"))
            .where(100 * F.least("sizea", "sizeb") >= pct * F.greatest("sizea", "sizeb")))
    near = near.groupBy("qida", "qidb").agg(F.count(F.lit(1)).alias("c"), *(F.first(x).alias(x) for x in ("sizea", "sizeb", "pa", "pb")))
    need = F.ceil(pct * (F.col("sizea") + F.col("sizeb")) / (100 + pct)) - F.greatest(
        F.col("sizea") - F.col("pa"), F.col("sizeb") - F.col("pb"))
    heat = hot_docs.select("qid", "hot")
    near = (near.where(F.col("c") < need)  # pairs may share frequent shingles besides: at most those both have
            .join(heat.select(F.col("qid").alias("qida"), F.col("hot").alias("ha")), "qida")
            .join(heat.select(F.col("qid").alias("qidb"), F.col("hot").alias("hb")), "qidb")
            .where(F.col("c") + F.least("ha", "hb") >= need).select("qida", "qidb")
            .unionByName(near.where(F.col("c") >= need).select("qida", "qidb")))

    # expand to members: the group's first class stands in no row of ``member`` if it is alone
    def expand(df: DataFrame, q: str, g: str) -> DataFrame:
        m = member.select(F.col("qid").alias(q), F.col("gid").alias(g))
        return df.join(m, q, "left").withColumn(g, F.coalesce(g, q)).drop(q)
    across = expand(expand(near, "qida", "a"), "qidb", "b").select("a", "b")
    within = (member.select("qid", F.col("gid").alias("a")).join(member.select("qid", F.col("gid").alias("b")), "qid")
              .where("a < b").select("a", "b"))
    pairs = materialize(across.unionByName(within))

    # whole texts of the classes to verify
    hot_classes = expand(hot_docs.select(F.col("qid").alias("q"), "token", "band"), "q", "gid")
    wanted = (pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid")))
              .unionByName(hot_classes.select("gid")).distinct())
    wanted = classes.select("gid", "rep.id", "rep.tk").join(wanted, "gid")
    texts = (docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["tk"] == wanted["tk"]))
             .select("gid", "text").groupBy("gid").agg(F.first("text").alias("text")))  # repeated rows
    texts = materialize(texts)

    checked = (pairs.join(texts.select(F.col("gid").alias("b"), F.col("text").alias("tb")), "b")
               .join(texts.select(F.col("gid").alias("a"), F.col("text").alias("ta")), "a")
               .select("a", "b", "ta", "tb").mapInPandas(_verify(n, pct), "u long, v long"))

    # blocks: by the most frequent shingle and the size band, at most about BLOCK classes each
    many = hot_classes.groupBy("token", "band").agg(F.count(F.lit(1)).alias("m"))
    blocks = hot_classes.join(many, ["token", "band"]).withColumn("blk", F.xxhash64(
        "token", "band", F.pmod(F.xxhash64("gid"), F.ceil(F.col("m") / F.lit(BLOCK)))))
    blocks = materialize(blocks.select("gid", "blk", "band"))
    stands = (hot.select("token", F.col("qid").alias("gid")).join(blocks, "gid").select("token", "blk", "band").distinct())
    # all classes of a group stand in the prefixes of its first one
    more = (hot.select("token", "qid").join(member.where("gid <> qid"), "qid").join(blocks, "gid")
            .select("token", "blk", "band").distinct())
    stands = stands.unionByName(more).distinct()
    one, two = (stands.select("token", F.col("blk").alias(f"b{x}"), F.col("band").alias(f"n{x}")) for x in "12")
    meets = (one.join(two, "token").where((F.col("b1") <= F.col("b2")) & (F.abs(F.col("n1") - F.col("n2")) <= 1))
             .select("b1", "b2").distinct())
    held = (blocks.select("gid", "blk").join(classes.select("gid", "size", "prefix"), "gid").join(texts, "gid"))
    sides = (meets.select("b1", "b2", F.col("b1").alias("blk"))
             .unionByName(meets.where("b1 <> b2").select("b1", "b2", F.col("b2").alias("blk"))))
    in_blocks = (sides.join(held, "blk").groupBy("b1", "b2").applyInPandas(_block_links(n, pct), "u long, v long"))
    return rows, classes.select("gid", "size", "min_id", "rep"), checked.unionByName(in_blocks)


def _resolved(docs: DataFrame, id_col: str, text_col: str, words: int, threshold_pct: int) -> DataFrame:
    """id, tk, size, component_id, and rep: the one row (by id, null last, and text) that stands for the component."""
    rows, classes, links = similarity_links(docs, id_col, text_col, words, threshold_pct)
    # written before they are thinned: a task then has one Python worker at a time
    comp = components(materialize(links)).select(F.col("node").alias("gid"), "component")
    classes = classes.join(comp, "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    least = classes.groupBy("component").agg(F.min("min_id").alias("component_id"), F.min("rep").alias("rep"))
    named = classes.select("gid", "component").join(least, "component").select("gid", "component_id", "rep")
    return rows.join(named, "gid", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    threshold_pct: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    out = _resolved(docs, id_col, text_col, words, threshold_pct)
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"),
                      F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                threshold_pct: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id, rows without an id last;
    of rows that repeat id and text the first by all columns. Documents without words all stay."""
    out = _resolved(docs, id_col, text_col, words, threshold_pct)
    key = (F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__no"), F.col("tk").alias("__tk"))
    keep = out.where((F.col("size") == 0) | ((F.col("rep.tk") == F.col("tk")) & F.col("rep.id").eqNullSafe(F.col("id"))))
    keep = keep.select(*key, (F.col("size") == 0).alias("__blank")).distinct()
    whole = [F.col(f"`{c}`") for c in docs.columns]
    mine = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__id"), F.col(id_col).cast("long").isNull().alias("__no"),
                       F.xxhash64(F.col(text_col)).alias("__tk"), F.struct(*whole).alias("__row"))
    kept = mine.join(keep, ["__id", "__no", "__tk"])
    first = F.min("__row")
    if any("map<" in t for _, t in docs.dtypes):  # maps have no order: their JSON has
        first = F.min_by("__row", F.struct(*[F.to_json(F.col(f"__row.`{c}`")) if t.startswith("map<") else F.to_json(
            F.struct(F.col(f"__row.`{c}`"))) if "map<" in t else F.col(f"__row.`{c}`") for c, t in docs.dtypes]))
    one = (kept.where("not __blank").groupBy("__id", "__no", "__tk").agg(first.alias("__row")).select("__row.*"))
    return one.unionByName(kept.where("__blank").select("__row.*"))
