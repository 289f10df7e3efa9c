"""Ranked lexical search over posting lists in geometric blocks. Exact.

The queries' terms are ordered by weight, the heaviest (rarest) first. Documents become sparse vectors
of 64-bit impacts over these terms, and:

* *clusters*: each document goes to the nearest of a bounded sample of documents (PIVOTS, by cosine);
  cells of similar documents are cut into chunks of about CHUNK_ENTRIES entries (:func:`build`). A posting list
  is thus dealt over chunks, however long it is, and inside a chunk it is sorted by cell, second
  nearest pivot and place and cut into blocks of BLOCK similar documents.
* *summaries*: a block of term t stores the coordinatewise maximum of its documents' impacts over t and
  the lighter terms that some query holds together with t. No other coordinate is ever asked of it:
  a document that also holds a heavier term of the query is found through that term's list.
* *search* (:func:`search`): the inner product of a query with a summary bounds the score of every document
  that this list must find. The k documents of the most promising blocks give a threshold for each
  query, and a block is skipped only when its bound is below it. The documents of all others are
  scored exactly from their whole vectors.

A document among the k best scores at least the threshold, so the block of its heaviest query term
is not skipped: results are those of scoring everything, at any setting of the constants.

Queries are dealt in batches of at most MOST_PAIRS (item, term) pairs (an item with more is a batch of its own),
so that vocabulary and weights, which all tasks hold, are bounded. Terms are compared by 64-bit hashes
over their bytes (two of a million different terms collide with probability 3e-8).

Defined results: a null text has no terms; rows of one item id form one item, null id included; repeated
document rows are documents of their own; a null document id ranks last among equal scores; an item without
terms, or whose terms stand in no document, has no rows; other columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texthash as th
from .common import arrow_map, materialize, ship_package

MOST_PAIRS = 200_000
PIVOTS = 64
CHUNK_ENTRIES = 400_000
BLOCK = 64
#: Blocks of each query that give its threshold, as a multiple of k.
SEEDS = 2

TERM = np.zeros(256, np.int8)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = 1


def _term_hashes(s: th.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of a slice, and how many each text has."""
    start, end = th.runs(TERM[s.data], s.offsets)
    text = np.searchsorted(s.offsets, start, "right") - 1
    return th.span_hash(th.prefix_hash(s.data, th._LOWER_BYTE), start, end), np.bincount(text, minlength=s.n)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): distinct term hashes of each item."""
    def terms(b):
        ids = b.column("item")
        for s in th.slices(b.column("text")):
            h, n = _term_hashes(s)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(s.n), n) + s.first)), pa.array(h.view(np.int64))],
                                             names=["item", "term"])
    t = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(t, terms, "item long, term long").distinct()


def _batches(pairs: DataFrame) -> list[tuple[int, int]]:
    """(modulus, remainder) of item hashes, each with at most MOST_PAIRS pairs or one item."""
    todo, out = [(1, 0)], []
    while todo:
        m, r = todo.pop()
        n = pairs.where(F.pmod(F.xxhash64("item"), F.lit(m)) == r).agg(F.count(F.lit(1)), F.min("item"), F.max("item")).first()
        if n[0] > MOST_PAIRS and n[1] != n[2]:
            todo += [(2 * m, r), (2 * m, r + m)]
        elif n[0]:
            out.append((m, r))
    return out


@dataclass
class Batch:
    """Queries over a shared vocabulary; terms are numbered by weight, heaviest first."""
    items: list            # item ids, None for the null one
    terms: list            # of each item, its term numbers, ascending
    weights: np.ndarray    # of each term

    def lists(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each term: the queries that hold it, with their terms from it on."""
        out: dict[int, list] = {}
        for q, ts in enumerate(self.terms):
            for i, t in enumerate(ts.tolist()):
                out.setdefault(t, []).append((q, ts[i:]))
        return out


@dataclass
class Index:
    forward: DataFrame     # (chunk, row, doc_id, cell, second, terms, impacts)
    blocks: DataFrame      # (chunk, term, blk, n, coords, maxima)
    batch: Batch
    block: int


def _vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, terms, tf): how often each document holds each known term, and all its terms' number."""
    def count(b):
        for s in th.slices(b.column("text")):
            h, n = _term_hashes(s)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            key = np.repeat(np.arange(s.n, dtype=np.int64), n)[hit] * len(vocabulary) + at[hit]
            key, tf = np.unique(key, return_counts=True)
            doc = key // len(vocabulary)
            per = np.bincount(doc, minlength=s.n)
            yield pa.RecordBatch.from_arrays([
                b.column("row").slice(s.first, s.n), b.column("doc_id").slice(s.first, s.n), pa.array(n.astype(np.int64)),
                _lists((key % len(vocabulary)).astype(np.int32), per, pa.int32()), _lists(tf.astype(np.int32), per, pa.int32())],
                names=["row", "doc_id", "n", "terms", "tf"])
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                    F.col(text_col).cast("string").alias("text"))
    return arrow_map(d, count, "row long, doc_id long, n long, terms array<int>, tf array<int>")


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.asarray(col.offsets).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return np.asarray(col.values)[off[0]:off[-1]] if len(col) else np.zeros(0, np.int64), off - off[0]


def _impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    if len(n) and int(n.max()) * 50 * docs >= 1 << 63:
        m = 50 + np.array([50 * int(x) * docs // length for x in n], np.int64)
    else:
        m = 50 + (50 * n * docs) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def build(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Index:
    """Index every document for the queries ``pairs`` (item, term), at most MOST_PAIRS or one item."""
    spark = docs.sparkSession
    asked = pairs.collect()  # bounded, see above
    vocabulary = np.unique(np.array([r["term"] for r in asked], np.int64).view(np.uint64))
    raw = materialize(_vectors(docs, vocabulary, id_col, text_col))
    total = raw.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in raw.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per known term
        df[r["t"]] = r["count"]
    n_docs, length = int(total["docs"]), int(total["length"])
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    order = np.lexsort((df, -w))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    by_item: dict = {}
    for r in asked:
        by_item.setdefault(r["item"], []).append(r["term"])
    terms = [np.sort(number[np.searchsorted(vocabulary, np.array(ts, np.int64).view(np.uint64))]) for ts in by_item.values()]
    batch = Batch(list(by_item), terms, w[order])

    pivots = _pivots(raw, number, batch.weights, n_docs, length)

    def assign(b):
        ts, off = _flat(b.column("terms"))
        tf, _ = _flat(b.column("tf"))
        per = np.diff(off)
        ts = number[ts]
        imp = _impacts(tf.astype(np.int64), np.repeat(np.asarray(b.column("n")), per), n_docs, length)
        near = np.zeros((len(per), max(pivots.shape[1], 2)), np.float32)
        some = np.flatnonzero(per)
        for i in range(0, len(some), 256):  # a few MB at a time
            d = some[i:i + 256]
            lo, hi = off[d[0]], off[d[-1] + 1]
            x = (imp[lo:hi] * batch.weights[ts[lo:hi]]).astype(np.float32)
            near[d, :pivots.shape[1]] = np.add.reduceat(x[:, None] * pivots[ts[lo:hi]], off[d] - lo, axis=0)
        best = np.argsort(-near, axis=1, kind="stable")[:, :2].astype(np.int32)
        by = np.lexsort((ts, np.repeat(np.arange(len(per)), per)))
        yield pa.RecordBatch.from_arrays([
            b.column("row"), b.column("doc_id"), pa.array(best[:, 0]), pa.array(best[:, 1]),
            _lists(ts[by].astype(np.int32), per, pa.int32()), _lists(imp[by].astype(np.int32), per, pa.int32())],
            names=["row", "doc_id", "cell", "second", "terms", "impacts"])
    placed = materialize(arrow_map(raw.where(F.size("terms") > 0), assign,
                                   "row long, doc_id long, cell int, second int, terms array<int>, impacts array<int>"))
    # one row per pivot; a cell of any size is cut by the hash of the row
    sizes = {r["cell"]: r["e"] for r in placed.groupBy("cell").agg(F.sum(F.size("terms")).alias("e")).collect()}
    first, cuts = 0, []
    for cell in range(max(sizes, default=0) + 1):
        n = -(-sizes.get(cell, 0) // CHUNK_ENTRIES)
        cuts.append(F.struct(F.lit(first).cast("long").alias("first"), F.lit(max(n, 1)).cast("long").alias("n")))
        first += n
    cut = F.element_at(F.array(*cuts), F.col("cell") + 1)
    forward = placed.withColumn("chunk", cut["first"] + F.pmod(F.xxhash64("row"), cut["n"]))
    ship_package(spark)
    co = _co_terms(batch)
    blocks = forward.groupBy("chunk").applyInArrow(lambda t: _summaries(t, co, block), _BLOCKS_SQL)
    return Index(forward, materialize(blocks), batch, block)


def _pivots(raw: DataFrame, number: np.ndarray, weights: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Unit vectors of PIVOTS documents with known terms, drawn by a hash of the row: (terms x pivots)."""
    got = raw.where(F.size("terms") > 0).orderBy(F.xxhash64("row", F.lit(7))).limit(PIVOTS).collect()
    out = np.zeros((len(weights), max(len(got), 1)), np.float32)
    for j, r in enumerate(sorted(got, key=lambda r: r["row"])):
        ts = number[np.array(r["terms"])]
        tf = np.array(r["tf"], np.int64)
        x = (_impacts(tf, np.full(len(tf), r["n"], np.int64), docs, length) * weights[ts]).astype(np.float64)
        out[ts, j] = x / max(np.sqrt((x * x).sum()), 1e-9)
    return out


def _co_terms(batch: Batch) -> dict[int, np.ndarray]:
    """Each term with the later terms that some query holds beside it."""
    return {t: np.unique(np.concatenate([ts for _, ts in qs])) for t, qs in batch.lists().items()}


class _Chunk:
    """A chunk's documents in order of similarity, by document and by term."""

    def __init__(self, table: pa.Table):
        by = np.lexsort([np.asarray(table[c]) for c in ("row", "second", "cell")])
        table = table.take(pa.array(by)).combine_chunks()
        self.doc_id, self.row = table["doc_id"], table["row"]
        self.terms, self.off = _flat(table["terms"])
        self.impacts = _flat(table["impacts"])[0].astype(np.int64)
        doc = np.repeat(np.arange(len(by)), np.diff(self.off))
        self.by_term = np.argsort(self.terms, kind="stable")
        self.posting = doc[self.by_term]
        self.present, start = np.unique(self.terms[self.by_term], return_index=True)
        self.start = np.append(start, len(self.terms))

    def postings(self, i: int) -> np.ndarray:
        """Documents of the i-th present term, similar ones side by side."""
        return self.posting[self.start[i]:self.start[i + 1]]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these documents' entries, and which document of ``docs`` each belongs to."""
        n = self.off[docs + 1] - self.off[docs]
        which = np.repeat(np.arange(len(docs)), n)
        return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.off[docs], n), which


_BLOCKS = pa.schema([("chunk", pa.int64()), ("term", pa.int32()), ("blk", pa.int32()), ("n", pa.int32()),
                     ("coords", pa.list_(pa.int32())), ("maxima", pa.list_(pa.int32()))])
_BLOCKS_SQL = "chunk long, term int, blk int, n int, coords array<int>, maxima array<int>"


def _summaries(table: pa.Table, co: dict[int, np.ndarray], block: int) -> pa.Table:
    """Blocks of every posting list of a chunk, with their coordinatewise maxima."""
    c = _Chunk(table)
    place = np.full(int(max(x[-1] for x in co.values())) + 1, -1, np.int64)
    term, blk, size, per, coords, maxima = [], [], [], [], [], []
    for i, t in enumerate(c.present.tolist()):
        docs, want = c.postings(i), co[t]
        place[want] = np.arange(len(want))
        at, which = c.entries(docs)
        to = place[c.terms[at]]
        on = to >= 0
        blocks = -(-len(docs) // block)
        top = np.zeros((blocks, len(want)), np.int64)
        np.maximum.at(top, (which[on] // block, to[on]), c.impacts[at[on]])
        b, x = np.nonzero(top)
        term.append(np.full(blocks, t))
        blk.append(np.arange(blocks))
        size.append(np.minimum(block, len(docs) - block * np.arange(blocks)))
        per.append(np.bincount(b, minlength=blocks))
        coords.append(want[x])
        maxima.append(top[b, x])
        place[want] = -1
    term = np.concatenate(term)
    per = np.concatenate(per)
    return pa.Table.from_arrays([
        pa.array(np.full(len(term), table["chunk"][0].as_py()), pa.int64()), pa.array(term, pa.int32()), pa.array(np.concatenate(blk), pa.int32()),
        pa.array(np.concatenate(size), pa.int32()), _lists(np.concatenate(coords).astype(np.int32), per, pa.int32()),
        _lists(np.concatenate(maxima).astype(np.int32), per, pa.int32())], schema=_BLOCKS)


def bounds(index: Index) -> DataFrame:
    """(q, chunk, term, blk, n, bound): the most that a block's documents can score through this list."""
    lists, w = index.batch.lists(), index.batch.weights

    def bound(b):
        coords, off = _flat(b.column("coords"))
        maxima = _flat(b.column("maxima"))[0].astype(np.int64)
        top = np.zeros(len(w), np.int64)
        row, q, score = [], [], []
        for i, t in enumerate(b.column("term").to_pylist()):
            at = coords[off[i]:off[i + 1]]
            top[at] = maxima[off[i]:off[i + 1]] * w[at]
            for which, ts in lists[t]:
                row.append(i)
                q.append(which)
                score.append(int(top[ts].sum()))
            top[at] = 0
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *[b.column(x).take(take) for x in ("chunk", "term", "blk", "n")],
                                          pa.array(score, pa.int64())], names=["q", "chunk", "term", "blk", "n", "bound"])
    return arrow_map(index.blocks, bound, "q int, chunk long, term int, blk int, n int, bound long")


_FOUND = pa.schema([("q", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _best_first():
    return Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")


def _evaluate(index: Index, picked: DataFrame, k: int) -> DataFrame:
    """(q, row, doc_id, score): the k best documents of each query in the picked blocks, scored exactly."""
    terms, w, block = index.batch.terms, index.batch.weights, index.block

    def score(docs: pa.Table, picks: pa.Table) -> pa.Table:
        out = []
        if picks.num_rows and docs.num_rows:
            c = _Chunk(docs)
            ids = np.array([(1 << 63) - 1 if x is None else x for x in c.doc_id.to_pylist()], np.int64)
            null = np.asarray(c.doc_id.is_null())
            at_term = {t: i for i, t in enumerate(c.present.tolist())}
            q = np.asarray(picks["q"])
            by = np.argsort(q, kind="stable")
            term, blk = np.asarray(picks["term"])[by], np.asarray(picks["blk"])[by]
            which, start = np.unique(q[by], return_index=True)
            wq = np.zeros(len(w), np.int64)
            for j, (lo, hi) in zip(which.tolist(), zip(start, np.append(start[1:], len(q)), strict=True), strict=True):
                some = np.unique(np.concatenate([c.postings(at_term[t])[b * block:(b + 1) * block]
                                                 for t, b in zip(term[lo:hi].tolist(), blk[lo:hi].tolist(), strict=True)]))
                wq[terms[j]] = w[terms[j]]
                at, own = c.entries(some)
                s = np.zeros(len(some), np.int64)
                np.add.at(s, own, wq[c.terms[at]] * c.impacts[at])
                wq[terms[j]] = 0
                best = np.lexsort((np.asarray(c.row)[some], ids[some], null[some], -s))[:k]
                best = best[s[best] > 0]
                out.append(pa.Table.from_arrays([pa.array(np.full(len(best), j), pa.int32()), c.row.take(pa.array(some[best])),
                                                 c.doc_id.take(pa.array(some[best])), pa.array(s[best])], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()
    return index.forward.groupBy("chunk").cogroup(picked.select("q", "chunk", "term", "blk").groupBy("chunk")) \
        .applyInArrow(score, "q int, row long, doc_id long, score long")


def unskipped(index: Index, bound: DataFrame, k: int) -> DataFrame:
    """The blocks whose bound reaches their query's threshold."""
    promising = Window.partitionBy("q").orderBy(F.desc("bound"), "chunk", "term", "blk")
    seeds = bound.withColumn("at", F.row_number().over(promising)).where(F.col("at") <= SEEDS * k)
    floor = _evaluate(index, seeds, k).withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") == k) \
        .select("q", F.col("score").alias("floor"))  # of queries with k documents in their seeds
    return bound.join(floor, "q", "left").where((F.col("bound") > 0) & (F.col("bound") >= F.coalesce("floor", F.lit(1))))


def search(index: Index, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of every query."""
    spark = index.forward.sparkSession
    found = _evaluate(index, unskipped(index, materialize(bounds(index)), k), k)
    items = spark.createDataFrame(list(enumerate(index.batch.items)), "q int, item_id long")  # of this batch
    return found.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= k) \
        .join(F.broadcast(items), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The k best documents of every item, all items against all documents."""
    pairs = materialize(item_terms(items, item_col, item_text))
    out = None
    for m, r in _batches(pairs):
        found = search(build(docs, pairs.where(F.pmod(F.xxhash64("item"), F.lit(m)) == r), id_col, text_col, block), k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
