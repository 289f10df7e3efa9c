"""Lexical search against scoring every document, with small blocks, chunks and batches."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripwire.llm import lexical
from tripwire.llm.common import materialize

from . import cases

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c, size in counted:
            m = 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return out


DOCS = [(r[0], r[1]) for r in cases.documents()] + [(-5, "Éte ÉTE ete\x00a_b9Ω w1x-w2x"), (-6, "w1x W1X w2x"), (-7, "w1x w1x w2x")]
rng = random.Random(9)
ITEMS = [(i, cases.sentence(rng, rng.randint(1, 30))) for i in range(25)] + [
    (100, None), (101, ""), (102, "?!"), (103, "nowhere to be found"), (None, "w1x Éte"), (104, "w5x w6x"), (104, "W7X w5x"),
    (105, " ".join(cases.VOCAB)), (106, "x" * 100_000), (107, "one two A b")]


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("k, block, chunk, pivots, pairs", [(50, 64, 400_000, 64, 200_000), (3, 2, 300, 5, 200_000), (1, 1, 1000, 1, 100)])
def test_brute_force(spark, monkeypatch, k, block, chunk, pivots, pairs):
    monkeypatch.setattr(lexical, "CHUNK_ENTRIES", chunk)
    monkeypatch.setattr(lexical, "PIVOTS", pivots)
    monkeypatch.setattr(lexical, "MOST_PAIRS", pairs)
    docs = spark.createDataFrame([(*d, 1, 2, "x") for d in DOCS], "doc_id long, text string, row long, n long, item_id string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id long")
    assert rows(lexical.rank(docs, items, k, block=block)) == sorted(brute(DOCS, ITEMS, k), key=str)


def test_blocks_are_skipped_by_their_bounds(spark):
    # topics with their own words over common ones
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices([f"t{i % 20}a{j}" for j in range(30)], k=25) + rng.choices([f"c{j}" for j in range(40)], k=25))) for i in range(3000)]
    items = [(i, " ".join(rng.choices([f"t{i}a{j}" for j in range(30)], k=8) + rng.choices([f"c{j}" for j in range(40)], k=8))) for i in range(20)]
    docs, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(docs, materialize(lexical.item_terms(asked, "item_id", "text")), block=16)
    bound = materialize(lexical.bounds(index))
    left = lexical.unskipped(index, bound, 10).count()
    assert 0 < left < 0.5 * bound.count()
    assert rows(lexical.search(index, 10)) == sorted(brute(texts, items, 10), key=str)


def test_summaries_are_maxima(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = materialize(lexical.item_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text"))
    index = lexical.build(docs, asked, block=8)
    entries = index.forward.select("chunk", "row", F.explode(F.arrays_zip("terms", "impacts")).alias("e"))
    most = entries.groupBy("chunk", F.col("e.terms").alias("term")).agg(F.max("e.impacts").alias("most"), F.count("*").alias("docs"))
    own = index.blocks.select("chunk", "term", "n", F.element_at("maxima", F.array_position("coords", F.col("term")).cast("int")).alias("top")) \
        .groupBy("chunk", "term").agg(F.max("top").alias("top"), F.sum("n").alias("in_blocks"))
    j = most.join(own, ["chunk", "term"], "full")
    assert j.where(~(F.col("top").eqNullSafe(F.col("most")) & F.col("docs").eqNullSafe(F.col("in_blocks")))).count() == 0


def test_empty(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank(d.limit(0), i, 5).collect() == []
    assert lexical.rank(d, i.limit(0), 5).collect() == []
    assert lexical.rank(d.where("text is null"), i, 5).collect() == []
