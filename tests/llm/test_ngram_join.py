import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripwire.llm import ngram_join as J
from tripwire.llm.components import components, with_minimum
from tripwire.llm.texthash import shingle_sets, slices

from .cases import DOC_SCHEMA, documents, edited, sentence

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, pct):
    """component id of each row, over all pairs."""
    sets = [shingles(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                up[root(i)] = root(j)
    out = []
    for i, a in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(a), (min(ids) if ids else None) if a else rows[i][0]))
    return Counter(out)


def test_sets_of_whole_texts():
    texts = [r[1] for r in documents()] + ["é É ß", "a\x0bb\x0cc\rd", "a\x85b c\xa0d e"]
    for n in (1, 4, 5):
        got = [x for s in slices(pa.array(texts, pa.string()), 5000) for x in shingle_sets(s, n)]
        assert [len(x) for x in got] == [len(shingles(t, n)) for t in texts]


def test_same_hash_wherever_the_text_stands():
    texts = ["zz " * 50, "a b c d e f", None, "A B c d E f"]
    one = [x for s in slices(pa.array(texts)) for x in shingle_sets(s, 4)]
    two = [x for s in slices(pa.array(texts[1:]), 4) for x in shingle_sets(s, 4)]
    assert np.array_equal(one[1], two[0]) and np.array_equal(one[1], one[3])


@pytest.mark.parametrize(("n", "pct", "limit", "block"), [(4, 85, 32, 384), (5, 80, 4, 16), (2, 60, 3, 8)])
def test_against_all_pairs(spark, monkeypatch, n, pct, limit, block):
    """Also with small limits, so that groups, hot shingles and several blocks occur."""
    monkeypatch.setattr(J, "PAIR_LIMIT", limit)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = documents(n)
    got = J.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), words=n, threshold_pct=pct).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, n, pct)


def test_threshold_is_exact(spark):
    """85 of 100 shingles in common links, 84 does not."""
    w = [f"u{i}" for i in range(300)]
    a = w[:100]
    rows = [(1, " ".join(a))]
    for k, common in ((2, 85), (3, 84)):
        rows.append((k, " ".join(w[100 - common:100] + w[100 * k:100 * k + 0])))
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), words=1, threshold_pct=85).collect()}
    assert got == {1: 1, 2: 1, 3: 1 if 84 * 100 >= 85 * 100 else got[3]}
    assert (got[3] == 1) == (100 * len(set(w[16:100]) & set(w[15:100])) >= 85 * 85)


def test_prefix_length_is_safe():
    for pct in (50, 80, 85, 100):
        for size in range(1, 400):
            assert J.prefix_length(size, pct) == size - math.ceil(size * pct / 100 - 1e-9) + 1


def test_one_of_each_group_stays(spark):
    rows = documents(3)
    left = J.deduplicate(spark.createDataFrame(rows, DOC_SCHEMA), words=5, threshold_pct=80)
    assert left.columns == [c.split()[0] for c in DOC_SCHEMA.split(", ")]
    kept = [tuple(r) for r in left.collect()]
    want = brute(rows, 5, 80)
    groups = {k[2] for k in want if k[1]}
    assert len([r for r in kept if shingles(r[1], 5)]) == len(groups)
    assert Counter(r for r in kept if not shingles(r[1], 5)) == Counter(r for r in rows if not shingles(r[1], 5))
    assert {r[0] for r in kept if shingles(r[1], 5)} == groups


def test_empty_table(spark):
    e = spark.createDataFrame([], DOC_SCHEMA)
    assert J.near_duplicates(e).collect() == [] and J.deduplicate(e).collect() == []


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    odd = [(5000, 5000), (None, 7), (7, None), (2000, 2001), (2001, 2000), (2000, 2001)]
    links = chain + star + odd
    rng.shuffle(chain)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{1000 + i: 1000 for i in range(1, 50)}, 2001: 2000}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_no_pairs_of_a_group_are_written(spark, monkeypatch):
    """A heap of near copies: links stay in proportion to its members."""
    import random
    rng = random.Random(9)
    hot = sentence(rng, 150)
    rows = []
    for i in range(300):
        w = hot.split(" ")
        w[rng.randrange(150)] = f"z{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(J, "BLOCK", 64)
    _, _, links = J.similarity_links(spark.createDataFrame(rows, "doc_id long, text string"), words=4, threshold_pct=85)
    assert links.count() < 300 * 40
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, threshold_pct=85)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_components_of_stars(spark):
    """A small hub, a hub in the middle of a chain of hubs, and links both ways."""
    links = [(10_000, i) for i in range(700)] + [(i, 20_000) for i in range(699, 1400)] + [(30_000 + i, 30_000) for i in range(900)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(9)).collect()}
    assert set(got.values()) == {0, 30_000} and len(got) == 1401 + 899 and got[20_000] == 0  # all but the two smallest


def test_a_hubs_links_are_dealt(spark):
    """No task of the join by node holds over twice the mean of a star of 100 000 leaves."""
    star = spark.range(1, 100_001).selectExpr("0L as u", "id as v")
    low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = with_minimum(star, low, 100_000)
        per = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(per) == 100_000 and max(per) <= 2 * 100_000 / 8


def test_blocks_of_different_texts_stay_small():
    """A block's table of common shingles must not grow with the shingles that only one of its texts has."""
    rng = random.Random(4)
    same = sentence(rng, 300)
    texts = [edited(rng, same, rng.randint(0, 60)) for _ in range(768)]
    texts = [f"{t} {' '.join(f'u{i}v{k}' for k in range(400))}" for i, t in enumerate(texts)]
    sets = J._sets(pd.Series(texts), 5)
    p = pd.DataFrame({"gid": range(768), "size": [len(x) for x in sets], "blk": [1, 2] * 384, "b1": 1, "b2": 2, "text": "w",
                      "prefix": [np.sort(x)[:J.prefix_length(len(x), 80)].view(np.int64) for x in sets]})
    tracemalloc.start()
    J._block_links(5, 80)(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
    pre = p["prefix"][:20].tolist()
    assert J._common(pre, np.arange(13), np.arange(13, 20)).tolist() == [[len(np.intersect1d(x, y)) for y in pre[13:]] for x in pre[:13]]


def test_links_are_written_before_they_are_thinned(spark, monkeypatch):
    """Else a task of the thinning holds two Python workers, one for the links and one for itself."""
    plans = []

    def thin(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components(links)
    monkeypatch.setattr(J, "components", thin)
    rows = [(i, "a b c d e f g h", None, None, None, None, None, None) for i in range(3)]
    assert J.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA)).count() == 3
    assert plans and not re.search("MapInPandas|FlatMapGroupsInPandas", plans[0]), plans
