import numpy as np
import pytest

from tripwire.llm import pq_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id long"


def vectors(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(260):
        x = base[i % 12] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.2, 0.5])
        rows.append((i, x.astype(np.float32).tolist(), int(i % 3), "x", 9))
    same = rows[7][1]
    rows += [(1000 + i, same, 1, "x", 9) for i in range(40)]           # copies
    rows += [(2000 + i, [3.0 * t for t in same], 1, "x", 9) for i in range(3)]  # other lengths, same direction
    rows += [(3000, None, 1, "x", 9), (3001, [0.0] * dim, 1, "x", 9), (3002, [float("nan")] + [1.0] * (dim - 1), 1, "x", 9),
             (3003, [None] + [1.0] * (dim - 1), 1, "x", 9), (3004, [float("inf")] * dim, 1, "x", 9), (3005, same, None, "x", 9),
             (3006, [], 1, "x", 9), (3007, [1.0, 2.0], 1, "x", 9), (3008, [1.0, 2.0], 1, "x", 9), (3009, [-0.0, 2.0], 1, "x", 9), (3010, [0.0, 2.0], 1, "x", 9)]
    rows += [rows[5], rows[5], (None, same, 1, "x", 9)]
    return rows


def usable(x, zero=True):
    return x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and (zero or any(c != 0 for c in x))


def brute_topk(rows, is_query, k):
    def scaled(x):
        return [int(np.floor(max(min(256 * float(np.float32(c)), 1e14), -1e14))) for c in x]
    v = [(r[0], scaled(r[1])) for r in rows if r[0] is not None and usable(r[1])]
    out = []
    for i, (q, x) in enumerate(v):
        if is_query(q):
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for j, (c, y) in enumerate(v) if j != i and len(x) == len(y))[:k]
            out += [(q, n + 1, c, max(min(-t, (1 << 63) - 1), -(1 << 63))) for n, (t, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("nodes", "cand", "ask"), [(2, 4096, 512), (3, 64, 8), (1, 32, 16)])
def test_topk_against_all_scores(spark, monkeypatch, nodes, cand, ask):
    monkeypatch.setattr(topk, "CANDIDATES", cand)
    monkeypatch.setattr(topk, "QUERIES", ask)
    rows = vectors()
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), (topk.F.col("id") % 10 == 0), nodes=nodes).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows, lambda i: i % 10 == 0, 5)


def test_topk_few_candidates_and_empty(spark):
    rows = [(i, [float(i), 1.0], 0, "x", 9) for i in range(3)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), topk.F.col("id") >= 0).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows, lambda i: True, 5) and len(got) == 6
    assert topk.top_k(spark.createDataFrame([], SCHEMA), topk.F.col("id") >= 0).collect() == []


def test_topk_large_components(spark):
    rows = [(i, [float((-1) ** i) * 6e5 * (i + 1), 2e6], 0, "x", 9) for i in range(12)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), topk.F.col("id") % 2 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows, lambda i: i % 2 == 0, 5)


def test_topk_beyond_64_bits(spark):
    """Ranked exactly, shown as the nearest 64-bit number."""
    big = [1e10, 1e8, -1e9, 3e37, 2e10, 1.0, 0.0, -5.0]
    rows = [(i, [x, float(i)], 0, "x", 9) for i, x in enumerate(big)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), topk.F.col("id") >= 0, k=4).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows, lambda i: True, 4)


def test_topk_repeated_ids_and_equal_vectors(spark):
    """A row that repeats a query's id is its candidate; many equal vectors lose no tie."""
    rows = [(50, [1.0, 2.0], 0, "x", 9)] * 2 + [(50, [0.5, 2.0], 0, "x", 9)] + [(i, [1.0, 2.0], 0, "x", 9) for i in range(60, 100)] \
        + [(1, [-1.0, 0.0], 0, "x", 9)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), topk.F.col("id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows, lambda i: i % 50 == 0, 5)


def brute_links(rows, cos):
    ok = [r[2] is not None and usable(r[1], False) for r in rows]
    v = [np.array(r[1], np.float32).astype(float) if k else None for r, k in zip(rows, ok, strict=True)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) \
                    and v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= cos:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = (min(ids) if ids else None) if ok[i] else r[0]
        out.append((r[0], n[i], c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cos", "block"), [(0.98, 1024), (0.9, 32), (0.999, 8)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, cos, block):
    """Recall 1.0, also with several blocks in a list."""
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    rows = vectors(1)
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), cos).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows, cos)


def test_a_bad_sample_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "SAMPLE", 5)
    rows = vectors(2)
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.97).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows, 0.97)


def test_near_duplicates_empty(spark):
    assert pq_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
