import re
from collections import Counter

import pytest

from tripwire.llm import mixing

from .cases import DOC_SCHEMA, documents


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(rows, weights=(5, 2, 1), share=1.5, most=2):
    words = Counter()
    for r in rows:
        words[r[3]] += size(r[1])
    order = sorted((s for s in words if s is not None)) + ([None] if None in words else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, full = share * sum(words.values()), set()
    while len(full) < len(order):
        level = (goal - sum(most * words[s] for s in full)) / sum(w[s] for s in order if s not in full)
        new = {s for s in order if s not in full and w[s] * level > most * words[s]}
        if not new:
            break
        full |= new
    return words, {s: float(most * words[s]) if s in full else w[s] * level for s in order}


def plan_rows(spark, rows, parts):
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)
    mix, narrow = mixing.plan(docs)
    return mix, narrow, mix.decide(narrow).selectExpr("doc_id", "__size", "__words", "__target", "__copies", "__skey", "__h").collect()


@pytest.fixture(scope="module")
def many():
    """Enough texts that sources have several blocks."""
    out = []
    for k in range(6):
        out += [(r[0] * 10 + k if r[0] is not None else None, r[1] and r[1] + f" k{k}" * (k > 0), *r[2:]) for r in documents(k)]
    return out


def test_targets_and_copies(spark, many, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 3000)
    _, _, got = plan_rows(spark, many, 3)
    words, target = brute_targets(many)
    assert Counter((r["doc_id"], r["__size"]) for r in got) == Counter((r[0], size(r[1])) for r in many)
    taken, longest = Counter(), max(size(r[1]) for r in many)
    for r in got:
        s = None if r["__skey"] == "n" else r["__skey"][1:]
        assert r["__words"] == words[s] and abs(r["__target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["__copies"] <= 2
        taken[s] += r["__copies"] * r["__size"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.05 * t, longest / 2)


def test_reruns_agree(spark, many):
    a, b = (Counter(tuple(r) for r in plan_rows(spark, many, k)[2]) for k in (2, 5))
    assert a == b


def test_the_tree_deals_every_block_once(spark, many):
    docs = spark.createDataFrame(many, DOC_SCHEMA)
    mix, narrow = mixing.plan(docs, block_words=500)
    decided = mix.decide(narrow)
    got = mixing.shards(mix, decided, 5).collect()
    drawn = {(r["__skey"], r["__blk"], c) for r in decided.collect() for c in range(1, r["__copies"] + 1)}
    assert len(got) == len(drawn) and {(r["skey"], r["blk"], r["copy"]) for r in got} == drawn
    load = Counter(r["shard"] for r in got)
    assert set(load) == set(range(5)) and max(load.values()) - min(load.values()) <= 4


def test_the_mix_holds_the_copies(spark, many):
    docs = spark.createDataFrame(many, DOC_SCHEMA)
    out = mixing.mixed(docs, 4)
    assert out.columns == docs.columns
    mix, narrow = mixing.plan(docs)
    want = Counter()
    for r in mix.decide(mix.sized(docs)).collect():
        want[tuple(r[c] for c in docs.columns)] += r["__copies"]
    assert Counter(tuple(r) for r in out.collect()) == +want


def test_a_document_of_a_third_of_its_source(spark):
    """Whatever its place in the permutation, the other documents fill what it leaves of the rest."""
    rows = []
    for k in range(24):
        n = [100 + 37 * (i * (k + 3) % 41) for i in range(200)]
        n.append(sum(n) // 2)
        if k % 4 == 3:  # two of a fourth each
            n[-1:] = [sum(n[:-1]) // 2] * 2
        rows += [(1000 * k + i, "w " * m, None, f"s{k:02d}", None, None, None, None) for i, m in enumerate(n)]
    _, _, got = plan_rows(spark, rows, 3)
    taken, target = Counter(), {r["__skey"]: r["__target"] for r in got}
    for r in got:
        taken[r["__skey"]] += r["__copies"] * r["__size"]
    assert {s: (taken[s], t) for s, t in target.items() if abs(taken[s] - t) > 0.002 * t} == {}


def test_repeated_rows_are_passed_over_together(spark):
    """Six rows of 100 words that are one unit stand in no other document's way."""
    one = (0, "w " * 100, None, "s", None, None, None, None)
    rows = [one] * 6 + [(i, f"w{i} " * 9, None, "s", None, None, None, None) for i in range(1, 201)]
    _, _, got = plan_rows(spark, rows, 2)
    assert abs(sum(r["__copies"] * r["__size"] for r in got) - got[0]["__target"]) <= 9
    assert len({r["__copies"] for r in got if r["doc_id"] == 0}) == 1


def test_two_sources_and_no_words(spark):
    rows = [(1, "a b", None, "s", None, None, None, None), (2, "", None, "t", None, None, None, None), (3, None, None, None, None, None, None, None)]
    _, _, got = plan_rows(spark, rows, 1)
    assert {(r["doc_id"], r["__words"], r["__target"]) for r in got} == {(1, 2, 3.0), (2, 0, 0.0), (3, 0, 0.0)}


def test_empty(spark):
    e = spark.createDataFrame([], DOC_SCHEMA)
    assert mixing.mixed(e).collect() == [] and plan_rows(spark, [], 1)[2] == []


def test_taken_goes_through_the_tree(spark, many):
    docs = spark.createDataFrame(many, DOC_SCHEMA)
    mix, narrow = mixing.plan(docs, block_words=500)
    decided = mix.decide(narrow)
    at = {(r["skey"], r["blk"], r["copy"]): r["shard"] for r in mixing.shards(mix, decided, 5).collect()}
    got = mixing.taken(mix, decided, 5).collect()
    assert len(got) == len(many) and sum(map(len, (r["__shards"] for r in got)))
    for r in got:
        assert r["__shards"] == [at[r["__skey"], r["__blk"], c] for c in range(1, r["__copies"] + 1)]


def test_ranks_in_parts_are_ranks(spark, many, monkeypatch):
    """The tree does not depend on the parts in which a node is ranked."""
    docs = spark.createDataFrame(many, DOC_SCHEMA)
    mix, narrow = mixing.plan(docs, block_words=200)
    got = []
    for bits in (1, 8):
        monkeypatch.setattr(mixing, "RANK_BITS", bits)
        got.append(sorted(tuple(r) for r in mixing.shards(mix, mix.decide(narrow), 7).collect()))
    assert got[0] == got[1]
