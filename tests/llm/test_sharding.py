"""Hash tree: laws of placement on hostile tables, movement on growth and on another weight."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tripwire.llm import sharding

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x", None) for r in cases.documents()], cases.DOC_SCHEMA + ", shard int, slot string, size string")


def test_rows_slots_and_growth(docs):
    got = sharding.shards(docs, sharding.standard(16), sharding.standard(17)).collect()
    want = Counter((i, 1 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in cases.documents())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    where = {}
    for r in got:
        assert where.setdefault(r["doc_id"], r["shard"]) == r["shard"]  # the id decides
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    again = sharding.shards(docs.repartition(5), sharding.standard(16), sharding.standard(17)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def _placed(spark, *trees, n=20_000):
    d = spark.range(n).select("id", *[sharding.place(F.col("id"), t).alias(f"t{i}") for i, t in enumerate(trees)])
    return d.collect()


def test_weights_decide_the_shares(spark):
    tree = [sharding.Shard(0, "a", "x", 1), sharding.Shard(1, "a", "x", 3), sharding.Shard(2, "a", "y", 2),
            sharding.Shard(3, "b", "x", 4), sharding.Shard(4, "b", "z", 0)]
    n = Counter(r["t0"] for r in _placed(spark, tree))
    assert set(n) == {0, 1, 2, 3}
    for s in tree[:4]:
        assert abs(n[s.number] / 20_000 - s.weight / 10) < 0.02


def test_another_weight_moves_rows_only_at_its_path(spark):
    tree = sharding.standard(16)
    heavier, lighter = sharding.reweighted(tree, 5, 3.0), sharding.reweighted(tree, 5, 0.25)
    moved = 0
    place = {s.number: (s.region, s.rack) for s in tree}
    for r in _placed(spark, tree, heavier, lighter):
        for old, new in ((r["t0"], r["t1"]), (r["t2"], r["t0"])):  # 5 gets heavier in both
            if old != new:
                moved += 1
                # into the heavier region, else into its rack, else into the shard itself
                if place[old][0] != place[5][0]:
                    assert place[new][0] == place[5][0]
                elif place[old][1] != place[5][1]:
                    assert place[new] == place[5]
                else:
                    assert new == 5
    assert 0 < moved < 20_000


def test_each_new_shard_takes_rows_only_into_itself(spark):
    trees = [sharding.standard(n) for n in (16, 17, 18, 19)]
    trees.append(sharding.grown(trees[-1], "region0", "rack1", 2.0))
    for r in _placed(spark, *trees):
        for k in range(1, len(trees)):
            assert r[f"t{k}"] in (r[f"t{k - 1}"], 15 + k)
    taken = sum(r["t4"] == 19 for r in _placed(spark, *trees))
    assert abs(taken / 20_000 - 2 / 21) < 0.015


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    d = docs.drop("shard")
    sharding.write(d, sharding.standard(16), str(tmp_path / "s"))
    back = spark.read.schema(StructType([*d.schema.fields, StructField("shard", IntegerType())])).parquet(str(tmp_path / "s"))
    assert back.drop("shard").exceptAll(d).count() == 0 and back.count() == d.count()
    assert back.where(F.col("shard") != sharding.place(F.col("doc_id"), sharding.standard(16))).count() == 0


def test_empty_and_weightless(spark, docs):
    assert sharding.shards(docs.limit(0), sharding.standard(16)).collect() == []
    with pytest.raises(ValueError):
        sharding.place(F.col("doc_id"), [sharding.Shard(0, "a", "b", 0.0)])
