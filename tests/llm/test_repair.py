"""Conversation repair against all edit strings, at block edges, on hostile tables and against SQL."""

import hashlib
import itertools
import random
import re

import pytest

from tools.oracle_check import digest
from tripwire.llm import repair
from tripwire.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_all_edit_strings():
    rng = random.Random(3)
    kinds = [("s", 0), ("u", 0), ("a", 0), ("u", 1), ("a", 2), ("s", 3), ("u", 3), ("a", 3), ("t", 0), ("", 3), ("u", 0), ("a", 0)]
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(rng.randint(0, 3))]
        best = None
        ways = []
        for initial, fault in rows:
            stay = fault == 3
            ways.append([("D", "", 3)] + ([] if fault in (1, 2) else
                        [("K", initial or "?", 0 + stay), ("R", "u", 2 + stay), ("R", "a", 2 + stay)]))
        for picks in itertools.product(*ways):
            for holes in itertools.product(gaps, repeat=len(rows) + 1):
                seq = holes[0] + "".join(p[1] + h for p, h in zip(picks, holes[1:], strict=True))
                if re.fullmatch("(s?(ua)+)?", seq):
                    audit = "I" * len(holes[0]) + "".join(p[0] + "I" * len(h) for p, h in zip(picks, holes[1:], strict=True))
                    cost = 2 * sum(map(len, holes)) + sum(p[2] for p in picks)
                    best = min(best or (10**9, ""), (cost, audit))
        cost = repair.backward(rows, repair.END)
        edits = repair.walk(rows, cost, 0, True)[1]
        assert (cost[0][0], "".join(e[2] for e in edits)) == best, rows


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() < .9 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "übrig"]),
                         rng.choice(["Yes.", "No", "", " \t\n", None, "Was? ", "Fine!\n\n", "ok", "é.", f"x{c}.", f"y{t}."])))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (None, 2, "assistant", "Ho.")]
    rows += [(77, t // 3, ["user", "assistant"][t % 2], f"hot {t % 50}.") for t in range(400)]  # a hot conversation with ties
    rows += [(78, 5, "user", "same.")] * 60                                                     # one row, often
    rows += [(79, 0, "user", "w " * 200_000 + "."), (79, 1, "assistant", "x" * 300_000)]        # very long texts
    rows += [(80, -(1 << 61), "user", "far."), (80, (1 << 61) - 1, "assistant", "away.")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("conv")
    spark.createDataFrame([(*r, 1, "x", None) for r in conversations()], SCHEMA + ", g long, ck string, initial string") \
        .coalesce(1).write.parquet(str(d / "conversations.parquet"))
    return str(d)


def test_sql_on_hostile_rows(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select conv_id, turn, role, text from '{folder}/conversations.parquet/*.parquet'")
    rel = con.sql(ORACLE["op12_conversation_repair"])
    df = QUERIES["op12_conversation_repair"](spark, folder)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(rel.columns, rel.fetchall())


@pytest.mark.parametrize("block", [1, 2, 7, 50])
def test_blocks_of_any_size_give_the_same(spark, folder, block):
    turns = repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    cols = ["ck", "cost", "audit", "repaired_sha256", "illegal", "duplicate"]
    whole = repair.digests(repair.repair(turns)).select(cols).collect()
    assert sorted(map(tuple, repair.digests(repair.repair(turns, block_rows=block)).select(cols).collect())) == sorted(map(tuple, whole))


def test_edits_are_real(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", ""), (1, 2, "user", "Go on"), (1, 3, "user", "Go on.")]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("g", "k").collect()
    kept = [(r["edit"], r["role"], r["text"]) for r in got]
    assert [e[0] for e in kept] == list("DDIR") or "".join(e[0] for e in kept) == min_audit(rows)
    lines = "\n".join(f"{r['role']}:{r['text']}" for r in got if r["edit"] != "D")
    d = repair.digests(repair.repair(spark.createDataFrame(rows, SCHEMA))).first()
    assert d["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest() and d["illegal"] == 2 and d["blank"] == 1


def min_audit(rows):
    codes = [("a", 0), ("u", 1), ("u", 3), ("u", 0)]
    return "".join(e[2] for e in repair.walk(codes, repair.backward(codes, repair.END), 0, True)[1])


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert repair.repair(e).collect() == [] and repair.digests(repair.repair(e)).collect() == []
