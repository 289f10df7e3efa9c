"""Conversation structure repair: the cheapest edits that give role initials ``(s?(ua)+)?``.

A row costs 0 to keep, 2 to get the role that the place asks for, 3 to delete (a blank or duplicate row
must go); an empty turn costs 2 to insert anywhere, and a truncated row that stays adds 1. Among the cheapest
edit strings over ``D < I < K < R`` the ASCII-least is taken.

Method, a square-root checkpointed dynamic programme over four states (nothing yet, after s, after u,
after a). All rows get a global position by (conversation, turn) and are dealt in blocks of about the square
root of their number, so that a block is one bounded group, whatever the conversations' lengths:

1. each block tells, for the conversations that cross its edges, the costs from entry to exit state (4 x 4);
2. for each such conversation a backward pass over its blocks (as many as the square root at most)
   stores the state-cost vector at each block's end: the checkpoints, and the only vectors ever stored;
3. each block recomputes its own vectors from its checkpoint and walks forward from every entry
   state, which gives exit states; a pass over the blocks chains them to the entry states;
4. each block recomputes its vectors once more and walks forward from its entry state, emitting the edits.

Texts take part in none of this: blocks see an initial and a fault for each row. A conversation's digest (:func:`digests`)
reads its repaired rows in order as a stream, holding a hash state and the edit letters.

Defined results: a null role or text is one space, a null id is a conversation of its own, null turns come
first; rows of one turn are ordered by the MD5 of ``role:text``, so ties and repeated rows have one order; equal
rows are duplicates; an initial is a role's first character (none if empty), and only s, u and a can
be kept; other columns are ignored; an empty table gives an empty result. Faults: blank (no
``[^\\x20\\x09-\\x0D]``), else duplicate (role and text stand earlier in the conversation), else truncated
(last such character is not one of ``.!?``).
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_position
from .common import materialize, ship_package

#: Fewest rows of a block.
LEAST_BLOCK = 4096
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
INF = 1 << 60
# fixed values: the automaton of (s?(ua)+)?
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # state -> initial -> next state
ROLE = ("user", "user", "assistant", "user")             # the role that a state asks for
GOES = (2, 2, 3, 2)                                      # where it leads
END = [0, 4, 2, 0]                                       # cost of the inserts that finish from each state


def before_row(after: list[int], initial: str, fault: int) -> list[int]:
    """State costs before a row from those after it."""
    w = []
    for s in range(4):
        best = 3 + after[s]
        if fault not in (BLANK, DUPLICATE):
            stay = 1 if fault == TRUNCATED else 0
            best = min(best, 2 + stay + after[GOES[s]])
            to = KEEP[s].get(initial)
            if to is not None:
                best = min(best, stay + after[to])
        w.append(best)
    return [min(w[s], 2 + w[GOES[s]], 4 + w[GOES[GOES[s]]], INF) for s in range(4)]


def backward(rows: list[tuple[str, int]], end: list[int]) -> list[list[int]]:
    """State costs before each row, and at the end."""
    out = [end]
    for initial, fault in reversed(rows):
        out.append(before_row(out[-1], initial, fault))
    return out[::-1]


def transfer(rows: list[tuple[str, int]]) -> list[int]:
    """Cost from each entry state to each exit state, row by row of the matrix."""
    cols = [backward(rows, [0 if t == e else INF for t in range(4)])[0] for e in range(4)]
    return [min(cols[e][s], INF) for s in range(4) for e in range(4)]


def walk(rows: list[tuple[str, int]], cost: list[list[int]], state: int, last: bool) -> tuple[int, list[tuple[int, int, str, str | None]]]:
    """The ASCII-least cheapest edits from ``state``: the exit state and (row, k, letter, role given).

    ``k`` orders edits at one row: inserts before it are negative, those after the last row positive."""
    out = []
    n = len(rows)
    i = k = 0
    while i < n or (last and cost[i][state]):
        here = cost[i][state]
        if i < n:
            initial, fault = rows[i]
            if 3 + cost[i + 1][state] == here:
                out.append((i, 0, "D", None))
                i, k = i + 1, 0
                continue
        if 2 + cost[i][GOES[state]] == here:
            k += 1
            out.append((i, k - 9, "I", ROLE[state]) if i < n else (n - 1, k, "I", ROLE[state]))
            state = GOES[state]
            continue
        stay = 1 if fault == TRUNCATED else 0
        to = KEEP[state].get(initial)
        if to is not None and stay + cost[i + 1][to] == here:
            out.append((i, 0, "K", None))
            state = to
        else:
            out.append((i, 0, "R", ROLE[state]))
            state = GOES[state]
        i, k = i + 1, 0
    return state, out


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with every 20th row dropped, emptied, cut, repeated or given to the user, by the hash of its place."""
    h = damage_kind()
    text = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    t = turns.select("conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(_text("role")).alias("role"),
                     text.alias("text"), F.array_repeat(F.lit(0), copies).alias("__copies"))
    return t.select("conv_id", "turn", "role", "text", F.explode("__copies")).drop("col")


def damage_kind() -> Column:
    return F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20


def conversation_key(id_col: str = "conv_id") -> Column:
    """Text that names a conversation, null included."""
    return F.coalesce(F.concat(F.lit("c"), F.col(id_col).cast("string")), F.lit("null"))


def _segments(pdf: pd.DataFrame) -> list[tuple[str, int, int]]:
    """Runs of one conversation in a block sorted by position: key, start, end."""
    key = pdf["ck"].tolist()
    cut = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
    return [(key[a], a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _rows(pdf: pd.DataFrame) -> list[tuple[str, int]]:
    return list(zip(pdf["initial"].tolist(), pdf["fault"].tolist(), strict=True))


_T = [f"t{i}" for i in range(16)]
_V = [f"v{i}" for i in range(4)]
_X = [f"x{i}" for i in range(4)]


def _longs(names) -> str:
    return ", ".join(f"{n} long" for n in names)


def _edge_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1: first and last conversation of a block."""
    pdf = pdf.sort_values("g")
    rows, blk = _rows(pdf), int(pdf["blk"].iloc[0])
    seg = _segments(pdf)
    out = [(k, blk, *transfer(rows[a:b])) for k, a, b in ({seg[0], seg[-1]})]
    return pd.DataFrame(out, columns=["ck", "blk", *_T])


def _checkpoints(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2: vectors at the ends of a conversation's blocks."""
    pdf = pdf.sort_values("blk", ascending=False)
    v, out = END, []
    for r in pdf[["blk", *_T]].itertuples(index=False):
        out.append((int(r[0]), *v))
        t = r[1:]
        v = [min(min(int(t[4 * s + e]) + v[e] for e in range(4)), INF) for s in range(4)]
    d = pd.DataFrame(out, columns=["blk", *_V])
    d.insert(0, "ck", pdf["ck"].iloc[0])
    return d


def _edge_exits(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Step 3: exit state for each entry state."""
    out = []
    if len(edges):
        pdf = pdf.sort_values("g")
        rows, at = _rows(pdf), {k: (a, b) for k, a, b in _segments(pdf)}
        for r in edges.itertuples(index=False):
            a, b = at[r.ck]
            cost = backward(rows[a:b], [int(getattr(r, v)) for v in _V])
            out.append((r.ck, int(r.blk), *[walk(rows[a:b], cost, s, False)[0] for s in range(4)], *[int(getattr(r, v)) for v in _V]))
    return pd.DataFrame(out, columns=["ck", "blk", *_X, *_V])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 3: the entry state of each of a conversation's blocks."""
    pdf = pdf.sort_values("blk")
    state, entry = 0, []
    for x in pdf[_X].itertuples(index=False):
        entry.append(state)
        state = int(x[state])
    return pdf[["ck", "blk", *_V]].assign(entry=entry, last=[False] * (len(entry) - 1) + [True])


def _walk_block(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Step 4: the edits of a block's rows."""
    if not len(pdf):
        return pd.DataFrame(columns=["g", "k", "ck", "edit", "given", "initial", "fault"])
    pdf = pdf.sort_values("g")
    rows, g = _rows(pdf), pdf["g"].tolist()
    known = {r.ck: (int(r.entry), bool(r.last), [int(getattr(r, v)) for v in _V]) for r in edges.itertuples(index=False)}
    out = []
    for key, a, b in _segments(pdf):
        entry, last, end = known.get(key, (0, True, END))
        part = rows[a:b]
        for i, k, letter, role in walk(part, backward(part, end), entry, last)[1]:
            initial, fault = part[i] if k == 0 else ("", 0)
            out.append((g[a + i], k, key, letter, role, initial, fault))
    return pd.DataFrame(out, columns=["g", "k", "ck", "edit", "given", "initial", "fault"])


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block_rows: int | None = None) -> DataFrame:
    """Every edit with its row: (ck, g, k, edit, fault, initial, role, text); (g, k) is the order.

    ``ck`` is :func:`conversation_key`; ``role`` and ``text`` are those after the edit (a deleted row keeps its own);
    an insert has an empty text. The repaired conversation is all rows but those with edit ``D``."""
    ship_package(turns.sparkSession)
    role, text = _text(role_col), _text(text_col)
    t = turns.select(conversation_key(id_col).alias("ck"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                     F.md5(F.concat(role, F.lit(":"), text)).alias("md5"), F.monotonically_increasing_id().alias("salt"))
    # equal rows may stand in any order among themselves; the salt splits a hot one over ranges
    t = with_position(materialize(t), [F.col("ck"), F.col("turn").asc_nulls_first(), "md5", "salt"], "g")
    t = materialize(t.drop("salt", "turn"))
    n = t.count()
    block = block_rows or max(LEAST_BLOCK, math.isqrt(n))

    said = "[^\\x20\\x09-\\x0D]"
    codes = t.select("g", "ck", "md5", F.substring("role", 1, 1).alias("initial"),
                     (~F.col("text").rlike(said)).alias("blank"),
                     (~F.regexp_extract("text", f"({said})[\\x20\\x09-\\x0D]*\\z", 1).isin(".", "!", "?")).alias("cut"))
    first = codes.groupBy("ck", "md5").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    codes = codes.join(first, "g", "left").select(
        F.floor(F.col("g") / block).cast("long").alias("blk"), "g", "ck", "initial",
        F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0).alias("fault"))
    codes = materialize(codes)

    by_block = codes.groupBy("blk")
    edges = by_block.applyInPandas(_edge_costs, f"ck string, blk long, {_longs(_T)}")
    marks = edges.groupBy("ck").applyInPandas(_checkpoints, f"ck string, blk long, {_longs(_V)}")
    marks = materialize(marks)
    exits = by_block.cogroup(marks.groupBy("blk")).applyInPandas(_edge_exits, f"ck string, blk long, {_longs(_X)}, {_longs(_V)}")
    entries = materialize(exits.groupBy("ck").applyInPandas(_entries, f"ck string, blk long, {_longs(_V)}, entry long, last boolean"))
    edits = by_block.cogroup(entries.groupBy("blk")).applyInPandas(
        _walk_block, "g long, k int, ck string, edit string, given string, initial string, fault int")
    # an insert takes its row's position but none of its text
    own = edits.join(t.select("g", "role", "text"), "g")
    return own.select("ck", "g", "k", "edit", "fault", "initial", F.coalesce("given", "role").alias("role"),
                      F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


_DIGEST = pa.schema([("ck", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                     ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Reading:
    """What is held of a conversation while its edits go by."""

    def __init__(self, key):
        self.key, self.faults, self.illegal, self.cost = key, [0, 0, 0, 0], 0, 0
        self.before, self.audit, self.sha, self.empty = None, [], hashlib.sha256(), True

    def take(self, edit, fault, initial, role, text):
        self.audit.append(edit)
        self.cost += {"K": 0, "R": 2, "I": 2, "D": 3}[edit] + (fault == TRUNCATED and edit != "D")
        if edit != "I":
            self.faults[fault] += 1
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
        if edit != "D":
            self.sha.update((("" if self.empty else "\n") + role + ":" + text).encode())
            self.empty = False

    def row(self):
        return (self.key, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _read(batches):
    now = None
    for b in batches:
        done = []
        for key, *edit in zip(*[b.column(c).to_pylist() for c in ("ck", "edit", "fault", "initial", "role", "text")], strict=True):
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.row())
                now = _Reading(key)
            now.take(*edit)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.row(), _DIGEST, strict=True)], schema=_DIGEST)


def digests(edits: DataFrame) -> DataFrame:
    """(ck, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with an edit.

    A conversation's edits are one value and its digest is over its whole text, so they pass through one
    task in order, as a stream."""
    ship_package(edits.sparkSession)
    e = edits.repartition("ck").sortWithinPartitions("ck", "g", "k")
    return e.mapInArrow(_read, "ck string, blank long, duplicate long, truncated long, illegal long, cost long, "
                               "audit string, repaired_sha256 string")
