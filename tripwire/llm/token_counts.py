"""Edit-aware token counts of a byte-level BPE.

The pre-token pattern glues one space to the word after it, so between two characters that are not
white space a single space always begins a pre-token, whatever stands farther off. At such places a
text falls into segments whose counts simply add up. A document keeps a tree over them: the leaves
hold the characters and tokens of SPAN segments, every node above the sums of FAN nodes.

An edit (start, end, replacement; code points of the old text) can only touch the leaves it
overlaps and those whose bounds have one of their two neighbours inside it. Only these are cut and
counted again; the other leaves are taken over, and sums are renewed from the first changed node
on. A worker counts each distinct segment once (its table starts afresh beyond TABLE_ROWS).

Defined results: a null text is empty and has no tokens; null edits are none; a null start, end or
replacement is 0, the start, or empty; edits are clipped to the text, taken by start, and one that
overlaps an earlier one begins where that ends; repeated rows are counted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SPAN, FAN = 32, 8
TABLE_ROWS = 200_000
_cut = re.compile(r"(?<=\S) (?=\S)").split

TREE = "tree_chars array<int>, tree_tokens array<int>"


class Counter:
    """Token counts of segments, each distinct one encoded once."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """Segments of a text that itself begins at a segment's start."""
        if not text:
            return []
        parts = _cut(text)
        return [parts[0], *(" " + p for p in parts[1:])]

    def counts(self, segments: list[str]) -> np.ndarray:
        known = self.known
        if new := [s for s in set(segments) if s not in known]:
            if len(known) + len(new) > TABLE_ROWS:
                known.clear()
                new = list(set(segments))
            encode = self.encoding.encode_ordinary  # a batch call would make a thread's task of every segment
            known.update((s, len(encode(s))) for s in new)
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each leaf of a text."""
        s = self.segments(text)
        if not s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, len(s), SPAN)
        return np.add.reduceat(np.fromiter(map(len, s), np.int64, len(s)), at), np.add.reduceat(self.counts(s), at)


def levels(leaves: np.ndarray, old: list[np.ndarray] | None = None, keep: int = 0) -> list[np.ndarray]:
    """Sums from the leaves up to the root. Nodes over the first ``keep`` leaves alone are taken from ``old``."""
    out = [leaves]
    while len(out[-1]) > 1:
        keep //= FAN
        below, k = out[-1], len(out)
        kept = old[k][:keep] if old and k < len(old) else below[:0]
        rest = below[len(kept) * FAN:]
        made = np.add.reduceat(rest, np.arange(0, len(rest), FAN)) if len(rest) else rest
        out.append(np.concatenate([kept, made]))
    return out


def cleaned(edits, n: int) -> list[tuple[int, int, str]]:
    """Edits in order, inside the text, none overlapping an earlier one."""
    out, at = [], 0
    for s, e, r in sorted((x[0] or 0, x[1] if x[1] is not None else (x[0] or 0), x[2] or "") for x in edits or ()):
        s, e = max(at, min(max(s, 0), n)), max(at, min(e, n))
        e = max(s, e)
        out.append((s, e, r))
        at = e
    return out


class Document:
    """A text's tree of counts."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.tokens = text, levels(chars), levels(tokens)

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[-1][0]) if len(self.tokens[-1]) else 0

    def edit(self, edits: list[tuple[int, int, str]], counter: Counter) -> int:
        """Apply cleaned edits; returns how many characters were encoded again."""
        if not edits:
            return 0
        starts = np.concatenate([[0], np.cumsum(self.chars[0])])
        n = len(self.chars[0])
        chars, tokens, text, at, again, keep = [], [], [], 0, 0, n
        k = 0
        while k < len(edits):
            # leaves i..j are touched: a bound stays if it and its two neighbours lie outside the edits
            i = max(0, int(np.searchsorted(starts, edits[k][0] - 1, "left")) - 1)
            i = max(at, min(i, n))
            new, pos = [], int(starts[i])
            while True:
                s, e, r = edits[k]
                new += [self.text[pos:s], r]
                pos, k = e, k + 1
                j = min(n, int(np.searchsorted(starts, e + 1, "left")))
                if k == len(edits) or (starts[j] > e and int(np.searchsorted(starts, edits[k][0] - 1, "left")) - 1 >= j):
                    break
            new.append(self.text[pos:int(starts[j])])
            new = "".join(new)
            c, t = counter.leaves(new)
            keep = min(keep, i)
            chars += [self.chars[0][at:i], c]
            tokens += [self.tokens[0][at:i], t]
            text += [self.text[int(starts[at]):int(starts[i])], new]
            again += len(new)
            at = j
        text.append(self.text[int(starts[at]):])
        self.text = "".join(text)
        self.chars = levels(np.concatenate([*chars, self.chars[0][at:]]), self.chars, keep)
        self.tokens = levels(np.concatenate([*tokens, self.tokens[0][at:]]), self.tokens, keep)
        return again


_counters: dict[str, Counter] = {}


def _counter(ranks: bytes, pattern: str) -> Counter:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(ranks, pattern)
    return _counters[key]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: fixed size


def _schema(fields) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]


def count(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and the leaves of the tree, for every whole text."""
    shared = _model(docs, ranks_path)
    src = docs.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("__text"))

    def rows(b: pa.RecordBatch):
        counter = _counter(shared.value, pattern)
        made = [counter.leaves(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.array([int(t.sum()) for _, t in made], pa.int64()),
             *(pa.array([m[i].astype(np.int32) for m in made], pa.list_(pa.int32())) for i in (0, 1))],
            names=[*keep, "n_tokens", "tree_chars", "tree_tokens"])

    return arrow_map(src, rows, ", ".join([*_schema(src.schema.fields[:-1]), "n_tokens long", TREE]))


def recount(counted: DataFrame, ranks_path: str, pattern: str, edits: str | Callable[[str], list], text_col: str = "text",
            keep: tuple[str, ...] = ("doc_id", "n_tokens")) -> DataFrame:
    """Apply edits to counted documents: ``keep``, the edited text and tree, ``n_edits``, ``n_tokens_edited``,
    ``chars_encoded`` (again). ``edits``: a column of arrays of (start, end, text), or a function of the text."""
    shared = _model(counted, ranks_path)
    more = [F.col(edits)] if isinstance(edits, str) else []
    src = counted.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("__text"), "tree_chars", "tree_tokens",
                         *[m.alias("__edits") for m in more])
    k, in_column = len(keep), bool(more)

    def rows(b: pa.RecordBatch):
        counter = _counter(shared.value, pattern)
        given = b.column(k + 3).to_pylist() if in_column else None
        out = []
        for i, (t, c, n) in enumerate(zip(*(b.column(k + j).to_pylist() for j in range(3)), strict=True)):
            doc = Document(t or "", np.array(c or [], np.int64), np.array(n or [], np.int64))
            do = [tuple(x.values()) for x in given[i] or ()] if in_column else edits(doc.text)
            do = cleaned(do, len(doc.text))
            again = doc.edit(do, counter)
            out.append((doc.text, len(do), doc.n_tokens, again, doc.chars[0].astype(np.int32), doc.tokens[0].astype(np.int32)))
        cols = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(list(x), t) for x, t in zip(cols, kinds, strict=True))], names=names)

    names = [*keep, "text_edited", "n_edits", "n_tokens_edited", "chars_encoded", "tree_chars", "tree_tokens"]
    return arrow_map(src, rows, ", ".join([*_schema(src.schema.fields[:k]), "text_edited string, n_edits long, n_tokens_edited long, chars_encoded long", TREE]))


_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PERSONAL = re.compile(rf"""
    (?P<EMAIL>[\w.+-]+@[\w-]+\.[\w.-]*\w)
  | (?P<IP>(?<![\w.]){_BYTE}(?:\.{_BYTE}){{3}}(?![\w]|\.[0-9]))
  | (?P<CARD>(?<![\w+])(?<![0-9][.,-])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?!\w|-[0-9]))
  | (?P<PHONE>(?<!\w)(?:(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-]?[0-9]{{4}}
      |\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{3,4}})(?!\w))""", re.VERBOSE)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a place-holder for each e-mail address, IPv4 address, card number (13 to 19 digits in one, or in
    groups of 4 or of 4, 6 and 5) and phone number (an area code in brackets or 3 digits, or any that begins with +)."""
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in _PERSONAL.finditer(text)]
