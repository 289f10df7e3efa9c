"""Hashed sparse text features, a whole slice of texts at a time, and the bounded training sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .texthash import _LOWER_BYTE, Slice, mix, prefix_hash, runs, slices, span_hash

BITS = 20
SLOTS = 1 << BITS
_U = np.uint64

# byte kinds: 0 white space, 1 letters (and all of a multi-byte character), 2 digits, 3 anything else
KIND = np.full(256, 3, np.int8)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_ASCII = np.zeros(256, np.int32)
_ASCII[65:91] = _ASCII[97:123] = 1


def slot(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + _U(salt) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)).astype(np.int32)


def _pairs(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of n tokens of one text."""
    if len(h) < n:
        return h[:0], text[:0]
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = out * _U(0x9E3779B97F4A7C15) + h[i:m + i]
    same = text[:m] == text[n - 1:]
    return out[same], text[:m][same]


def word_ngrams(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, text, tokens of each text): word 1- and 2-grams, and 1- to 3-grams of word shapes.

    Tokens are runs of letters, digits or other marks. A shape is the case of a letter run, the
    marks themselves, or 'digits', and whether the token touches the one before.
    """
    kind = KIND[s.data]
    start, end = runs(kind, s.offsets)
    text = np.searchsorted(s.offsets, start, "right") - 1
    word = span_hash(prefix_hash(s.data, _LOWER_BYTE), start, end)
    k = kind[start].astype(np.int64)
    up, letters = (np.concatenate([[0], np.cumsum(t[s.data])]) for t in (_UPPER, _ASCII))
    up, letters = up[end] - up[start], letters[end] - letters[start]
    case = np.where((up >= 2) & (up == letters), 2, np.where(up > 0, 1, 0))
    shape = np.where(k == 1, case, k + 1).astype(np.uint64)
    shape = np.where(k == 3, word, shape)
    touch = np.zeros(len(start), bool)
    touch[1:] = (start[1:] == end[:-1]) & (text[1:] == text[:-1])
    shape = mix(shape * _U(2) + touch.astype(np.uint64) + _U(77))
    parts = [(slot(word, 1), text), (slot(shape, 2), text)]
    for h, n, salt in ((word, 2, 3), (shape, 2, 4), (shape, 3, 5)):
        h, t = _pairs(h, text, n)
        parts.append((slot(h, salt), t))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.bincount(text, minlength=s.n)


def word_stems(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, text, words of each text): lower-cased words, and their first 4, 5 and 6 bytes."""
    kind = (KIND[s.data] == 1).astype(np.int8)
    start, end = runs(kind, s.offsets)
    text = np.searchsorted(s.offsets, start, "right") - 1
    h = prefix_hash(s.data, _LOWER_BYTE)
    parts = [(slot(span_hash(h, start, end), 1), text)]
    for n in (4, 5, 6):
        long = end - start >= n
        parts.append((slot(span_hash(h, start[long], start[long] + n), n), text[long]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.bincount(text, minlength=s.n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, featurise: Callable, *,
                    use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(y, h, indices, counts, tokens) of at most ``most`` labelled documents, picked by a hash of id and text.

    Ids that are null, unlabelled, or labelled both ways are left out; rows that repeat id and text count once. ``use``
    restricts the labels. Labels meet (id, hash of the text) first, so that all of the ``most`` are rows that exist; only
    the picked pairs (at most ``most``) are broadcast, and texts are never shuffled but for the picked ones.
    """
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if use is not None:
        lab = lab.where(use)
    lab = (lab.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
           .where("y = z").select("__id", F.col("y").cast("int").alias("y")))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text, F.lit(seed)).alias("__t"), text.alias("text"))
    by = F.xxhash64("__id", "__t", F.lit(seed))
    picked = rows.select("__id", "__t").distinct().join(lab, "__id").orderBy(by, "__id", "__t").limit(most)
    rows = rows.join(F.broadcast(materialize(picked)), ["__id", "__t"])
    # copies of a picked row: one stays (combined on the map side)
    rows = rows.groupBy("__id", "__t", "y").agg(F.min("text").alias("text"))
    rows = rows.select("y", F.xxhash64("__id", "__t", F.lit(seed + 1)).alias("h"), "text")

    def make(b: pa.RecordBatch):
        ends, idx, cnt, tok = [0], [], [], []
        with np.errstate(over="ignore"):
            for s in slices(b.column(2)):
                f, t, n = featurise(s)
                key, c = np.unique(t.astype(np.int64) * SLOTS + f, return_counts=True)
                of = np.searchsorted(key, np.arange(s.n + 1) * SLOTS)
                idx.append((key % SLOTS).astype(np.int32))
                cnt.append(c.astype(np.int32))
                ends.extend((ends[-1] + of[1:]).tolist())
                tok.extend(n.tolist())
        off = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.ListArray.from_arrays(off, pa.array(np.concatenate(idx))),
             pa.ListArray.from_arrays(off, pa.array(np.concatenate(cnt))), pa.array(tok, pa.int64())],
            names=["y", "h", "indices", "counts", "tokens"])

    return arrow_map(rows, make, "y int, h long, indices array<int>, counts array<int>, tokens long")


def scores(docs: DataFrame, weights: np.ndarray, featurise: Callable, keep: list[Column], link: Callable, fields: str,
           distinct: bool, text_col: str = "text") -> DataFrame:
    """``keep`` and the columns ``fields`` that ``link(sums, tokens)`` makes of each text's sparse dot product.

    ``distinct``: a feature counts once for a text. A column of ``keep`` named ``text_col`` is the text. The weights are one number for each slot (a fixed size).
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    src = docs.select(*keep)
    kept = src.columns
    if text_col not in kept:  # a kept text is not sent twice
        src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    at = kept.index(text_col) if text_col in kept else len(kept)

    def run(b: pa.RecordBatch):
        w = shared.value
        sums, tokens = [], []
        with np.errstate(over="ignore"):
            for s in slices(b.column(at)):
                f, t, n = featurise(s)
                x = w[f]
                if distinct:
                    on = np.flatnonzero(x)
                    _, one = np.unique(t[on].astype(np.int64) * SLOTS + f[on], return_index=True)
                    t, x = t[on][one], x[on][one]
                sums.append(np.bincount(t, weights=x, minlength=s.n))
                tokens.append(n)
        made = link(np.concatenate(sums), np.concatenate(tokens))
        yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *(pa.array(v) for v in made.values())], names=[*kept, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:len(kept)]] + [fields])
    return arrow_map(src, run, schema)


__all__ = ["BITS", "SLOTS", "labelled_sample", "scores", "word_ngrams", "word_stems"]
