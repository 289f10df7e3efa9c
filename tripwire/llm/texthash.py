"""Vectorised hashing of words and shingles over Arrow string columns (runs inside tasks).

A column's UTF-8 bytes are cut into slices of whole texts, and every step works on a slice
at once: byte classes, word bounds, a polynomial hash per word (wrapping 64 bits, finished
with an avalanche), and hashes of word sequences. Texts are read whole; memory follows the
longest text of a slice, about 60 bytes per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_STEP = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection), so that any bits of the result may be used."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; kept between slices."""
    global _pow, _inv
    if len(_pow) <= n:
        with np.errstate(over="ignore"):
            _pow, _inv = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)
                          for b in (_BASE, _INV))
    return _pow, _inv


@dataclass
class Slice:
    """Some whole texts: their bytes, and where each begins (one offset more than texts)."""
    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null counts as empty) into slices of about ``most`` bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(col))
        yield Slice(i, data[off[i]:off[j]], off[i:j + 1] - off[i])
        i = j


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = the hash of bytes i..j, scaled by base ** i."""
    power, _ = _powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[:len(data)], dtype=np.uint64, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end of each span, wherever it stands."""
    _, inv = _powers(len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * _STEP)


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one kind > 0, none across two texts."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offsets] = True
    at = np.flatnonzero(cut)
    on = kind[at[:-1]] > 0
    return at[:-1][on], at[1:][on]


@dataclass
class Words:
    hashes: np.ndarray   # uint64, one per word
    text: np.ndarray     # which text of the slice
    counts: np.ndarray   # words of each text


def words(s: Slice) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice, A-Z lower-cased."""
    start, end = runs((~SPACE[s.data]).astype(np.int8), s.offsets)
    h = span_hash(prefix_hash(s.data, _LOWER_BYTE), start, end)
    text = np.searchsorted(s.offsets, start, "right") - 1
    return Words(h, text, np.bincount(text, minlength=s.n))


def sequence_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes."""
    out = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _BASE + h[i:len(h) - n + 1 + i]
    return mix(out + _U(n * int(_STEP) % (1 << 64)))


def shingle_sets(s: Slice, n: int) -> list[np.ndarray]:
    """For each text, its sorted distinct n-word shingles; with fewer words the whole sequence is one."""
    w = words(s)
    ends = np.cumsum(w.counts)
    seq = sequence_hash(w.hashes, n) if len(w.hashes) >= n else np.zeros(0, np.uint64)
    out = []
    for c, e in zip(w.counts.tolist(), ends.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(seq[e - c:e - n + 1]))
        elif c:
            out.append(sequence_hash(w.hashes[e - c:e], c))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
