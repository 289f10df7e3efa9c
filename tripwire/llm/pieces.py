"""SentencePiece encoding and decoding through a table of distinct chunks.

The library turns a text into one marked string: a leading marker, and a marker for every space.
If no piece of the model has a marker after another character (checked when the model is
opened), pieces cannot cross from one marked word into the next, so the marked string falls into
chunks ``markers + characters`` that are segmented independently. Every task keeps a table of
the distinct chunks it has met: each is segmented once, by the library, and a text's ids are
the table's entries joined back by position. Decoding joins the decoded chunks in the same way.

The table is local to a task and starts afresh beyond ``TABLE_ROWS`` chunks: one table for the
whole corpus would have to shuffle every word of every text. Nothing is shuffled here at all.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty
text; rows are independent, so repeated rows and ids give repeated rows; texts are whole,
however long; an empty table gives an empty result. A model whose pieces do cross markers is
still right: its chunk is the whole text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, give_back, ship_package

MARK = "▁"
TABLE_ROWS = 100_000
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


class ChunkTable:
    """Distinct chunks with their ids (as decimal text) and their decoded text."""

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        crossing = any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())
                       if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.cut = (re.compile("(?s).+") if crossing else re.compile(f"{MARK}+[^{MARK}]*")).findall
        self.anchor = sp.encode("a")
        self.skip = len(sp.decode(self.anchor))
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, rows: list[str]) -> None:
        if len(self.ids) + len(rows) > TABLE_ROWS:
            self.ids.clear()
            self.text.clear()
        # the library puts a marker in front, which the chunk has already
        coded = self.sp.encode([c[1:] for c in rows], num_threads=1)
        coded = [i if len(c) > 1 else [self.sp.piece_to_id(MARK)] for c, i in zip(rows, coded, strict=True)]
        plain = self.sp.decode([self.anchor + i for i in coded], num_threads=1)
        for c, i, t in zip(rows, coded, plain, strict=True):
            self.ids[c] = ",".join(map(str, i))
            self.text[c] = t[self.skip:]

    def run(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Joined decimal ids, and the decoded text, of each text."""
        cut = [self.chunks(t) for t in texts]
        need = {c for x in cut for c in x}
        if new := [c for c in need if c not in self.ids]:
            # beyond its size the table starts afresh
            self.learn(new if len(self.ids) + len(new) <= TABLE_ROWS else list(need))
        ids, text = self.ids, self.text
        # decoding drops the marker in front of the text
        return [",".join([ids[c] for c in x]) for x in cut], ["".join([text[c] for c in x])[1:] for x in cut]


_tables: dict[str, ChunkTable] = {}


def _table(model: bytes) -> ChunkTable:
    key = hashlib.sha256(model).hexdigest()
    if key not in _tables:
        _tables[key] = ChunkTable(model)
    return _tables[key]


def _numbers(joined: str) -> np.ndarray:
    return np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``keep`` columns of ``docs`` and, for every row, the ``outputs`` (see OUTPUTS) of its whole text."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: fixed size

    def rows(b: pa.RecordBatch, table: ChunkTable):
        texts = b.column(b.num_columns - 1).to_pylist()
        for i in range(0, len(texts), 256):
            ids, plain = table.run([t or "" for t in texts[i:i + 256]])
            made = {
                "n_tokens": lambda: pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                "ids": lambda: pa.array([_numbers(x) for x in ids], pa.list_(pa.int32())),
                "ids_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                "decoded": lambda: pa.array(plain, pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain]),
            }
            part = b.slice(i, 256)
            yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keep))), *(made[o]() for o in outputs)],
                                             names=[*keep, *outputs])

    def run(batches):
        table = ChunkTable(shared.value)  # a task's own: an idle worker keeps none of it
        for b in batches:
            if b.num_rows:
                yield from rows(b, table)
        del table
        give_back()

    src = docs.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"`{o}` {OUTPUTS[o]}" for o in outputs]
    ship_package(docs.sparkSession)
    return src.mapInArrow(run, ", ".join(fields))


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the library's decoding of each row's ids (null: empty)."""
    with open(model_path, "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())

    def rows(b: pa.RecordBatch):
        sp = _table(shared.value).sp
        text = sp.decode([x or [] for x in b.column(b.num_columns - 1).to_pylist()], num_threads=1)
        yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(keep))), pa.array(text, pa.string())],
                                         names=[*keep, "decoded"])

    src = coded.select(*(F.col(c) for c in keep), F.col(ids_col).alias("__ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["decoded string"]
    return arrow_map(src, rows, ", ".join(fields))
