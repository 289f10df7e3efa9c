"""Chat formatting with prefix-target expansion. DataFrame functions only.

A turn is written ``<s>[role]`` + newline + text + ``</s>`` + newline. In roles and texts ``&``, ``<`` and ``[``
become ``&amp;``, ``&lt;`` and ``&lbr;`` (and in roles ``]`` and newline ``&rbr;`` and ``&nl;``), so that no
control string, of this template or of others, can stand inside a text, and :func:`unescape` gives it back.

Every assistant turn becomes an example of its own: all turns up to it as context, and only that
reply (its escaped text, without the marks) trainable, as the character span ``loss_start,
loss_end`` of the example. A conversation whose last turn is no assistant's, or that has none, gets
one more example with all turns and nothing trainable, so that no turn is lost.

An example repeats the turns before it, so a conversation of n turns is written about n / 2 times;
this is the method. The conversation itself is one value (its whole formatted text), as its
digests are over the whole text.

Defined results: a null text is empty; a null role is an empty role and not trainable; turns are
ordered by turn (nulls first), then role, then text, so that ties and repeated rows (all kept)
have one order; rows with a null conversation id form one conversation; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_TEXT = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"))
_ROLE = (*_TEXT, ("]", "&rbr;"), ("\n", "&nl;"))


def escape(c: Column, table=_TEXT) -> Column:
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, table=_TEXT) -> Column:
    for a, b in reversed(table):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(id, parts): the turns of each conversation in order, escaped and marked, with their places.

    A part is (role, head, body, start, end): ``start`` and ``end`` bound the body in the formatted text (code points)."""
    t = turns.select(F.col(id_col).alias(id_col), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    g = t.groupBy(id_col).agg(F.array_sort(F.collect_list("t")).alias("t"))
    made = F.transform("t", lambda x: F.struct(
        x["role"].alias("role"), F.concat(F.lit("<s>["), escape(x["role"], _ROLE), F.lit("]\n")).alias("head"),
        escape(x["text"]).alias("body")))
    g = g.select(id_col, made.alias("p"))
    # where each body ends: running lengths (head, body, and five characters of closing marks)
    ends = F.aggregate("p", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(
        F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
        + (F.length(x["head"]) + F.length(x["body"]) + 5).cast("long"))))
    g = g.select(id_col, "p", ends.alias("e"))
    return g.select(id_col, F.zip_with("p", "e", lambda x, e: F.struct(
        x["role"].alias("role"), x["head"].alias("head"), x["body"].alias("body"),
        (e - 5 - F.length(x["body"])).alias("start"), (e - 5).alias("end"))).alias("parts"))


def examples(turns: DataFrame, id_col: str = "conv_id", assistant: str = ASSISTANT, **cols) -> DataFrame:
    """(id, example, n_turns, text, loss_start, loss_end); a null loss span: nothing trainable."""
    c = conversations(turns, id_col, **cols)
    whole = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("</s>\n"))), "")
    c = c.select(id_col, whole.alias("all"), F.transform("parts", lambda x: F.struct(
        x["role"].alias("role"), x["start"].alias("start"), x["end"].alias("end"))).alias("parts"))
    at = F.transform("parts", lambda x, i: F.struct((i + 1).alias("n"), x["role"].alias("role"), x["start"].alias("start"), x["end"].alias("end")))
    n = F.size("parts")
    pick = F.filter(at, lambda x: (x["role"] == assistant) | (x["n"] == n))
    e = c.select(id_col, "all", F.posexplode(pick).alias("example", "x"))
    trained = F.col("x.role") == assistant
    return e.select(id_col, "example", F.col("x.n").cast("long").alias("n_turns"),
                    F.substring(F.col("all"), F.lit(1), (F.col("x.end") + 5).cast("int")).alias("text"),
                    F.when(trained, F.col("x.start")).alias("loss_start"), F.when(trained, F.col("x.end")).alias("loss_end"))


def turns_of(text: Column) -> Column:
    """Read the turns (role, text) back from a formatted text."""
    parts = F.filter(F.split(text, "</s>\n", -1), lambda x: F.length(x) > 0)
    cut = F.transform(parts, lambda x: F.struct(F.locate("]\n", x).alias("k"), x.alias("x")))
    return F.transform(cut, lambda c: F.struct(
        unescape(F.substring(c["x"], F.lit(5), c["k"] - 5), _ROLE).alias("role"),
        unescape(F.substring(c["x"], c["k"] + 2, F.length(c["x"]))).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text, unescaped; empty without a span."""
    return F.when(start.isNull(), "").otherwise(unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))))


def digests(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: turns and digests of all turns and of all trainable text."""
    last = F.max(F.struct("n_turns", "example", "text"))
    g = made.groupBy(id_col).agg(last.alias("w"), F.array_sort(F.collect_list(F.struct(
        "example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("t")))).alias("l"))
    g = g.select(id_col, F.col("w.text").alias("all"), F.array_join(F.transform("l", lambda x: x["t"]), "").alias("loss"))
    g = g.select(id_col, "all", "loss", turns_of(F.col("all")).alias("t"))
    every = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return g.select(id_col, F.size("t").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("all").cast("long").alias("formatted_chars"))
