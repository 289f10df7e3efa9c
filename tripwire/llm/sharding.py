"""Sharding by a hierarchical weighted hash tree. DataFrame functions only.

A tree has regions, racks and shards; a leaf has a weight, an inner node the sum of its leaves'. A row
descends from the root: at each node every child draws ``ln(u) / weight`` with u in (0, 1) from a hash
of the row's key and the child's name, and the greatest draw wins. A child is drawn in proportion to its
weight, and its draw depends on nothing but the key, its own name and its own weight.

* Another weight of one shard (:func:`reweighted`) changes the draws on its path alone: a row moves only
  into, out of or within the subtrees on that path; between two other subtrees none moves.
* A new shard (:func:`grown`) is a branch of its own below the root, in a region and rack named
  by its place: the draws of all others stay, so that it takes rows only into itself. This is the law ``key``.

The tree is a literal of the plan (a few bytes a shard), so that placing is a projection without a
shuffle. Slots number the rows of each shard without a gap, in the order of the draw's hash, then key, size
and checksum: a global position by range partitions less the shard's first one. No shard is gathered
anywhere, and rows equal in all these are told apart by a salt, so that a key which a third of all
rows share is still split over tasks (such rows are alike in every result but the slot).

Defined results: a null key is a key of its own; a null text has size 1 and checksum 0; equal keys
go to one shard, whatever their texts; repeated rows are all kept; other columns are ignored; an empty table
gives an empty result; weights of 0 take no rows, and a tree without any weight is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_position
from .common import materialize


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, its place and its weight. ``branch`` tells apart branches added to a region later."""
    number: int
    region: str
    rack: str
    weight: float = 1.0
    branch: str = ""


def standard(n: int, shards_in_rack: int = 4, racks_in_region: int = 2, planned: int = 16) -> list[Shard]:
    """Shards 0 to n - 1: the first ``planned`` in full racks and regions, each later one a branch of its own."""
    def at(s: int) -> Shard:
        rack = s // shards_in_rack
        return Shard(s, f"region{rack // racks_in_region}", f"rack{rack}", branch="" if s < planned else f"+{s}")
    return [at(s) for s in range(n)]


def grown(tree: list[Shard], region: str, rack: str, weight: float = 1.0) -> list[Shard]:
    """One more shard, in a branch of its own."""
    n = 1 + max((s.number for s in tree), default=-1)
    return [*tree, Shard(n, region, rack, weight, f"+{n}")]


def reweighted(tree: list[Shard], number: int, weight: float) -> list[Shard]:
    return [replace(s, weight=weight) if s.number == number else s for s in tree]


def _levels(tree: list[Shard]) -> list[dict[str, dict[str, float]]]:
    """For each level: path of a node -> path of each child -> weight."""
    out: list[dict] = [{}, {}, {}]
    for s in tree:
        if s.weight > 0:
            path = ["", s.region + s.branch, f"{s.region}{s.branch}/{s.rack}", f"{s.region}{s.branch}/{s.rack}/{s.number}"]
            for level in range(3):
                kids = out[level].setdefault(path[level], {})
                kids[path[level + 1]] = kids.get(path[level + 1], 0.0) + s.weight
    if not out[0]:
        raise ValueError("no shard has a weight")
    return out


def _draw(key: Column, name: Column) -> Column:
    """u in (0, 1): 52 bits of a hash of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), name)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key. The text of the key decides, null being a key of its own."""
    k = key_text(key)
    node = F.lit("")
    for kids in _levels(tree):
        listed = F.create_map(*[x for path, c in kids.items() for x in (F.lit(path), F.array(*[
            F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w")) for n, w in sorted(c.items())]))])
        drawn = F.transform(F.element_at(listed, node), lambda c: F.struct(
            (F.ln(_draw(k, c["name"])) / c["w"]).alias("draw"), c["name"].alias("name")))
        node = F.array_max(drawn)["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def key_text(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def shards(docs: DataFrame, tree: list[Shard], larger: list[Shard] | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every row; ``grown_shard`` is its place in ``larger``."""
    text = F.col(text_col).cast("string")
    key = F.col(id_col)
    rows = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        place(key, tree).alias("shard"),
        (place(key, larger) if larger else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(key_text(key)).alias("__h"), F.monotonically_increasing_id().alias("__salt"))
    rows = materialize(rows)  # texts are read once; what follows is narrow
    order = ["shard", "__h", id_col, "size", "text_crc32", "__salt"]
    placed = with_position(rows, order, "__pos")
    first = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("__n"))
    # one row per shard: how many rows the shards before it hold
    counts = sorted((r["shard"], r["__n"]) for r in first.collect())
    starts, total = [], 0
    for s, n in counts:
        starts += [F.lit(s), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*starts), F.col("shard")) if starts else F.lit(0)
    return placed.select(id_col, "size", "text_crc32", "shard",
                         (F.col("__pos") - start).cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, tree: list[Shard], path: str, id_col: str = "doc_id", files_in_shard: int = 8) -> None:
    """Write every row whole into the folder ``shard=<n>`` of its shard, a shard in several files."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_in_shard))
    out = docs.withColumn("shard", place(F.col(id_col), tree)).withColumn("__salt", salt)
    out.repartition("shard", "__salt").drop("__salt").write.mode("overwrite").partitionBy("shard").parquet(path)
