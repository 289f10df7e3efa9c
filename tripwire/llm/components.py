"""Connected components of a link table, by alternating large-star and small-star passes.

Each pass is a ``groupBy`` (with map-side minima) and a join on a node. The links of a hub are dealt over
SALTS keys for that join, so that no task gets them all (:func:`with_minimum`). Passes are written to the shared
folder, so a lost executor replays one pass. Links are first thinned to a spanning forest
inside each partition (linear memory), which shortens long chains.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, ship_package


#: Keys over which a hub's links are dealt, and the share and least number of links that make a node a hub.
SALTS, HUB_SHARE, HUB_LINKS = 64, 1024, 200


class Forest:
    """Disjoint sets over the nodes seen so far; the root is the smallest node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = up.setdefault(x, x)
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.fromiter(self.up, np.int64, len(self.up))
        root = np.fromiter((self.root(int(x)) for x in child), np.int64, len(child))
        keep = child != root
        return child[keep], root[keep]


def _thin(parts):
    f = Forest()
    for p in parts:
        for a, b in zip(p["u"].tolist(), p["v"].tolist(), strict=True):
            f.join(a, b)
    u, v = f.links()
    yield pd.DataFrame({"u": u, "v": v})
    del f
    give_back()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def with_minimum(links: DataFrame, low: DataFrame, n_links: int) -> DataFrame:
    """``links`` (u, v) with the minimum ``m`` of u, from ``low`` (u, m, n: its number of links).

    A hub has over HUB_LINKS links and over 1 / HUB_SHARE of all ``n_links``, so that there are fewer than HUB_SHARE:
    their list is broadcast, and their links are joined by node and salt.
    """
    is_hub = F.col("n") > max(HUB_LINKS, n_links // HUB_SHARE)
    hubs = F.broadcast(low.where(is_hub).select("u", F.lit(True).alias("hub")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)) + 1).otherwise(0)
    dealt = links.join(hubs, "u", "left").select("u", "v", salt.cast("int").alias("salt"))
    salts = F.when(is_hub, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    return dealt.join(low.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link to another; component = its smallest node.

    Nodes are longs. Self-links, nulls and repeated links are ignored; an empty table gives an
    empty result. Raises if the passes have not settled after ``most_rounds``.
    """
    ship_package(links.sparkSession)
    e = (links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
         .where("u is not null and v is not null and u <> v"))
    e = materialize(e.mapInPandas(_thin, "u long, v long"))  # (node, smaller root)
    seen = _state(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = F.count(F.lit(1)).alias("n")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), n)
        large = with_minimum(both.where("v > u"), low, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        # small-star: every link points from the larger to the smaller node already
        low = large.groupBy("u").agg(F.min("v").alias("m"), n)
        small = with_minimum(large, low, 2 * seen[0]).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        e = materialize(small)
        now = _state(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError("connected components did not settle")
