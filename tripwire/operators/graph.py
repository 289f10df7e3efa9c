"""User-subnet-device graph: weighted edges, a distributed truncated SVD, embedding lookups.

The adjacency matrix is never materialised: it is an edge table ``(src, dst, w)`` (both
directions). The SVD is block subspace iteration: each round multiplies the current basis
by the adjacency with one join + grouped sum (a hub node's edges are split by a salt for the join and
combined on the map side for the sum), then re-orthonormalises with the k x k Gram matrix (on the
driver: only k*k numbers travel; an eigen-decomposition of the Gram keeps it stable when the
graph is rank deficient). A final Rayleigh-Ritz step gives the singular triplets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# fixed values: node name prefixes
USER_P, SUB_P, DEV_P = "USER_", "SUB_", "DEV_"


def node_columns(df: DataFrame) -> DataFrame:
    return df.select("*", F.concat(F.lit(USER_P), F.col("user_id").cast("string")).alias("user_node"),
                     F.concat(F.lit(SUB_P), F.col("subnet")).alias("sub_node"),
                     F.concat(F.lit(DEV_P), F.col("device")).alias("dev_node"))


def tripartite_edges(df: DataFrame) -> DataFrame:
    """Undirected edges user-subnet, user-device, subnet-device weighted by event count."""
    x = node_columns(df)
    pairs = F.explode(F.array(
        F.struct(F.col("user_node").alias("a"), F.col("sub_node").alias("b")),
        F.struct(F.col("user_node").alias("a"), F.col("dev_node").alias("b")),
        F.struct(F.col("sub_node").alias("a"), F.col("dev_node").alias("b"))))
    e = x.select(pairs.alias("p")).select("p.a", "p.b")
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge (the adjacency as a sparse table)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def _vcols(k):
    return [f"q{i}" for i in range(k)]


#: Edges of one node that one task may hold; a hub with more is split by a salt.
HUB_EDGES = 100_000


def _split_hubs(adj: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The adjacency with a salt, and (node, parts) of the hubs: at most edges / ``most`` of them."""
    hubs = materialize(adj.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
                       .select(F.col("dst").alias("hub"), F.ceil(F.col("n") / F.lit(most)).cast("long").alias("parts")))
    small = F.broadcast(hubs) if hubs.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else hubs
    x = adj.join(small, adj["dst"] == F.col("hub"), "left")
    salt = F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1)))
    return materialize(x.select("src", "dst", "weight", salt.alias("salt"))), hubs


def _multiply(adj: DataFrame, hubs: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Y = A Q as (node, q0..q(k-1)): a hub's row of Q goes to each of its parts, its sums are combined on the map side."""
    small = F.broadcast(hubs) if hubs.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else hubs
    q = q.join(small, q["node"] == F.col("hub"), "left").select(
        q["node"], *_vcols(k), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    j = adj.join(q, (adj["dst"] == q["node"]) & (adj["salt"] == q["salt"]))
    return j.groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in _vcols(k)])


def _products(y: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sum over the rows of left x right: numpy inside the tasks, the partial matrices added by position in a shuffle, so that only
    one number per position reaches the driver."""
    n, m = len(left), len(right)

    def part(batches):
        g = np.zeros((n, m))
        for pdf in batches:
            g += pdf[left].to_numpy(dtype=float).T @ pdf[right].to_numpy(dtype=float)
        yield pd.DataFrame({"i": np.arange(n * m), "g": g.ravel()})

    cols = list(dict.fromkeys([*left, *right]))
    rows = y.select(*cols).mapInPandas(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(n * m)
    for r in rows:
        out[r["i"]] = r["g"]
    return out.reshape(n, m)


def _apply(y: DataFrame, m: np.ndarray, k_out: int, k_in: int) -> DataFrame:
    """Rows times a small matrix (numpy inside the tasks; the matrix travels in the closure)."""
    cin, cout = _vcols(k_in), _vcols(k_out)
    mm = np.asarray(m, dtype=float)

    def part(batches):
        for pdf in batches:
            out = pdf[cin].to_numpy(dtype=float) @ mm
            res = pd.DataFrame(out, columns=cout)
            res.insert(0, "node", pdf["node"].values)
            yield res

    schema = "node string, " + ", ".join(f"{c} double" for c in cout)
    return y.select("node", *cin).mapInPandas(part, schema)


def graph_svd_fit(edges: DataFrame, k: int = 16, oversample: int = 8, iterations: int = 12,
                  seed: int = 7, hub_edges: int = HUB_EDGES) -> tuple[DataFrame, np.ndarray]:
    """Top-k singular vectors of the symmetric weighted adjacency. Returns (node, vec) with
    vec = u * sqrt(s) sorted by singular value, and the singular values."""
    adj, hubs = _split_hubs(materialize(symmetric(edges)), hub_edges)
    b = k + oversample
    nodes = adj.select(F.col("src").alias("node")).distinct()
    # deterministic start: a hash of (node, column) mapped to [-1, 1)
    q = nodes.select("node", *[((F.abs(F.xxhash64("node", F.lit(seed * 1000 + i))) % 2000000) / 1e6 - 1.0)
                               .alias(f"q{i}") for i in range(b)])
    q = materialize(q)
    for it in range(iterations):
        # Y is read twice (Gram, then the update): write it once, so no round recomputes the chain
        y = materialize(_multiply(adj, hubs, q, b))
        d, v = np.linalg.eigh(_products(y, _vcols(b), _vcols(b)))
        # Y V D^-1/2: orthonormal columns; near-null directions are kept but not blown up
        q = _apply(y, v / np.sqrt(np.maximum(d, d.max() * 1e-14)), b, b)
    # Rayleigh-Ritz on the generalized problem (Q^T A Q) x = lambda (Q^T Q) x, restricted to the
    # well-conditioned part of Q^T Q, then keep the k largest |eigenvalues|
    q = materialize(q)
    cs = _vcols(b)
    aq = _multiply(adj, hubs, q, b).select("node", *[F.col(c).alias(f"a{c}") for c in cs])
    j = materialize(aq.join(q, "node"))
    bm = _products(j, [f"a{c}" for c in cs], cs)
    bm, mm = (bm + bm.T) / 2, _products(j, cs, cs)
    dm, vm = np.linalg.eigh(mm)
    keep = dm > dm.max() * 1e-10
    w = vm[:, keep] / np.sqrt(dm[keep])
    lam, u = np.linalg.eigh(w.T @ bm @ w)
    order = np.argsort(-np.abs(lam))[:k]
    s = np.abs(lam[order])
    rot = (w @ u[:, order]) * np.sqrt(s)[None, :]
    emb = _apply(q, rot, k, b)
    return emb.select("node", F.array(*[F.col(f"q{i}") for i in range(k)]).alias("vec")), s


#: Vectors of one node type that may be broadcast.
BROADCAST_NODES = 50_000


def embedding_columns(k: int = 16) -> list[str]:
    """Names of the flat embedding inputs: k components for each of three nodes, three cosines, three flags."""
    return [f"{r}_v_{i}" for r in ("user", "sub", "dev") for i in range(k)] + [
        "sim_user_sub", "sim_user_dev", "sim_sub_dev", "user_missing", "sub_missing", "dev_missing"]


def flat_embeddings(df: DataFrame, vectors: DataFrame, k: int = 16, node_key=None) -> DataFrame:
    """``df`` with all ``embedding_columns(k)``."""
    x = embedding_features(df, vectors, k, node_key)
    flat = [F.col(f"{r}_vec")[i].alias(f"{r}_v_{i}") for r in ("user", "sub", "dev") for i in range(k)]
    return x.select(*df.columns, *flat, *embedding_columns(k)[3 * k:])


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def embedding_features(df: DataFrame, vectors: DataFrame, dim: int, node_key=None) -> DataFrame:
    """Three left lookups (user, subnet, device node) of ``vectors`` (node, vec); a missing node
    gets a zero vector and a flag; cosines between the three (0 when a norm is 0).

    ``node_key`` maps a node name column to the join key of ``vectors`` (default: the name)."""
    x = node_columns(df)
    key = node_key or (lambda c: c)
    zero = F.array_repeat(F.lit(0.0), dim)
    for role, col in (("user", "user_node"), ("sub", "sub_node"), ("dev", "dev_node")):
        v = vectors.select(F.col("node").alias(f"_{role}_k"),
                           F.transform("vec", lambda e: e.cast("double")).alias(f"_{role}_v"))
        if node_key is None:
            v = v.where(F.col(f"_{role}_k").startswith(f"{role.upper()}_"))
        # subnets and devices are few and busy: broadcast them if a count shows it, so that hub events stay where they are
        if role != "user" and v.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
            v = F.broadcast(v)
        x = x.join(v, key(F.col(col)) == F.col(f"_{role}_k"), "left")
        x = x.select("*", F.col(f"_{role}_v").isNull().cast("int").alias(f"{role}_missing"),
                     F.coalesce(F.col(f"_{role}_v"), zero).alias(f"{role}_vec")).drop(f"_{role}_v", f"_{role}_k")

    def cos(a, b):
        n = F.sqrt(_dot(F.col(a), F.col(a))) * F.sqrt(_dot(F.col(b), F.col(b)))
        return F.when(n > 0, _dot(F.col(a), F.col(b)) / n).otherwise(F.lit(0.0))

    return x.select("*", cos("user_vec", "sub_vec").alias("sim_user_sub"), cos("user_vec", "dev_vec").alias("sim_user_dev"),
                    cos("sub_vec", "dev_vec").alias("sim_sub_dev"))
