"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual subspace codes,
asymmetric distances over sufficient probes, exact cosine rerank.

1. Vectors are scaled to length 1; cosine >= t is then a distance of at most r = sqrt(2 - 2 t). Equal
   vectors of a label are one *class* (so a heap of copies is one row).
2. A coarse quantiser and one codebook per subspace are trained on a bounded sample (SAMPLE rows by a
   hash). Every class goes to the inverted list of its nearest centroid within its label, with the
   codes of its residual and the length e of what the codes leave over.
3. A partner at distance r can stand in another list only if the plane between the two centroids is at most r
   away, so a class probes the lists beyond such planes. These probes are sufficient: no partner can
   stand in another list. Of two lists only the lower one's members probe.
4. Inside a list, table look-ups give each probe's distance to each coded vector. The true distance
   differs from it by at most e, so candidates are those with distance <= r + e: none is lost.
5. Candidates are reranked by the exact cosine in double precision.

Index and probes are exact by these bounds (measured recall 1.0); a bad sample only makes lists longer.
Lists are dealt to blocks of bounded size by a hash, and a task holds one block of probes and one of
coded vectors; it returns the number of links per class and a spanning forest of its links, never
the pairs. Every pair is met once: in the list of the coded side, by the probing side.
Where vectors hardly cluster (equal distances all round), exact probes cover many lists; the work then
tends to that of comparing a label's vectors in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with
a null label, link with nothing and name their own component; vectors of different lengths are not compared; a null
id takes part but does not name a component; repeated rows link with each other as copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package
from .components import Forest, components

SAMPLE = 20_000
BLOCK = 1024
SUBSPACES, CODES = 8, 64
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _unit(col) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and scaled to length 1 (by way of the largest component, against overflow)."""
    v = np.array(col.tolist(), np.float64)
    u = v / np.abs(v).max(axis=1, keepdims=True)
    return v, u / np.linalg.norm(u, axis=1, keepdims=True)


def _spans(dim: int) -> list[tuple[int, int]]:
    e = np.unique(np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)).tolist()
    return list(zip(e[:-1], e[1:], strict=True))


def _train(lists: int):
    """Coarse centroids and residual codebooks from the sample of one dimension (at most SAMPLE rows)."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("h")
        _, x = _unit(p["v"])
        coarse = _kmeans(x, lists)
        near = ((coarse * coarse).sum(1)[None, :] - 2 * x @ coarse.T).argmin(1)
        rest = x - coarse[near]
        books = [_kmeans(rest[:, a:b], CODES, seed=a) for a, b in _spans(x.shape[1])]
        return pd.DataFrame({"dim": [x.shape[1]], "coarse": [coarse.ravel()], "books": [np.concatenate([b.ravel() for b in books])],
                             "sizes": [np.array([len(b) for b in books])]})
    return run


class Quantiser:
    def __init__(self, dim, coarse, books, sizes):
        self.coarse = np.asarray(coarse, np.float64).reshape(-1, dim)
        self.spans, self.books, at = _spans(dim), [], 0
        flat = np.asarray(books, np.float64)
        for (a, b), n in zip(self.spans, sizes, strict=True):
            self.books.append(flat[at:at + n * (b - a)].reshape(n, b - a))
            at += n * (b - a)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list of each vector, and whether it probes each list."""
        c = self.coarse
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
        own = d.argmin(1)
        norm = (c * c).sum(1)
        apart = np.sqrt(np.maximum(norm[:, None] + norm[None, :] - 2 * c @ c.T, 0))
        # (d - d_own) / (2 * apart) is the distance to the plane between the centroids
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * radius * apart[own] + _SLACK
        return own, (near & (np.arange(len(c))[None, :] > own[:, None])) | (np.arange(len(c))[None, :] == own[:, None])

    def codes(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([((b * b).sum(1)[None, :] - 2 * rest[:, a:e] @ b.T).argmin(1)
                         for (a, e), b in zip(self.spans, self.books, strict=True)], axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each residual's part to each code, per subspace."""
        return [(rest[:, a:e] ** 2).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * rest[:, a:e] @ b.T
                for (a, e), b in zip(self.spans, self.books, strict=True)]


def _index(models: dict, radius: float):
    """Inverted-list entries: a class's own list with codes and error, and the lists it probes."""
    def run(parts):
        for p in parts:
            out = []
            for dim, g in p.groupby("dim"):
                q = Quantiser(dim, *models[dim])
                _, x = _unit(g["v"])
                own, probe = q.probes(x, radius)
                rest = x - q.coarse[own]
                codes = q.codes(rest)
                err = np.linalg.norm(rest - q.decoded(codes), axis=1)
                for i, (gid, lab) in enumerate(zip(g["gid"].tolist(), g["label"].tolist(), strict=True)):
                    out.append((gid, lab, dim, int(own[i]), np.flatnonzero(probe[i]), codes[i].astype(np.int32), float(err[i])))
            yield pd.DataFrame(out, columns=["gid", "label", "dim", "own", "probes", "codes", "err"])
    return run


def _scan(models: dict, cos: float, radius: float):
    """Links between a block of probes and a block of coded vectors of one list."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["probe"]], p[~p["probe"]]
        if a.empty or b.empty:
            return pd.DataFrame({"u": [], "v": [], "n": []})
        dim, own = int(p["dim"].iloc[0]), int(p["list"].iloc[0])
        q = Quantiser(dim, *models[dim])
        av, ax = _unit(a["v"])
        bv, bx = _unit(b["v"])
        ai, bi, ao = a["gid"].to_numpy(), b["gid"].to_numpy(), a["own"].to_numpy()
        codes, err = np.array(b["codes"].tolist()), b["err"].to_numpy()
        d = np.zeros((len(a), len(b)))
        for j, t in enumerate(q.tables(ax - q.coarse[own])):
            d += t[:, codes[:, j]]
        near = np.sqrt(np.maximum(d, 0)) <= radius + err[None, :] + _SLACK
        near &= (ao != own)[:, None] | (ai[:, None] < bi[None, :])  # a pair of one list is met once
        i, j = np.nonzero(near)
        s = np.einsum("ij,ij->i", av[i], bv[j]) / (np.sqrt(np.einsum("ij,ij->i", av[i], av[i])) * np.sqrt(np.einsum("ij,ij->i", bv[j], bv[j])))
        odd = ~np.isfinite(s)  # overflow or underflow of extreme components: by the scaled vectors
        s[odd] = np.einsum("ij,ij->i", ax[i[odd]], bx[j[odd]])
        ok = s >= cos
        i, j = i[ok], j[ok]
        ids = np.concatenate([ai[i], bi[j]])
        weight = np.concatenate([b["copies"].to_numpy()[j], a["copies"].to_numpy()[i]])
        who, at = np.unique(ids, return_inverse=True)
        count = np.bincount(at, weights=weight, minlength=len(who)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        f = Forest()
        for x, y in zip(ai[i].tolist(), bi[j].tolist(), strict=True):
            f.join(x, y)
        u, v = f.links()
        return pd.DataFrame({"u": np.r_[u, who], "v": np.r_[v, who], "n": np.r_[np.zeros(len(u), np.int64), count]})
    return run


def near_duplicates(vectors: DataFrame, cos: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links to rows of its label with cosine >= ``cos``."""
    spark = vectors.sparkSession
    ship_package(spark)
    radius = math.sqrt(max(0.0, 2 - 2 * cos))
    x = F.col(vec_col)
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()  # floats stay floats; products are in doubles
    fine = (F.col(label_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
            & F.exists(x, lambda c: c != 0))
    # + 0 turns -0.0 into 0.0, so that equal vectors are one class
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda c: c + F.lit(0).cast(kind))).alias("v"))
    rows = materialize(rows.withColumn("d", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    live = rows.where("v is not null")
    # equal vectors: one class (the vector itself is part of the key through its first and any hash-mate apart)
    classes = live.groupBy("label", "d", "v").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("gid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    n = classes.count()
    lists = int(min(1024, max(4, 2 ** math.ceil(math.log2(math.sqrt(n + 1) / 4)))))
    sample = classes.withColumn("h", F.xxhash64("v", F.lit(7))).orderBy("h", "gid").limit(SAMPLE)
    models = {r["dim"]: (r["coarse"], r["books"], r["sizes"]) for r in sample.groupBy("dim").applyInPandas(
        _train(lists), "dim int, coarse array<double>, books array<double>, sizes array<int>").collect()}
    # a length that the sample missed gets a quantiser of one zero centroid
    for r in classes.select("dim").distinct().collect():
        if r["dim"] not in models:
            s = _spans(r["dim"])
            models[r["dim"]] = ([0.0] * r["dim"], [0.0] * r["dim"], [1] * len(s))

    entries = materialize(classes.select("gid", "label", "dim", "v").mapInPandas(
        _index(models, radius), "gid long, label string, dim int, own int, probes array<int>, codes array<int>, err double")
        .join(classes.select("gid", "v", "copies"), "gid"))
    size = entries.groupBy("label", "dim", F.col("own").alias("list")).agg(F.count(F.lit(1)).alias("members"))
    probes = entries.select("gid", "label", "dim", "own", "v", "copies", F.explode("probes").alias("list"))
    asked = probes.groupBy("label", "dim", "list").agg(F.count(F.lit(1)).alias("asking"))
    key = ["label", "dim", "list"]
    size = materialize(size.join(asked, key).select(*key, F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("mb"),
                                                    F.ceil(F.col("asking") / F.lit(BLOCK)).cast("int").alias("pb")))
    deal = lambda b: F.pmod(F.xxhash64("gid", F.lit(3)), F.col(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    cols = [*key, "mblk", "pblk", "probe", "gid", "own", "v", "copies", "codes", "err"]
    coded = (entries.withColumnRenamed("own", "list").join(size, key).withColumn("own", F.col("list")).withColumn("mblk", deal("mb"))
             .withColumn("pblk", every("pb")).withColumn("probe", F.lit(False)).select(cols))
    ask = (probes.join(size, key).withColumn("pblk", deal("pb")).withColumn("mblk", every("mb")).withColumn("probe", F.lit(True))
           .withColumn("codes", F.lit(None).cast("array<int>")).withColumn("err", F.lit(None).cast("double")).select(cols))
    found = materialize(coded.unionByName(ask).groupBy(*key, "mblk", "pblk").applyInPandas(
        _scan(models, cos, radius), "u long, v long, n long"))

    links = found.where("u = v").groupBy(F.col("u").alias("gid")).agg(F.sum("n").alias("n"))
    comp = components(found.where("u <> v")).select(F.col("node").alias("gid"), "component")
    named = classes.select("gid", "label", "d", "v", "min_id", "copies").join(links, "gid", "left").join(comp, "gid", "left")
    named = named.withColumn("component", F.coalesce("component", "gid"))
    least = named.groupBy("component").agg(F.min("min_id").alias("component_id"))
    named = named.join(least, "component").select("label", "d", "v", "component_id",
                                                  (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # joined on the hash and, for the unlikely equal hashes, on the vector itself
    out = rows.alias("r").join(named.alias("c"), (F.col("r.label") == F.col("c.label")) & (F.col("r.d") == F.col("c.d"))
                               & (F.col("r.v") == F.col("c.v")), "left")
    cid = F.when(F.col("r.v").isNotNull(), F.col("c.component_id")).otherwise(F.col("r.id"))
    return out.select(F.col("r.id").alias(id_col), F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links"),
                      cid.alias("component_id"), F.coalesce(F.col("r.id") == cid, F.lit(False)).alias("kept"))
