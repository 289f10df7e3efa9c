"""Registered queries for the graph embedding (§2.8) and the edge weights roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.logins import load_fixture
from . import oracle as O
from .catalog import add, finalize

LQ = lambda dense=False: O.with_ctes(O.fixture_ctes(dense))
NODE_MOD = 700  # node name -> fixed-vector id (md5 prefix); ids without a vector are out of vocabulary


def q(name, spark_fn, sql, doubles=(), ints=(), section="2.8"):
    add(name, lambda spark, sf: finalize(spark_fn(spark, sf)),
        O.finalize(sql, doubles, ints) if sql else None, section)


_EDGES_SQL = (", N AS (SELECT 'USER_' || CAST(user_id AS VARCHAR) AS u, 'SUB_' || subnet AS s, 'DEV_' || device AS d FROM L),"
              " ED AS (SELECT u AS a, s AS b FROM N UNION ALL SELECT u, d FROM N UNION ALL SELECT s, d FROM N)")
q("tripartite_edges", lambda s, d: G.tripartite_edges(load_fixture(s, d)),
  LQ() + _EDGES_SQL + "\nSELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM ED GROUP BY a, b", ["weight"], [])
q("edge_weight_summary", lambda s, d: G.tripartite_edges(load_fixture(s, d)).groupBy(
    F.split("a", "_").getItem(0).alias("a_type"), F.split("b", "_").getItem(0).alias("b_type"))
  .agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"), F.max("weight").alias("max_weight")),
  LQ() + _EDGES_SQL + ", W AS (SELECT a, b, count(*) AS weight FROM ED GROUP BY a, b)\n"
  "SELECT split_part(a, '_', 1) AS a_type, split_part(b, '_', 1) AS b_type, count(*) AS edges,"
  " CAST(sum(weight) AS DOUBLE) AS total_weight, CAST(max(weight) AS DOUBLE) AS max_weight FROM W GROUP BY 1, 2",
  ["total_weight", "max_weight"], ["edges"], "2.5")


def _fixed_vectors(s, d):
    """The whole vectors of the given table, 64 components."""
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))


def _node_id(c):
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("bigint") % NODE_MOD


def _emb(s, d):
    x = G.flat_embeddings(load_fixture(s, d), _fixed_vectors(s, d), 64, node_key=_node_id)
    return x.select("event_id", *G.embedding_columns(64))


def _emb_sql():
    nid = "CAST(('0x' || substr(md5({}), 1, 6)) AS BIGINT) % 700"
    dot = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"

    def cos(a, b):
        n = f"(sqrt({dot.format(a=a, b=a)}) * sqrt({dot.format(a=b, b=b)}))"
        return f"CASE WHEN {n} > 0 THEN {dot.format(a=a, b=b)} / {n} ELSE 0.0 END"

    z = "list_transform(range(64), lambda i: 0.0::DOUBLE)"
    return (LQ() + ", V AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),"
            f" N AS (SELECT event_id, {nid.format(chr(39) + 'USER_' + chr(39) + ' || CAST(user_id AS VARCHAR)')} AS un,"
            f" {nid.format(chr(39) + 'SUB_' + chr(39) + ' || subnet')} AS sn, {nid.format(chr(39) + 'DEV_' + chr(39) + ' || device')} AS dn FROM L),"
            f" J AS (SELECT n.event_id, CAST(vu.v IS NULL AS INTEGER) AS user_missing, CAST(vs.v IS NULL AS INTEGER) AS sub_missing,"
            f" CAST(vd.v IS NULL AS INTEGER) AS dev_missing, COALESCE(vu.v, {z}) AS uv, COALESCE(vs.v, {z}) AS sv,"
            f" COALESCE(vd.v, {z}) AS dv FROM N n LEFT JOIN V vu ON vu.vec_id = n.un LEFT JOIN V vs ON vs.vec_id = n.sn"
            " LEFT JOIN V vd ON vd.vec_id = n.dn)\n"
            f"SELECT event_id, {cos('uv', 'sv')} AS sim_user_sub, {cos('uv', 'dv')} AS sim_user_dev,"
            f" {cos('sv', 'dv')} AS sim_sub_dev, user_missing, sub_missing, dev_missing, "
            + ", ".join(f"{a}[{i + 1}] AS {r}_v_{i}" for r, a in (("user", "uv"), ("sub", "sv"), ("dev", "dv")) for i in range(64))
            + " FROM J")


q("embedding_features_fixed", _emb, _emb_sql(), G.embedding_columns(64)[:-3], ["event_id", *G.embedding_columns(64)[-3:]])


def _svd(s, d):
    emb, _ = G.graph_svd_fit(G.tripartite_edges(load_fixture(s, d)), k=16)
    return emb.select("node", *[F.col("vec")[i].alias(f"v{i}") for i in range(16)])


# learned/iterative: no SQL oracle (rows-only check); tests compare with numpy on a small graph
q("graph_svd_embeddings", _svd, None)
