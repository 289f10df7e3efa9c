"""The registered queries: one thin ``opN_<name>`` per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lexical, licenses, mixing, pieces, pq_dedup, quality, repair, sharding, token_counts, topk, toxicity
from .common import prepare, table
from .ngram_join import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_ngram_jaccard(spark, sf_dir):
    """Components of documents whose 4-word shingle sets have Jaccard >= 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold_pct=85)


def _model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op3_sentencepiece(spark, sf_dir):
    """Ids of every document and their decoding, as digests."""
    return pieces.encode(table(spark, sf_dir, "documents"), _model_path(),
                         outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def fold(doc_id="doc_id"):
    """crc32 of the decimal id, modulo 5; rows with 0 are held out of training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


@query
def op9_quality(spark, sf_dir):
    """Quality score of every document; labels of the held-out fold are not seen."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), use=fold() != 0)
    out = model.score(docs, [F.col("doc_id")])
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_toxicity(spark, sf_dir):
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=fold() != 0)
    return model.score(docs, [F.col("doc_id")])


@query
def op8_mixing(spark, sf_dir):
    """Words that the mix takes from every document."""
    mix, rows = mixing.plan(table(spark, sf_dir, "documents"))
    out = mixing.taken(mix, mix.decide(rows), 8)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__words").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.size("__shards")).cast("long").alias("taken"),
                      F.array_sort("__shards").alias("shards"))


@query
def op5_chat_format(spark, sf_dir):
    """Formatted conversations, read back from the examples; conversation -7 holds control strings."""
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.examples(turns))


ORACLE["op5_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;'), ']', '&rbr;'), chr(10), '&nl;'))
        + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;')) + 11 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op6_exact_topk(spark, sf_dir):
    """The 5 best of all other vectors for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE["op6_exact_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op7_pq_near_dedup(spark, sf_dir):
    """Links of every vector to vectors of its label with cosine >= 0.98."""
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op7_pq_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id"""


@query
def op2_license_scan(spark, sf_dir):
    """Licence paragraphs of every document: family, calibrated probability, best template."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs)).drop("line")


@query
def op4_token_counts(spark, sf_dir):
    """Tokens of every document, and after the edits that hide personal data."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    counted = token_counts.count(table(spark, sf_dir, "documents"), ranks, pattern)
    out = token_counts.recount(counted, ranks, pattern, token_counts.redactions)
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "chars_encoded",
                      F.length("text_edited").cast("long").alias("n_chars_edited"), F.size("tree_tokens").cast("long").alias("n_leaves"))


def _shingle_sql(n: int, pct: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END)) AS g FROM w),
k AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN k x ON x.doc_id = u JOIN k y ON y.doc_id = v WHERE 100 * c >= {pct} * (x.k + y.k - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(k.k, 0)::BIGINT AS n_shingles, m.component_id FROM w JOIN m ON m.u = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id"""


ORACLE["op1_ngram_jaccard"] = _shingle_sql(4, 85)


@query
def op11_sharding(spark, sf_dir):
    """Shard and slot of every document under the law ``key``, with 16 and with 17 shards."""
    out = sharding.shards(table(spark, sf_dir, "documents"), sharding.standard(16), sharding.standard(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 of a list of byte values, as SQL over a column of such lists.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT))"


def _crc_sql(byte_list: str) -> str:
    return (f"xor(4294967295, list_reduce({byte_list}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))")


def _bytes_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"


def _tree_sql(key: str, n: int) -> str:
    """Best child of each level, by the draws written out."""
    tree = sharding._levels(sharding.standard(n))

    def best(kids):
        draws = ", ".join(f"{{'d': ln((('0x' || md5({key} || '@{c}')[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {w}, 'c': '{c}'}}"
                          for c, w in sorted(kids.items()))
        return f"list_max([{draws}]).c"
    out = best(tree[0][""])
    for level in tree[1:]:
        out = f"(SELECT CASE p " + " ".join(f"WHEN '{p}' THEN {best(kids)}" for p, kids in level.items()) + f" END FROM (SELECT {out} AS p))"
    return f"split_part({out}, '/', 3)::INTEGER"


ORACLE["op11_sharding"] = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, coalesce('k' || doc_id, 'null') AS k, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
  {_crc_sql(_bytes_sql("coalesce(text, '')"))}::BIGINT AS text_crc32 FROM documents, crc),
p AS (SELECT *, {_tree_sql("k", 16)} AS shard, {_tree_sql("k", 17)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard
  ORDER BY md5(k), doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM p"""


@query
def op12_conversation_repair(spark, sf_dir):
    """Cheapest repair of every damaged conversation."""
    turns = table(spark, sf_dir, "conversations")
    left = F.when(repair.damage_kind() != 0, F.col("turn"))
    span = F.max(left).cast("decimal(38,0)") - F.min(left) + 1 - F.countDistinct(left)
    every = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps")) \
        .withColumn("ck", repair.conversation_key())
    read = repair.digests(repair.repair(repair.damaged(turns)))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(read, "ck", "left").select(
        "conv_id", "gaps", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_CUT = "[\\x20\\x09-\\x0D]"
_SAID = "[^\\x20\\x09-\\x0D]"

# costs before a row from those after it (v), for the four states; z is the row's own penalty
_BEFORE_SQL = """[least(3 + v[1], CASE WHEN stay THEN least(2 + z + v[3], CASE c WHEN 's' THEN z + v[2] WHEN 'u' THEN z + v[3] ELSE 999999999 END) ELSE 999999999 END),
    least(3 + v[2], CASE WHEN stay THEN least(2 + z + v[3], CASE c WHEN 'u' THEN z + v[3] ELSE 999999999 END) ELSE 999999999 END),
    least(3 + v[3], CASE WHEN stay THEN least(2 + z + v[4], CASE c WHEN 'a' THEN z + v[4] ELSE 999999999 END) ELSE 999999999 END),
    least(3 + v[4], CASE WHEN stay THEN least(2 + z + v[3], CASE c WHEN 'u' THEN z + v[3] ELSE 999999999 END) ELSE 999999999 END)]"""

ORACLE["op12_conversation_repair"] = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS k,
  {_crc_sql(_bytes_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS h FROM conversations, crc),
d AS (SELECT k, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t),
o AS (SELECT k, turn, role, text, left(role, 1) AS c, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS i FROM d),
f AS MATERIALIZED (SELECT *, fault NOT IN (1, 2) AS stay, (fault = 3)::BIGINT AS z FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '{_SAID}') THEN 1
  WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?]{_CUT}*\\z') THEN 3 ELSE 0 END AS fault FROM o)),
b AS (SELECT k, max(i) + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS v FROM f GROUP BY k
  UNION ALL SELECT k, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])]
  FROM (SELECT b.k, f.i, {_BEFORE_SQL} AS w FROM b JOIN f ON f.k = b.k AND f.i = b.i - 1)),
g AS (SELECT k, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS lines, 0::BIGINT AS cost FROM b WHERE i = 1
  UNION ALL SELECT k, i + (e <> 'I')::BIGINT, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND c = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE
      list_append(lines, CASE s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END,
    cost + CASE e WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'R' THEN 2 + z ELSE z END
  FROM (SELECT g.*, f.role, f.text, f.c, f.z, CASE WHEN 3 + y.v[s] = x.v[s] THEN 'D'
      WHEN 2 + x.v[CASE s WHEN 3 THEN 4 ELSE 3 END] = x.v[s] THEN 'I'
      WHEN CASE WHEN s = 1 AND c = 's' THEN z + y.v[2] WHEN s <> 3 AND c = 'u' THEN z + y.v[3] WHEN s = 3 AND c = 'a' THEN z + y.v[4] END = x.v[s] THEN 'K'
      ELSE 'R' END AS e
    FROM g JOIN b x ON x.k = g.k AND x.i = g.i LEFT JOIN b y ON y.k = g.k AND y.i = g.i + 1 LEFT JOIN f ON f.k = g.k AND f.i = g.i
    WHERE f.i IS NOT NULL OR x.v[s] > 0)),
r AS (SELECT k, arg_max(audit, length(audit)) AS audit, max(cost) AS cost, arg_max(lines, length(audit)) AS lines FROM g GROUP BY k),
n AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY i) AS p FROM f) GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM t) LEFT JOIN n USING (k) LEFT JOIN r USING (k)"""


@query
def op13_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


_TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE["op13_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n),
m AS (SELECT r, doc_id, (50 + (50 * len(ts)::BIGINT * n) // l)::BIGINT AS m FROM d, s WHERE len(ts) > 0),
f AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM f WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50"""
