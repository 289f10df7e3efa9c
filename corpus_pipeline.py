"""Pipeline over ``documents``: each stage's rows are written and read again by the next.

quality classifier -> toxicity -> n-gram Jaccard join -> mixing -> SentencePiece encoding and decoding.
A stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm import mixing, ngram_join, pieces, quality, toxicity
from tripwire.llm.common import materialize, prepare, table

#: A document is kept from this quality score on.
QUALITY_CUT = 0.3


def _apart(docs: DataFrame) -> tuple[DataFrame, list, str, str]:
    """``docs`` under names of our own, so that no column clashes with a stage's; the way back; its id and text."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return safe, [F.col(f"c{i}").alias(n) for i, n in enumerate(names)], f"c{names.index('doc_id')}", f"c{names.index('text')}"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches QUALITY_CUT."""
    prepare(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    safe, back, _, text = _apart(docs)
    return model.score(safe, [F.col(c) for c in safe.columns], text).where(F.col("score") >= QUALITY_CUT).select(*back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    prepare(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    safe, back, _, text = _apart(docs)
    return model.score(safe, [F.col(c) for c in safe.columns], text).where(~F.col("toxic")).select(*back)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8): the smallest id's."""
    prepare(spark)
    safe, back, doc_id, text = _apart(docs)
    return ngram_join.deduplicate(safe, doc_id, text, words=5, threshold_pct=80).select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every copy taken."""
    prepare(spark)
    safe, back, doc_id, text = _apart(docs)
    source = f"c{docs.columns.index('source')}"
    return mixing.mixed(safe, id_col=doc_id, text_col=text, source_col=source).select(*back)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the digest of their decoding."""
    import public_tokenizers

    prepare(spark)
    return pieces.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"),
                         keep=("doc_id", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
