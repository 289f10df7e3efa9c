"""The registered queries over whole tables, against SQL or brute force, and the pipeline."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tools.oracle_check import digest, duck
from tripwire.llm.queries import ORACLE, QUERIES

from . import cases
from .test_ngram_join import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(rel.columns, rel.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_sentencepiece", "op4_token_counts", "op8_mixing", "op9_quality", "op10_toxicity"])
def test_all_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    n = con.sql("select count(*) from documents").fetchall()[0][0]
    assert "doc_id" in df.columns
    got = [r["doc_id"] for r in df.collect()]
    assert len(got) == n == len(set(got)) or name == "op2_license_scan"


def test_pipeline_stages(spark, con):
    from tripwire.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialize(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns, name
        if k < 3:
            assert docs.exceptAll(before).count() == 0, name  # rows are kept or dropped, not changed
        if k == 2:
            sets = [shingles(r["text"], 5) for r in docs.collect()]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    assert docs.where("n_tokens <> size(ids)").count() == 0 and docs.count() > 0
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())) == \
        sorted(map(str, docs.select("doc_id", "ids_sha256").collect()))


CLASHING = ("score double, toxic boolean, severity double, toxic_prob double, grade int, __size long, __row string, __h long, "
            "n_tokens long, ids string, c0 int, extra map<string,int>")


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    """Documents with nulls, blanks, repeated rows and clashing columns, some labelled."""
    d = str(tmp_path_factory.mktemp("hostile"))
    rows = [(r[0], r[1], r[2], r[3], r[4], 0.5, None, 1.0, None, 2, i % 3, "x", 7, None, "y", 1, {"k": i % 2} if i % 5 else None)
            for i, r in enumerate(cases.documents())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING).write.parquet(f"{d}/documents.parquet")
    ids = sorted({r[0] for r in rows if r[0] is not None})
    spark.createDataFrame([(i, int(k % 4 > 0), int(k % 9 == 0)) for k, i in enumerate(ids)] + [(ids[0], 0, 1), (None, 1, 0), (-1, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stages_on_hostile_tables(spark, hostile):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, hostile)
        assert k == 4 or out.dtypes == docs.dtypes, name
        got = [str(sorted(r.asDict().items(), key=str)) for r in out.collect()]
        if k < 3:
            have = Counter(str(sorted(r.asDict().items(), key=str)) for r in docs.collect())
            assert not Counter(got) - have, name  # rows are kept or dropped, not changed
        if k == 2:
            blank = docs.where("text is null or trim(text) = '' or text = '\t\n'").count()
            assert len([1 for r in out.collect() if not (r["text"] or "").split()]) == blank
        if k == 4:
            assert out.count() == docs.count() and {"n_tokens", "ids", "decoded_sha256"} <= set(out.columns)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, hostile).count() == 0, name


def test_the_sample_is_bounded_by_rows(spark):
    from tripwire.llm.features import labelled_sample, word_ngrams

    docs = spark.range(6000).selectExpr("id % 6 AS doc_id", "concat('text ', id % 12) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    n = lambda most: labelled_sample(docs, labels, "quality", most, word_ngrams).count()
    assert n(5) == 5 and n(20) == 12  # 12 different rows of id and text, of which each counts once
    few = spark.createDataFrame([(i, f"t{i}") for i in range(84, 120)], "doc_id long, text string")
    assert labelled_sample(few, labels, "quality", 50, word_ngrams).count() == 16  # all that are labelled
