import random

import numpy as np
import pytest

from tripwire.llm import quality, toxicity
from tripwire.llm.ftrl import cut_points, fit_logistic, fit_ordinal, sigmoid

from .cases import DOC_SCHEMA, documents, sentence


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        t = sentence(rng, rng.randint(10, 80))
        bad, tox = i % 4 == 0, i % 5 == 0
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split(" "))
        if tox:
            w = t.split(" ")
            for _ in range(1 + i % 7):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "awful", "rotten"]) + rng.choice(["", "ly", "ness"]))
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, 0 if bad else 1, int(tox)))
    labels += [(1, 1, 0), (2, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (4, 7, 7)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    m = quality.fit(docs, labels, use=labels["doc_id"] % 3 != 0)
    got = m.score(docs, [docs["doc_id"]]).toPandas()
    held = got[got.doc_id % 3 == 0]
    assert auc((held.doc_id % 4 != 0).to_numpy().astype(int), held.score.to_numpy()) > 0.97
    assert got.score.between(0, 1).all() and m.rows <= 400


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    m = toxicity.fit(docs, labels, use=labels["doc_id"] % 3 != 0)
    assert (np.diff(m.cuts) > 0).all()
    got = m.score(docs, [docs["doc_id"]]).toPandas()
    held = got[got.doc_id % 3 == 0]
    y = (held.doc_id % 5 == 0).to_numpy().astype(int)
    assert auc(y, held.severity.to_numpy()) > 0.97
    assert got.severity.between(0, 3).all()
    many = held[(held.doc_id % 5 == 0) & (held.doc_id % 7 >= 5)].severity.mean()
    few = held[(held.doc_id % 5 == 0) & (held.doc_id % 7 == 0)].severity.mean()
    assert many > few  # more marks, more severe


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, labelled, kind):
    rows = documents()
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    m = kind.fit(*labelled)
    got = m.score(docs, [docs["doc_id"], docs["words"], docs["h"]])
    assert got.columns[:3] == ["doc_id", "words", "h"]
    got = got.toPandas()
    assert len(got) == len(rows) and got.iloc[:, 3].notna().all()
    assert m.score(spark.createDataFrame([], DOC_SCHEMA), []).count() == 0
    none = kind.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = none.score(docs, []).toPandas()
    assert (out.score == 0.5).all() if kind is quality else not out.toxic.any()


def test_scores_do_not_depend_on_partitions(spark, labelled):
    docs, labels = labelled
    a, b = (quality.fit(d, labels.repartition(k)).score(d, [d["doc_id"]]).toPandas().sort_values("doc_id").score.to_numpy()
            for k, d in ((1, docs.repartition(1)), (5, docs.repartition(6))))
    assert np.allclose(a, b)


def test_ftrl_finds_the_weights():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(800):
        i = rng.choice(40, 6, replace=False)
        rows.append((int(sum(j < 10 for j in i) > 1), i, np.ones(6)))
    w, b = fit_logistic(rows, 40, 5, alpha=0.3, beta=1.0, l1=0.1, l2=0.0)
    s = np.array([w[i].sum() + b for _, i, _ in rows])
    assert auc(np.array([r[0] for r in rows]), s) > 0.99


def test_ordinal_cuts_share_one_weight_vector():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(2000):
        i = rng.choice(60, 10, replace=False)
        k = int((i < 15).sum())
        rows.append((min(k // 2, 3), i, None))
    w, cuts = fit_ordinal(rows, 60, 4, 6, alpha=0.3, beta=1.0, l1=0.1)
    assert (np.diff(cuts) > 0).all()
    s = np.array([w[i].sum() for _, i, _ in rows])
    e = sigmoid(s[:, None] - cuts).sum(axis=1)
    y = np.array([r[0] for r in rows])
    assert [e[y == g].mean() for g in range(4)] == sorted(e[y == g].mean() for g in range(4))
    assert np.mean(np.abs(e - y)) < 0.4
    assert np.allclose(cut_points(np.array([1.0, 0.0, 0.0])), [1, 2, 3])
