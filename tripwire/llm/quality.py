"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL, scored as sparse dot products.

A text's features are its word 1- and 2-grams and the 1- to 3-grams of its word shapes, hashed
to 2 ** 20 slots, each weighted by its share of the text's tokens, so that a score does not depend
on length. Training reads a bounded sample of labelled rows (``most`` documents, picked by a hash
of the id), dealt to ``SHARDS`` tasks that each run FTRL; their weights are averaged. Scoring
reads every text whole, one pass, without a shuffle.

Defined results: a null or blank text has no features and scores as the intercept; repeated rows
score alike; null ids are scored and never used for training; labels other than 0 and 1, and ids
labelled both ways, are not used; without usable labels every text scores 0.5; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .features import SLOTS, labelled_sample, scores, word_ngrams
from .ftrl import fit_logistic, sigmoid

#: Labelled documents that are used for training, at most.
SAMPLE = 8000
SHARDS = 4
SCALE = 20.0
EPOCHS = 3


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    rows: int

    def score(self, docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
        """``keep`` and ``score`` (0 to 1, higher: label 1 likelier) for every row."""
        b = self.intercept

        def link(sums, tokens):
            return {"score": sigmoid(b + SCALE * sums / np.maximum(tokens, 1))}
        return scores(docs, self.weights, word_ngrams, keep, link, "score double", False, text_col)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", use: Column | None = None, *,
        id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> QualityModel:
    """Fit on at most ``most`` labelled documents; ``use`` restricts the rows of ``labels``."""
    ship_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, most, word_ngrams, use=use, id_col=id_col, text_col=text_col)

    def train(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["h", "tokens"])
        data = [(y, np.asarray(i, np.int64), np.asarray(c) * (SCALE / max(t, 1)))
                for y, i, c, t in zip(p["y"], p["indices"], p["counts"], p["tokens"], strict=True)]
        w, b = fit_logistic(data, SLOTS, EPOCHS, alpha=1.0, beta=0.2, l1=0.01, l2=0.05)
        on = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.r_[on, -1].astype(np.int64), "w": np.r_[w[on], b], "rows": len(p)})

    parts = rows.groupBy(F.pmod("h", F.lit(SHARDS)).alias("shard")).applyInPandas(train, "slot long, w double, rows long")
    total = parts.groupBy("slot").agg(F.sum(F.col("w") * F.col("rows")).alias("w"), F.sum("rows").alias("rows")).toPandas()
    w = np.zeros(SLOTS)  # a row for each slot at most
    last = total[total["slot"] == -1]
    n = int(last["rows"].iloc[0]) if len(last) else 0
    on = total[total["slot"] >= 0]
    if n:
        w[on["slot"].to_numpy()] = on["w"].to_numpy() / n
    return QualityModel(w, float(last["w"].iloc[0]) / n if n else 0.0, n)
