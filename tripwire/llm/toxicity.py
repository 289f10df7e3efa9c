"""Toxicity: cumulative-link ordinal regression on sparse text features, scored as expected severity.

Labels say toxic or not; severity comes from the texts. A feature that is much commoner in toxic
than in other labelled documents is a *marker*; a toxic document's grade is 1, 2 or 3 by how many
different markers it holds, and 0 is not toxic. One weight vector and three ordered cuts give
P(grade > k) = sigmoid(w.x - cut[k]); the sum over k is the expected severity, 0 to 3.
Features are lower-cased words and their beginnings (inflected forms share these), present or not;
FTRL's L1 term leaves few weights, so that length alone adds nothing. Training uses a
bounded sample (``most`` labelled documents by a hash of the id) in one task; scoring reads all
texts whole in one pass, without a shuffle.

Defined results: a null or blank text has no features and gets the severity of the cuts alone;
repeated rows score alike; null ids are scored and not used for training; without usable labels
nothing is toxic; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package
from .features import SLOTS, labelled_sample, scores, word_stems
from .ftrl import fit_ordinal, sigmoid

#: Labelled documents that are used for training, at most.
SAMPLE = 10000
GRADES = 4
EPOCHS = 3
#: A marker: in at least this many toxic documents, and this many times as frequent there.
MARKER_ROWS, MARKER_LIFT = 3, 20.0
#: Toxic from this probability of any grade above 0.
CUT = 0.5


@dataclass
class ToxicityModel:
    weights: np.ndarray
    cuts: np.ndarray
    rows: int
    shift: float = field(default=0.0)

    def score(self, docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
        """``keep``, ``severity`` (expected grade), ``toxic_prob`` (any grade above 0), ``grade`` (likeliest)
        and ``toxic`` for every row."""
        cuts = self.cuts

        def link(sums, tokens):
            above = sigmoid(sums[:, None] - cuts[None, :])
            each = -np.diff(np.concatenate([np.ones((len(sums), 1)), above, np.zeros((len(sums), 1))], axis=1), axis=1)
            return {"severity": above.sum(axis=1), "toxic_prob": above[:, 0].copy(),
                    "grade": each.argmax(axis=1).astype(np.int32), "toxic": above[:, 0] >= CUT}
        return scores(docs, self.weights, word_stems, keep, link,
                      "severity double, toxic_prob double, grade int, toxic boolean", True, text_col)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", use: Column | None = None, *,
        id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``most`` labelled documents; ``use`` restricts the rows of ``labels``."""
    ship_package(docs.sparkSession)
    rows = materialize(labelled_sample(docs, labels, label_col, most, word_stems, use=use, id_col=id_col, text_col=text_col)
                       .select("y", "h", "indices"))
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return ToxicityModel(np.zeros(SLOTS), np.full(GRADES - 1, 40.0), sum(count.values()))
    seen = rows.select("y", F.explode("indices").alias("slot")).groupBy("slot").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    lift = ((F.col("t") + 0.5) / (count[1] + 1)) / ((F.col("c") + 0.5) / (count[0] + 1))
    # markers: a slot each at most
    markers = np.array([r["slot"] for r in seen.where((F.col("t") >= MARKER_ROWS) & (lift >= MARKER_LIFT)).select("slot").collect()], np.int64)

    def train(p: pd.DataFrame) -> pd.DataFrame:
        mark = np.zeros(SLOTS, bool)
        mark[markers] = True
        p = p.sort_values("h")
        data = [(y, np.asarray(i, np.int32)) for y, i in zip(p["y"], p["indices"], strict=True)]
        hits = np.array([mark[i].sum() for y, i in data if y])
        low, high = np.quantile(hits, [1 / 3, 2 / 3])
        graded = [(0 if not y else 1 + int(mark[i].sum() > low) + int(mark[i].sum() > high), i, None) for y, i in data]
        w, cuts = fit_ordinal(graded, SLOTS, GRADES, EPOCHS, alpha=0.5, beta=1.0, l1=1.0, l2=0.0)
        on = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.r_[on, -1 - np.arange(len(cuts))].astype(np.int64), "w": np.r_[w[on], cuts]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "slot long, w double").toPandas()  # a bounded sample
    w = np.zeros(SLOTS)
    on = got[got["slot"] >= 0]
    w[on["slot"].to_numpy()] = on["w"].to_numpy()
    cuts = got[got["slot"] < 0].sort_values("slot", ascending=False)["w"].to_numpy()
    return ToxicityModel(w, cuts, sum(count.values()))
