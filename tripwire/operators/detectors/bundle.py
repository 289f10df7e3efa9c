"""The supervised detector as one Spark ML estimator: columns, fills, one-hot vocabulary, forest, threshold, calibration.

:class:`LoginDetector` fits on a training frame and tunes on a validation frame; the :class:`LoginDetectorModel` it
returns is all that scoring needs, and is saved and loaded as one thing (metadata of Spark ML beside the
classifier's own files, written through Spark, so on any file system).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import materialize
from .. import metrics as M
from ..prep import vocabulary
from ..sampling import hard_negative_sample
from .forest import GBT_PARAMS, RF_BALANCED_PARAMS, RF_PARAMS, with_weights

# fixed values: fills of missing inputs, recall that the threshold must reach, threshold if none does
NUMERIC_FILL, TEXT_FILL = 0, "Unknown"
TARGET_RECALL, FALLBACK_THRESHOLD = 0.70, 0.30
#: Training rows that are worth a task of their own, and rows of a task at most.
ROWS_OF_A_TASK, MOST_ROWS = 10_000, 200_000
#: How a forest is grown, which changes no tree: each row keeps its node of each tree, and is not led down all of them again for
#: every group of nodes. A boosting round has one shallow tree, where keeping them costs more.
FOREST_RUN = dict(cacheNodeIds=True)
SETTINGS = {"rf": RF_PARAMS, "rf_balanced": RF_BALANCED_PARAMS, "gbt": GBT_PARAMS}


class _Inputs(Params):
    """What both sides know: inputs, label and output columns."""

    numericCols = Param(Params._dummy(), "numericCols", "numeric inputs", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "text inputs, one-hot", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "probability of label 1", TypeConverters.toString)
    flagCol = Param(Params._dummy(), "flagCol", "1 from the threshold on", TypeConverters.toString)

    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))


class LoginDetector(Estimator, _Inputs):
    """``kind``: rf (positives weigh 200), rf_balanced or gbt (class weights), each at its full settings."""

    kind = Param(Params._dummy(), "kind", "rf, rf_balanced or gbt", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, labelCol="is_ato", scoreCol="model_score", flagCol="model_flag", kind="rf"):
        super().__init__()
        self._setDefault(categoricalCols=[], labelCol="is_ato", scoreCol="model_score", flagCol="model_flag", kind="rf")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.settings: dict = {}

    def _fit(self, dataset: DataFrame) -> LoginDetectorModel:
        kind, label = self._get("kind"), self._get("labelCol")
        words = {c: sorted({*vocabulary(dataset.select(_text(c).alias(c)), c)}) for c in self._get("categoricalCols")}
        m = LoginDetectorModel()
        for p in ("numericCols", "categoricalCols", "labelCol", "scoreCol", "flagCol"):
            m._set(**{p: self._get(p)})
        m._set(vocabularyJson=json.dumps(words))
        x = with_weights(dataset.select(*m.inputs(), F.col(label).cast("double").alias(label)), label, "fixed" if kind == "rf" else "balanced")
        x = _in_tasks(materialize(x))
        make = GBTClassifier if kind == "gbt" else RandomForestClassifier
        est = make(featuresCol="_f", labelCol=label, weightCol="_w", **{**({} if kind == "gbt" else FOREST_RUN), **SETTINGS[kind], **self.settings})
        asm = VectorAssembler(inputCols=m.names(), outputCol="_f")
        m.classifier = Pipeline(stages=[asm, est]).fit(x)
        return m


def _in_tasks(x: DataFrame) -> DataFrame:
    """Rows in even shares, since hundreds of trees are hundreds of rounds of tasks and the largest share is a round's time: one a core
    where the rows are worth it (never an empty one), and full rounds of the cores where a share would be too large."""
    n, cores = x.count(), x.sparkSession.sparkContext.defaultParallelism
    parts = min(max(1, n // ROWS_OF_A_TASK), cores * max(1, -(-n // (cores * MOST_ROWS))))
    return x.repartition(parts) if parts > 1 else x.coalesce(1)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(TEXT_FILL))


class LoginDetectorModel(Model, _Inputs, MLWritable, MLReadable):
    """Adds the score and the flag; knows its inputs, vocabulary, threshold and validation figures."""

    vocabularyJson = Param(Params._dummy(), "vocabularyJson", "known values of each categorical input", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "score from which a login is flagged", TypeConverters.toFloat)
    calibrationJson = Param(Params._dummy(), "calibrationJson", "validation figures and score quantiles", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(categoricalCols=[], labelCol="is_ato", scoreCol="model_score", flagCol="model_flag", vocabularyJson="{}",
                         threshold=FALLBACK_THRESHOLD, calibrationJson="{}")
        self.classifier: PipelineModel | None = None

    def words(self) -> dict[str, list[str]]:
        return json.loads(self._get("vocabularyJson"))

    def calibration(self) -> dict:
        return json.loads(self._get("calibrationJson"))

    def names(self) -> list[str]:
        return [*self._get("numericCols"), *[f"{c}_{w}" for c, ws in self.words().items() for w in ws]]

    def inputs(self) -> list[Column]:
        """The model's inputs: missing numbers 0, text one-hot (a value that training did not know gives zeros)."""
        num = [F.coalesce(F.col(c).cast("double"), F.lit(float(NUMERIC_FILL))).alias(c) for c in self._get("numericCols")]
        return num + [(_text(c) == w).cast("double").alias(f"{c}_{w}") for c, ws in self.words().items() for w in ws]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in dataset.columns]
        x = dataset.select(F.struct(*kept).alias("_row"), *self.inputs())
        p = self.classifier.transform(x).select("_row.*", vector_to_array("probability")[1].alias(self._get("scoreCol")))
        return p.withColumn(self._get("flagCol"), M.threshold_predict(self._get("scoreCol"), self._get("threshold")))

    def tune(self, validation: DataFrame) -> LoginDetectorModel:
        """Threshold of the highest precision with recall >= 0.70 on a validation frame, its figures, and score quantiles."""
        label, score = self._get("labelCol"), self._get("scoreCol")
        v = materialize(self.transform(validation).select("event_id", label, score))
        t = M.best_threshold(v, label, score, TARGET_RECALL, FALLBACK_THRESHOLD).first()[0]
        self._set(threshold=float(t))
        r = report(v.withColumn("model", F.lit("")), label, score, float(t)).first().asDict()
        q = v.agg(*[F.percentile_approx(score, p, 100_000).alias(str(p)) for p in (0.5, 0.9, 0.99, 0.999)]).first().asDict()
        self._set(calibrationJson=json.dumps({**{k: x for k, x in r.items() if k != "model"}, "score_quantiles": q}))
        return self

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: LoginDetectorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.classifier.write().overwrite().save(f"{path}/classifier")


class _Reader(MLReader):
    def load(self, path: str) -> LoginDetectorModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        m = LoginDetectorModel()
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        m.classifier = PipelineModel.load(f"{path}/classifier")
        return m


class Sample(NamedTuple):
    """Rows that :func:`training_sample` drew."""

    rows: DataFrame


def training_sample(training: DataFrame, columns: list[str], label: str = "is_ato") -> Sample:
    """Positives, hard and random negatives of the training part with ``columns``, written once: for all detectors that a query fits."""
    return Sample(materialize(hard_negative_sample(training.select("event_id", label, *dict.fromkeys(columns)), label)))


def train(training: DataFrame | Sample, validation: DataFrame, numeric: list[str], categorical: tuple[str, ...] = ("device_type",),
          kind: str = "rf", label: str = "is_ato", **settings) -> LoginDetectorModel:
    """The training flow: positives, hard and random negatives of the training part (or the sample drawn of it); fit; threshold on the
    untouched validation part. ``settings`` override the classifier's (for trials; the defaults are the full ones)."""
    est = LoginDetector(numericCols=numeric, categoricalCols=list(categorical), labelCol=label, kind=kind)
    est.settings = settings
    if not isinstance(training, Sample):
        training = training_sample(training, [*numeric, *categorical], label)
    return est.fit(training.rows).tune(validation)


def side_by_side(calls: list[Callable]) -> list:
    """Results of calls that each run Spark jobs of their own, at the same time: the short rounds of one leave cores that another takes."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(c)) for c in calls]]  # each with local properties of its own


def report(scored: DataFrame, label: str, score: str, threshold: float, ks=(50, 100, 500, 1000)) -> DataFrame:
    """One row: threshold, ROC and PR area, precision, recall, counts at the threshold, P@k and R@k (null where fewer than k rows)."""
    one = lambda d: d.withColumn("_j", F.lit(1))
    flagged = scored.withColumn("_p", M.threshold_predict(score, threshold))
    out = one(scored.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).select("model", "_n"))
    for d in (M.roc_auc(scored, label, score), M.average_precision(scored, label, score), M.confusion(flagged, label, "_p")):
        out = out.join(one(d), "_j")
    k = M.precision_recall_at_k(scored, label, score, ks)
    k = k.agg(*[F.max(F.when(F.col("k") == x, F.col(f"{m}_at_k"))).alias(f"{m[0]}_at_{x}") for m in ("precision", "recall") for x in ks])
    out = out.join(one(k), "_j")
    return out.select("model", F.lit(threshold).alias("threshold"), "roc_auc", "pr_auc", "precision", "recall", "tp", "fp", "fn", "tn",
                      *[F.when(F.col("_n") >= x, F.col(f"{m}_at_{x}")).alias(f"{m}_at_{x}") for m in ("p", "r") for x in ks])


def compare(models: dict[str, LoginDetectorModel], validation: DataFrame) -> DataFrame:
    """A :func:`report` row of each model on a validation frame; ``winner`` is 1 for the best PR area (ties: first name)."""
    def one(name: str, m: LoginDetectorModel) -> DataFrame:
        s = materialize(m.transform(validation).select("event_id", m._get("labelCol"), m._get("scoreCol"), F.lit(name).alias("model")))
        return materialize(report(s, m._get("labelCol"), m._get("scoreCol"), m._get("threshold")))  # a row per model
    out = reduce(DataFrame.unionByName, side_by_side([partial(one, name, m) for name, m in models.items()]))
    best = out.orderBy(F.desc_nulls_last("pr_auc"), "model").limit(1).select("model", F.lit(1).alias("_w"))
    return out.join(F.broadcast(best), "model", "left").select(*out.columns, F.coalesce("_w", F.lit(0)).alias("winner"))


def top_features(model: LoginDetectorModel, spark, k: int = 15) -> DataFrame:
    imp = model.classifier.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(model.names(), imp, strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")
