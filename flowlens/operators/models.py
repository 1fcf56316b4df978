"""Baseline classifier suite on MLlib (MOD-*).

Every model is a ``Pipeline(VectorAssembler -> StringIndexer -> estimator ->
IndexToString)`` so fitting and scoring are distributed MLlib jobs and
predictions come back as the original class names. Binary-only MLlib learners
(LinearSVC, GBT) are wrapped in one-vs-rest.
"""
from __future__ import annotations

import json
from contextlib import contextmanager
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, finite
from . import evaluate as EV
from .boosting import BoostedTrees, fit_boosting

DEFAULT_MODELS = ("random_forest", "decision_tree", "logistic_regression", "naive_bayes")
EXTENDED_MODELS = ("svm", "gradient_boosting", "mlp")
ROWS_A_TASK = 50_000, 500_000  # least and most rows that a task of a fit is given


def estimator(name: str, n_features: int, n_classes: int, seed: int = 42):
    """MOD-01..07: the reference hyper-parameters on their MLlib counterparts."""
    kw = dict(featuresCol="features", labelCol="label_idx", predictionCol="pred_idx")
    # deep trees: a larger per-pass node budget and cached node ids (checkpointed in the
    # shared folder) cut the number of passes; the fitted trees are the same
    deep = dict(maxMemoryInMB=1024, cacheNodeIds=True)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=50, maxDepth=15, seed=seed, **deep, **kw)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=15, seed=seed, **deep, **kw)
    if name == "logistic_regression":
        return LogisticRegression(maxIter=500, regParam=1e-4, **kw)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **kw)
    if name == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=1000, regParam=1e-4), parallelism=4, **kw)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 64, 32, n_classes], seed=seed, maxIter=300, **kw)
    raise ValueError(f"no estimator is called {name!r}; there are {', '.join(DEFAULT_MODELS + EXTENDED_MODELS)}")


@contextmanager
def spread(df: DataFrame):
    """``df``, cached while in use, with its rows dealt over the cores if they are not.

    A file of few row groups is read by few tasks, and each of the many passes of a fit would run in those."""
    df = df.persist()
    rows, largest = df.groupBy(F.spark_partition_id()).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    cores, (least, most) = df.sparkSession.sparkContext.defaultParallelism, ROWS_A_TASK
    dealt = df
    try:
        if largest > min(max(least, 1.5 * rows / cores), 4 * most):
            dealt = df.repartition(max(min(cores, rows // least + 1), rows // most + 1)).persist()
            dealt.count()
            df.unpersist()
        yield dealt
    finally:
        df.unpersist()
        dealt.unpersist()


class ModelSuite:
    """MOD-08: default or extended set; fit one / all; predict; predict_proba."""

    def __init__(self, names: Sequence[str] | None = None, extended: bool = False, seed: int = 42, boosting: dict | None = None):
        names = list(names) if names else list(DEFAULT_MODELS) + (list(EXTENDED_MODELS) if extended else [])
        for n in names:
            if n not in DEFAULT_MODELS + EXTENDED_MODELS:
                raise ValueError(f"{n!r} is none of the models of a suite")
        self.names, self.seed, self.boosting = names, seed, {"rounds": 50, "depth": 5, "rate": 0.1, **(boosting or {})}
        self.fitted: dict[str, PipelineModel | BoostedTrees] = {}

    def _pipeline(self, name: str, features: Sequence[str], label: str, n_classes: int) -> Pipeline:
        assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
        indexer = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
        return Pipeline(stages=[assembler, indexer, estimator(name, len(features), n_classes, self.seed)])

    def fit(self, df: DataFrame, features: Sequence[str], label: str, names: Sequence[str] | None = None) -> "ModelSuite":
        clean = df.select(*[F.coalesce(finite(col(f)), F.lit(0.0)).alias(f) for f in features], col(label).cast("string").alias(label))
        self.features, self.label = list(features), label
        with spread(clean) as clean:
            n_classes = clean.select(label).distinct().count()   # class count: one small aggregate
            for n in names or self.names:
                if n == "gradient_boosting":
                    self.fitted[n] = fit_boosting(clean, features, label, **self.boosting)
                    continue
                m = self._pipeline(n, features, label, n_classes).fit(clean)
                labels = m.stages[1].labels
                self.fitted[n] = PipelineModel(stages=m.stages + [IndexToString(inputCol="pred_idx", outputCol="prediction",
                                                                               labels=labels)])
        return self

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.fitted:
            raise RuntimeError(f"fit {name!r} before it predicts")
        prepared = df.select("*", *[F.coalesce(finite(col(f)), F.lit(0.0)).alias(f"__f_{i}")
                                    for i, f in enumerate(self.features)])
        for i, f in enumerate(self.features):
            prepared = prepared.withColumn(f, F.col(f"__f_{i}")).drop(f"__f_{i}")
        if self.label not in prepared.columns:
            prepared = prepared.withColumn(self.label, F.lit(None).cast("string"))
        model = self.fitted[name]
        return model.predict(prepared) if isinstance(model, BoostedTrees) else model.transform(prepared)

    def predict_proba(self, df: DataFrame, name: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        out = self.predict(df, name)
        if "probability" not in out.columns:
            raise RuntimeError(f"{name!r} gives classes but no probabilities")
        return out if isinstance(self.fitted[name], BoostedTrees) else out.withColumn("probability", vector_to_array("probability"))

    def save(self, name: str, path: str, scores: dict | None = None) -> None:
        """MOD-09: one fitted model with its features, label and (if given) scores; replaces what is there."""
        model = self.fitted[name]
        if isinstance(model, BoostedTrees):
            SparkSession.active().createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        else:
            model.write().overwrite().save(f"{path}/model")
        about = {"name": name, "features": self.features, "label": self.label, "scores": scores or {}}
        # written last: a folder without it holds no whole model
        SparkSession.active().createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str) -> tuple[str, "ModelSuite", dict]:
        """MOD-09: (name, a suite that holds the saved model, its scores)."""
        spark = SparkSession.active()
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        suite = ModelSuite([about["name"]])
        suite.features, suite.label = about["features"], about["label"]
        suite.fitted[about["name"]] = (BoostedTrees.from_json(spark.read.text(f"{path}/model", wholetext=True).first()["value"]) if about["name"] == "gradient_boosting"
                                       else PipelineModel.load(f"{path}/model"))
        return about["name"], suite, about["scores"]


def train_and_select(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                     names: Sequence[str] = DEFAULT_MODELS, seed: int = 42, save_to: str | None = None,
                     boosting: dict | None = None) -> tuple[DataFrame, str, ModelSuite]:
    """MOD-09: fit every candidate, macro-F1 on the test split, pick the best, save it if asked to.

    Returns (scores by model, name of the best, suite). The scores are computed here, once."""
    suite = ModelSuite(names, seed=seed, boosting=boosting).fit(train, features, label)
    rows = None
    with spread(test.select(*[col(f) for f in features], col(label))) as test:
        for n in suite.names:
            pred = suite.predict(test, n)
            m = EV.summary(EV.confusion(pred, label, "prediction")).select(F.lit(n).alias("model"), "accuracy", "f1_macro",
                                                                          "precision_macro", "recall_macro")
            rows = m if rows is None else rows.unionByName(m)
        found = rows.collect()  # one row a model
    best = max(found, key=lambda r: (r["f1_macro"], r["model"]))
    if save_to:
        suite.save(best["model"], save_to, {k: v for k, v in best.asDict().items() if k != "model"})
    return train.sparkSession.createDataFrame(found, rows.schema), best["model"], suite
