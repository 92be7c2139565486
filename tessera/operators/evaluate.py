"""Cross-validated evaluation on fold columns, with estimators of Spark ML and evidence per feature."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contracts import Dataset, need
from tessera.operators import folds, metrics, prep
from tessera.plans.compiler import FeatureModel, fit
from tessera.plans.graph import Graph

#: Rows on which importance is measured, at most (hash order).
SHUFFLED_ROWS = 500


@dataclass(frozen=True)
class Adapter:
    """Builds an estimator from (training rows, deviation of the label, number of features, classes) and parameters."""

    build: Callable[..., Estimator]
    classifier: bool
    capacity: dict[str, int] = field(default_factory=dict)

    def check(self, rows: int, columns: int, classes: int) -> None:
        for name, value in (("rows", rows), ("columns", columns), ("classes", classes)):
            if value > self.capacity.get(name, value):
                raise ValueError(f"{name}: {value} passes the estimator's capacity of {self.capacity[name]}")


def _logistic(n, spread, width, classes, C=1.0, **more):
    return LogisticRegression(regParam=1.0 / (C * max(n, 1)), standardization=False, maxIter=100, tol=1e-8, **more)


def _ridge(n, spread, width, classes, alpha=1.0, **more):
    return LinearRegression(solver="normal", regParam=alpha * (spread or 1.0) / max(n, 1), standardization=False, **more)


ESTIMATORS = {
    "logistic": Adapter(_logistic, True),
    "ridge": Adapter(_ridge, False),
    "boosted_classifier": Adapter(lambda n, s, w, c, **p: GBTClassifier(seed=0, **p) if c <= 2 else RandomForestClassifier(seed=0, **p), True),
    "boosted_regressor": Adapter(lambda n, s, w, c, **p: GBTRegressor(seed=0, **p), False),
    "forest_classifier": Adapter(lambda n, s, w, c, **p: RandomForestClassifier(seed=0, **p), True),
    "forest_regressor": Adapter(lambda n, s, w, c, **p: RandomForestRegressor(seed=0, **p), False),
    "network": Adapter(lambda n, s, w, c, hidden=(16,), **p: MultilayerPerceptronClassifier(layers=[w, *hidden, max(2, c)], seed=0, **p), True),
}


def default_estimator(metric: str) -> str:
    """Where none is named: logistic regression for metrics of classes, ridge for those of numbers."""
    need(metric in metrics.DIRECTION, f"unknown metric {metric}")
    return "logistic" if metric in metrics.CLASSIFICATION else "ridge"


@dataclass
class Result:
    metrics: dict[str, float]
    folds: list[dict[str, float]]
    importance: dict[str, float]
    directions: dict[str, str]
    fits: int


class FoldPipeline:
    """Features, median imputing, scaling and bounded one-hot, then the estimator, all learnt from training rows."""

    def __init__(self, graph: Graph, label: str, adapter: Adapter, params: dict, classes: int):
        self.graph, self.label, self.adapter, self.params, self.classes = graph, label, adapter, params, classes

    def fit(self, train: DataFrame, keep: tuple[str, ...]) -> FoldPipeline:
        self.features: FeatureModel = fit(train, self.graph.dataset, self.graph)
        frame = self.features.transform(train, keep=keep)
        kinds = self.features.kinds
        self.numeric = [n for n in self.features.names if kinds[n] != "categorical"]
        self.medians = prep.medians(frame, self.numeric)
        filled = prep.impute(frame, self.medians) if self.numeric else frame
        self.scales = prep.scales(filled, self.numeric)
        # Columns of more than MOST_CATEGORIES values keep the most frequent; the others seen share the last place, by a join.
        self.levels, self.rare = {}, {}
        for n in self.features.names:
            if kinds[n] == "categorical":
                ranked = prep.ranked_levels(frame, n).persist()
                self.levels[n] = [r["value"] for r in ranked.groupBy("slot").agg(F.min("value").alias("value"), F.count("*").alias("n")).where("n = 1").orderBy("slot").collect()]
                if ranked.count() > prep.MOST_CATEGORIES:
                    self.rare[n] = ranked
                else:
                    ranked.unpersist()
        ready = self.prepare(filled).persist()
        n, spread = ready.agg(F.count("*"), F.stddev_pop(self.label)).first()
        width = len(self.inputs)
        self.adapter.check(n, width, self.classes)
        self.model = self.adapter.build(n, spread, width, self.classes, **self.params).setFeaturesCol("features").setLabelCol(self.label).fit(ready)
        ready.unpersist()
        return self

    @property
    def inputs(self) -> list[str]:
        return [f"n_{k}" for k in range(len(self.numeric))] + [f"c_{k}_{j}" for k, own in enumerate(self.levels.values()) for j in range(len(own))] + [f"r_{k}" for k in range(len(self.rare))]

    def prepare(self, frame: DataFrame) -> DataFrame:
        values = [((F.coalesce(F.col(c), F.lit(self.medians[c])) - self.scales[c][0]) / self.scales[c][1]).alias(f"n_{k}") for k, c in enumerate(self.numeric)]
        values += [(F.col(c) == v).cast("double").alias(f"c_{k}_{j}") for k, (c, own) in enumerate(self.levels.items()) for j, v in enumerate(own)]
        columns = frame.columns
        for k, (c, ranked) in enumerate(self.rare.items()):
            frame = prep.one_hot(frame, c, ranked, f"r_{k}")
            values.append((F.coalesce(f"r_{k}", F.lit(-1)) == prep.MOST_CATEGORIES - 1).cast("double").alias(f"r_{k}"))
        return VectorAssembler(inputCols=self.inputs, outputCol="features").transform(frame.select(*columns, *values)).drop(*self.inputs)

    def release(self) -> None:
        self.features.release()
        for ranked in self.rare.values():
            ranked.unpersist()

    def predict(self, frame: DataFrame) -> DataFrame:
        """Of compiled columns: prediction, and p (array of class probabilities) for classifiers."""
        out = self.model.transform(self.prepare(frame))
        return out.withColumn("p", vector_to_array("probability")) if self.adapter.classifier else out

    def apply(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Of raw rows, which need no label: the columns of ``keep``, prediction, and p for classifiers."""
        own = {k: f"__kept_{j}" for j, k in enumerate(keep)}
        ready = df.withColumns({v: F.col(k) for k, v in own.items()})
        out = self.predict(self.features.transform(ready, keep=tuple(own.values())))
        return out.select(*(F.col(v).alias(k) for k, v in own.items()), "prediction", *(["p"] if self.adapter.classifier else []))

    def save(self, path: str) -> None:
        """Everything that ``apply`` needs, under one folder that appears whole: written beside it, then renamed; an older one goes first."""
        part = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        spark = SparkSession.active()
        self.features.save(f"{part}/features")
        self.model.write().save(f"{part}/model")
        for k, ranked in enumerate(self.rare.values()):
            ranked.write.parquet(f"{part}/rare/{k}")
        dataset = {"fields": [vars(f) | {"semantic_tags": list(f.semantic_tags)} for f in self.graph.dataset.fields]}
        meta = {"dataset": dataset, "label": self.label, "classes": self.classes, "classifier": self.adapter.classifier, "numeric": self.numeric, "medians": self.medians, "scales": self.scales, "levels": self.levels, "rare": list(self.rare)}
        spark.createDataFrame([(json.dumps(meta),)], "pipeline string").coalesce(1).write.text(f"{part}/pipeline")
        jvm = spark.sparkContext._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(part)
        files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        need(files.rename(new, old), f"{path} can't be renamed")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FoldPipeline:
        meta = json.loads(spark.read.text(f"{path}/pipeline").first()[0])
        dataset = Dataset.parse(meta["dataset"])
        features = FeatureModel.load(spark, f"{path}/features", dataset)
        pipe = cls(features.graph, meta["label"], Adapter(_loaded, meta["classifier"]), {}, meta["classes"])
        pipe.features, pipe.numeric, pipe.medians, pipe.levels = features, meta["numeric"], meta["medians"], meta["levels"]
        pipe.scales = {c: tuple(x) for c, x in meta["scales"].items()}
        pipe.rare = {c: spark.read.parquet(f"{path}/rare/{k}") for k, c in enumerate(meta["rare"])}
        pipe.model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
        return pipe


def _loaded(*sizes, **params):
    raise ValueError("a loaded pipeline is fitted already")


def scored(predictions: DataFrame, label: str, names: list[str], classes: int, by: list[str], small: bool = False) -> DataFrame:
    """All metrics of all groups in one row per group. ``small``: each group has a known small bound."""
    own = F.get(F.col("p"), F.col(label).cast("int")) if any(n in ("log_loss",) for n in names) else None
    plain = {"accuracy": lambda: metrics.accuracy(label, "prediction"), "log_loss": lambda: metrics.log_loss(own), "rmse": lambda: metrics.rmse(label, "prediction"), "mae": lambda: metrics.mae(label, "prediction"), "r2": lambda: metrics.r2(label, "prediction")}
    out = predictions.groupBy(*by).agg(F.count("*").alias("rows"), *(plain[n]().alias(n) for n in names if n in plain))
    if "auc" in names:
        out = out.join(metrics.auc(predictions.withColumn("__p", F.get("p", F.lit(1))), "__p", F.col(label) == 1, by, small=small), by)
    if "f1" in names:
        out = out.join(metrics.f1(predictions, label, "prediction", by), by)
    if "auc_ovr" in names:
        cols = {float(k): f"__p{k}" for k in range(classes)}
        out = out.join(metrics.auc_ovr(predictions.withColumns({v: F.get("p", F.lit(int(k))) for k, v in cols.items()}), label, cols, by, small=small), by)
    return out


def evaluate(df: DataFrame, graph: Graph, label: str, fold: str, names: list[str], estimator: str, params: dict | None = None, explain: bool = True, charge: Callable[[], None] = lambda: None, row_id: str | None = None) -> Result:
    """Each fold's pipeline is fitted on the other folds; metrics are averaged over folds with equal weight."""
    adapter = ESTIMATORS[estimator] if isinstance(estimator, str) else estimator
    found = sorted(r[0] for r in df.select(fold).distinct().collect())
    classes = df.agg(F.count_distinct(label)).first()[0] if adapter.classifier else 0
    per, gain, rho = [], [], []
    keep = (label, fold) + ((row_id,) if row_id else ())
    for k in found:
        charge()
        pipe = FoldPipeline(graph, label, adapter, params or {}, classes).fit(df.where(F.col(fold) != k), keep)
        valid = pipe.features.transform(df.where(F.col(fold) == k), keep=keep).persist()
        row = scored(pipe.predict(valid), label, names, classes, [fold]).first()
        per.append(metrics.check_finite({n: row[n] for n in names}))
        if explain:
            gain.append(importance(pipe, valid, label, names[0], classes, row_id))
            rho.append(directions(pipe, valid, label, fold))
        valid.unpersist()
        pipe.release()
    mean = {n: sum(x[n] for x in per) / len(per) for n in names}
    average = lambda rows: {c: sum(x[c] for x in rows) / len(rows) for c in (rows[0] if rows else {})}
    sign = {c: "increasing" if v > 0.05 else "decreasing" if v < -0.05 else "unknown" for c, v in average(rho).items()}
    return Result(mean, per, average(gain), sign, len(found))


def importance(pipe: FoldPipeline, valid: DataFrame, label: str, metric: str, classes: int, row_id: str | None = None, repeats: int = 3) -> dict[str, float]:
    """Loss of the metric when one compiled column is permuted among at most SHUFFLED_ROWS rows; all variants are scored in one job."""
    names = pipe.features.names
    order = folds.row_hash(F.col(row_id) if row_id else F.struct(*names), 0)
    few = valid.orderBy(order).limit(SHUFFLED_ROWS).toPandas()
    if len(few) < 2:
        return {n: 0.0 for n in names}
    import numpy as np
    import pandas as pd

    rng, parts = np.random.default_rng(0), [few.assign(__column="", __repeat=0)]
    for n in names:
        for k in range(repeats):
            parts.append(few.assign(**{n: few[n].to_numpy()[rng.permutation(len(few))], "__column": n, "__repeat": k}))
    stacked = valid.sparkSession.createDataFrame(pd.concat(parts), schema=valid.withColumns({"__column": F.lit(""), "__repeat": F.lit(0)}).schema)
    rows = scored(pipe.predict(stacked), label, [metric], classes, ["__column", "__repeat"], small=True).collect()
    base = next((r[metric] for r in rows if r["__column"] == ""), None)
    sign = 1 if metrics.DIRECTION[metric] == "maximize" else -1
    out = {n: [sign * ((base or 0.0) - (r[metric] or 0.0)) for r in rows if r["__column"] == n] for n in names}
    return {n: sum(v) / max(1, len(v)) for n, v in out.items()}


def explain_holdout(pipe: FoldPipeline, held_out: DataFrame, metric: str, row_id: str | None = None, repeats: int = 3) -> dict[str, float]:
    """Permutation importance of a frozen pipeline's columns on raw rows that it has not been fitted on."""
    keep = (pipe.label,) + ((row_id,) if row_id else ())
    return importance(pipe, pipe.features.transform(held_out, keep=keep), pipe.label, metric, pipe.classes, row_id, repeats)


def directions(pipe: FoldPipeline, valid: DataFrame, label: str, fold: str) -> dict[str, float]:
    """Rank correlation of each derived numeric column with the label, all in one go; 0 where it has none."""
    names = [f.name for f in pipe.graph.features if f.dtype == "numeric"]
    if not names:
        return {}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")
    long = valid.select(F.col(label).alias("__label"), cells).select("__label", "x.*")
    found = {r["name"]: r["rho"] for r in metrics.spearman(long, "value", "__label", ["name"]).collect()}
    return {n: found[n] if found.get(n) is not None else 0.0 for n in names}
