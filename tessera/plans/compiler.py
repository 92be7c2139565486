"""Feature graphs as Spark plans: one select per generation, and train-only statistics by fused aggregates.

All stateful nodes of a generation that share a key column come from one
aggregate, with the group rows and the total in one pass (grouping sets), and
are looked up by one left join, whose strategy is left to the optimizer's
knowledge of its size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contracts import Dataset, Feature, need
from tessera.functions import ops
from tessera.plans.graph import Graph, Node

MISSING = "N:"


@dataclass
class Lookup:
    """Statistics of one key column in one generation: a table by key, and the values for keys not in it."""

    key: str
    table: DataFrame
    fallback: dict[str, float | None]


@dataclass
class FeatureModel:
    graph: Graph
    tags: dict[str, str]
    lookups: dict[int, list[Lookup]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.graph.dataset.usable] + [f.name for f in self.graph.features]

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: f.dtype for f in self.graph.dataset.usable} | {f.name: f.dtype for f in self.graph.features}

    def transform(self, df: DataFrame, keep: tuple[str, ...] = (), preserve_missing: bool = False) -> DataFrame:
        """``keep`` columns as they are, then raw and derived columns as the model sees them. Lazy; also for streams."""
        work = raw(df, self.graph.dataset, keep)
        for g, nodes in enumerate(self.graph.generations(), 1):
            work = layer(work, nodes, self, self.lookups.get(g, []))
        kinds = self.kinds
        return work.select(*(F.col(f"__keep_{k}").alias(k) for k in keep), *(self.output(n, kinds[n], preserve_missing).alias(n) for n in self.names))

    def key(self, name: str) -> Column:
        return ops.key(F.col(name), self.tags.get(name, "str"))

    def output(self, name: str, kind: str, preserve_missing: bool) -> Column:
        if kind == "datetime":
            return ops.epoch_days(F.col(name))
        if kind == "categorical":
            return F.when(F.col(name).isNotNull(), self.key(name)) if preserve_missing else self.key(name)
        return ops.finite(F.col(name))

    def save(self, path: str) -> None:
        """Statistics as Parquet and the graph as text, under one folder."""
        spark = next((x.table.sparkSession for own in self.lookups.values() for x in own), None) or SparkSession.active()
        meta = {"features": self.graph.records(), "tags": self.tags, "lookups": {g: [{"key": x.key, "fallback": x.fallback} for x in own] for g, own in self.lookups.items()}}
        for g, own in self.lookups.items():
            for k, x in enumerate(own):
                x.table.write.mode("overwrite").parquet(f"{path}/statistics/{g}-{k}")
        spark.createDataFrame([(json.dumps(meta),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dataset: Dataset) -> FeatureModel:
        meta = json.loads(spark.read.text(f"{path}/model").first()[0])
        model = cls(Graph.load(dataset, meta["features"]), meta["tags"])
        for g, own in meta["lookups"].items():
            model.lookups[int(g)] = [Lookup(x["key"], spark.read.parquet(f"{path}/statistics/{g}-{k}"), x["fallback"]) for k, x in enumerate(own)]
        return model

    def release(self) -> None:
        for own in self.lookups.values():
            for x in own:
                x.table.unpersist()


def raw(df: DataFrame, dataset: Dataset, keep: tuple[str, ...] = ()) -> DataFrame:
    """Usable columns only, in order, each in its internal type."""
    kinds = {"numeric": ops.number, "datetime": ops.moment, "categorical": lambda c: c.cast("string")}
    dataset.check(df.schema)
    return df.select(*(F.col(k).alias(f"__keep_{k}") for k in keep), *(kinds[f.dtype](F.col(f.name)).alias(f.name) for f in dataset.usable))


def expression(node: Node, model: FeatureModel) -> Column:
    f, kinds = node.feature, model.kinds
    inputs = list(f.inputs)
    if f.op == "cross":
        inputs.sort(key=lambda x: (model.graph.expression_of(x), x))
        return ops.pair(*(model.key(x) for x in inputs))
    out = ops.ROWWISE[f.op](*(F.col(x) for x in inputs), **f.params)
    return ops.number(out) if kinds[f.name] == "numeric" else out


def layer(work: DataFrame, nodes: list[Node], model: FeatureModel, lookups: list[Lookup]) -> DataFrame:
    for k, x in enumerate(lookups):
        table = x.table.select(F.col("key").alias(f"__key_{k}"), *(F.col(c).alias(f"__{c}") for c in x.fallback))
        work = work.join(table, model.key(x.key) == F.col(f"__key_{k}"), "left").drop(f"__key_{k}")
    stats = {c: v for x in lookups for c, v in x.fallback.items()}
    new = [(F.coalesce(F.col(f"__{n.feature.name}"), F.lit(stats[n.feature.name]).cast("double")) if n.stateful else expression(n, model)).alias(n.feature.name) for n in nodes]
    return work.select(*(c for c in work.columns if not (c.startswith("__") and c[2:] in stats)), *new)


def statistics(work: DataFrame, nodes: list[Node], model: FeatureModel) -> list[Lookup]:
    """One aggregate for each key column: groups and total together."""
    out = []
    by_key: dict[str, list[Feature]] = {}
    for n in nodes:
        if n.stateful:
            by_key.setdefault(n.feature.inputs[0], []).append(n.feature)
    for name, features in sorted(by_key.items()):
        values = {x: ops.finite(F.col(x)) for f in features for x in f.inputs[1:]}
        frame = work.select(model.key(name).alias("key"), *(v.alias(f"v_{x}") for x, v in values.items()))
        aggs = [F.count("*").alias("n"), F.grouping_id().alias("total")]
        aggs += [{"group_mean": F.avg, "group_std": F.stddev_pop}[f.op](f"v_{f.inputs[1]}").alias(f.name) for f in features if f.op != "frequency"]
        table = frame.groupingSets([["key"], []], "key").agg(*aggs).persist(StorageLevel.MEMORY_AND_DISK)
        total = table.where("total = 1").first()
        n = total["n"] if total else 0
        fallback = {f.name: 0.0 if f.op == "frequency" else (total[f.name] if total else None) for f in features}
        columns = [(F.col("n") / F.lit(float(max(n, 1)))).alias(f.name) if f.op == "frequency" else F.col(f.name) for f in features]
        out.append(Lookup(name, table.where("total = 0").select("key", *columns), fallback))
    return out


def fit(df: DataFrame, dataset: Dataset | dict, features=()) -> FeatureModel:
    """Learns statistics from the rows of ``df`` alone."""
    dataset = Dataset.parse(dataset)
    graph = features if isinstance(features, Graph) else Graph.of(dataset, list(features))
    need(graph.dataset == dataset, "the graph belongs to another dataset")
    tags = {f.name: ops.type_tag(df.schema[f.name].dataType) for f in dataset.usable if f.dtype == "categorical"}
    model = FeatureModel(graph, tags)
    work = raw(df, dataset)
    for g, nodes in enumerate(graph.generations(), 1):
        model.lookups[g] = statistics(work, nodes, model)
        work = layer(work, nodes, model, model.lookups[g])
    return model
