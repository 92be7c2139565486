"""What a search's ledger shows, as DataFrame queries: curves, frontiers, histories and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that are resampled, at most.
BOOTSTRAP_VALUES = 100_000


def _better(value: Column, maximize: bool) -> Column:
    return value if maximize else -value


def efficiency_curve(trials: DataFrame) -> DataFrame:
    """COMPLETE trials in order with what had been spent by then: candidates evaluated, fits, tokens, time and cost.

    Time is the recorded one where there is one, else the last known plus the
    durations since. Cost is unknown for good after the first unknown bill.
    """
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    anchored = F.coalesce(F.col("elapsed"), F.lit(0.0)) > 0
    t = trials.withColumns({
        "evaluations": F.sum(((F.col("state") == "COMPLETE") & F.col("valid_proposal")).cast("long")).over(upto),
        "fits": F.sum("model_fits").over(upto),
        "tokens": F.sum("tokens").over(upto),
        "segment": F.sum(anchored.cast("long")).over(upto),
        "known": F.min(F.col("api_cost").isNotNull().cast("int")).over(upto),
        "spent": F.sum(F.coalesce("api_cost", F.lit(0.0))).over(upto),
    })
    inside = Window.partitionBy("segment").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    time = F.first(F.when(anchored, F.col("elapsed")).otherwise(0.0)).over(inside) + F.sum(F.when(anchored, 0.0).otherwise(F.col("duration"))).over(inside)
    return t.select("number", "state", "value", "evaluations", "fits", "tokens", time.alias("seconds"), F.when(F.col("known") == 1, F.col("spent")).alias("cost")).where("state = 'COMPLETE'")


def best_so_far(curve: DataFrame, maximize: bool = True) -> DataFrame:
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("best", _better(F.max(_better(F.col("value"), maximize)).over(upto), maximize))


def target_attainment(curve: DataFrame, gain: float, maximize: bool = True, share: float = 0.95) -> DataFrame:
    """Evaluations at which the gain over the baseline first reached a fixed value, and a share of the final gain (none without a gain)."""
    base = F.min_by(_better(F.col("value"), maximize), F.col("number")).over(Window.partitionBy(F.lit(1)))
    g = curve.withColumn("gain", _better(F.col("value"), maximize) - base)
    g = g.withColumn("final", F.max("gain").over(Window.partitionBy(F.lit(1))))
    first = lambda need: F.min_by("evaluations", F.when(need, F.col("number")))
    return g.agg(first(F.col("gain") >= gain - 1e-12).alias("fixed_target"), first((F.col("final") > 0) & (F.col("gain") >= share * F.col("final") - 1e-12)).alias("relative_target"))


def pareto(curve: DataFrame, resource: str, maximize: bool = True) -> DataFrame:
    """Trials that no cheaper or equally cheap one matches; unknown resources drop out."""
    utility = _better(F.col("value"), maximize)
    before = Window.orderBy(F.col(resource).asc(), utility.desc(), "number").rowsBetween(Window.unboundedPreceding, -1)
    c = curve.where(F.col(resource).isNotNull() & F.col("value").isNotNull()).withColumn("prev", F.max(utility).over(before))
    return c.where(F.col("prev").isNull() | (utility > F.col("prev"))).drop("prev")


def best_trial(trials: DataFrame, maximize: bool = True) -> DataFrame:
    return trials.where("state = 'COMPLETE'").orderBy(_better(F.col("value"), maximize).desc(), "number").limit(1)


def elites(trials: DataFrame, k: int = 5, maximize: bool = True) -> DataFrame:
    return trials.where("state = 'COMPLETE'").orderBy(_better(F.col("value"), maximize).desc(), "number").limit(k)


def beam_frontier(trials: DataFrame, number: int, width: int, strategy: str = "beam", maximize: bool = True) -> DataFrame:
    """The frontier for a trial, and which of it is that trial's parent (round robin)."""
    k = width if strategy == "beam" else 1
    cutoff = (number - 1) // k * k if strategy == "beam" else number - 1
    ok = trials.where((F.col("state") == "COMPLETE") & F.col("expandable") & (F.col("number") <= cutoff))
    w = Window.orderBy(_better(F.col("value"), maximize).desc(), "number")
    top = ok.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < k)
    size = F.count("*").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("parent", F.col("place") == F.pmod(F.lit(number - 1), size)).select("number", "value", F.col("place").cast("int").alias("place"), "parent")


def deltas(trials: DataFrame) -> DataFrame:
    """Raw differences to the baseline (trial 0) and to the parent."""
    base = trials.where("number = 0").select(F.col("value").alias("base"), F.lit(1).alias("one"))
    parent = trials.select(F.col("number").alias("parent"), F.col("value").alias("of_parent"))
    return trials.withColumn("one", F.lit(1)).join(base, "one", "left").join(parent, "parent", "left").select("number", (F.col("value") - F.col("base")).alias("delta"), (F.col("value") - F.col("of_parent")).alias("parent_delta"))


def duplicates(trials: DataFrame) -> DataFrame:
    """Trials whose signature an earlier COMPLETE trial has, with the first such."""
    done = trials.where("state = 'COMPLETE'").groupBy("signature").agg(F.min("number").alias("original"))
    return trials.join(done, "signature").where("number > original").select("number", "original")


def concept_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("concept", "status").agg(F.count("*").alias("n"))


def memory(history: DataFrame, k: int = 3) -> DataFrame:
    """Per kind (useful or rejected concepts, failed operators) the k most frequent; ties go to the first seen."""
    kind = F.when(F.col("status").isin("supported", "strongly_supported"), "useful").when(F.col("status") == "rejected", "rejected")
    rows = history.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind", "concept").agg(F.count("*").alias("n"), F.min("trial").alias("first"))
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "first", "concept")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("kind", "concept", "n", F.col("place").cast("int").alias("place"))


def lineage(nodes: DataFrame) -> DataFrame:
    """The first appearance of each expression."""
    w = Window.partitionBy("hash").orderBy("trial", "name")
    return nodes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def verdict(importance: Column, improves: Column, folds_better: Column, folds: Column, direction_fits: Column) -> Column:
    """Of a tested hypothesis. Without importance, an improvement stays inconclusive."""
    share = folds_better / folds
    return (
        F.when(improves.isNull(), "retained").when(~improves, "rejected").when(importance.isNull() | (importance <= 0), "inconclusive").when(direction_fits & (share >= 0.8), "strongly_supported").when(direction_fits, "supported").otherwise("inconclusive")
    )


def unused(features: DataFrame) -> DataFrame:
    """Leaves: features (name, inputs) that no other takes as input."""
    used = features.select(F.explode("inputs").alias("name")).distinct()
    return features.select("name").join(used, "name", "left_anti")


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Many-to-one pairing by keys; keys that repeat on the right are an error."""
    if right.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("pairing keys repeat")
    return left.join(right.select(*keys, F.col(value).alias(f"{value}_base")), keys).withColumn("difference", F.col(value) - F.col(f"{value}_base"))


def split_conflicts(runs: DataFrame, by: list[str], split: str) -> DataFrame:
    """Comparisons whose runs weren't made on one and the same split: groups with more than one split hash (a missing one counts too)."""
    return runs.groupBy(*by).agg(F.count_distinct(F.coalesce(F.col(split).cast("string"), F.lit("<missing>"))).alias("splits")).where("splits > 1")


def bootstrap(values: DataFrame, column: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean and 95 % interval by resampling; a few benchmark values, each numbered, so a draw is an array lookup. More than BOOTSTRAP_VALUES are an error."""
    spark, own = values.sparkSession, values.where(F.col(column).isNotNull()).select(F.col(column).cast("double"))
    v = [r[0] for r in own.orderBy(column).limit(BOOTSTRAP_VALUES + 1).collect()]
    if len(v) > BOOTSTRAP_VALUES:
        raise ValueError(f"more than {BOOTSTRAP_VALUES} values to resample")
    n = len(v)
    if n < 2:
        return spark.createDataFrame([(v[0] if v else None, None, None, n)], "mean double, low double, high double, n int")
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.get(F.array(*map(F.lit, v)), F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(n)).cast("int")))
    means = spark.range(resamples).select((F.aggregate(draws, F.lit(0.0), lambda a, x: a + x) / n).alias("m"))
    return means.agg(F.lit(sum(v) / n).alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.lit(n).alias("n"))
