"""Metrics in natural units, as aggregates of prediction columns, for each group of rows (such as a fold).

Curves and ranks come from counts per distinct value, so equal values share
theirs, and running sums go over ranges of values side by side (``folds.below``).
Groups of a known small bound can have theirs in one window each (``small``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds

DIRECTION = {"auc": "maximize", "accuracy": "maximize", "f1": "maximize", "log_loss": "minimize", "rmse": "minimize", "mae": "minimize", "r2": "maximize", "auc_ovr": "maximize"}
CLASSIFICATION = ("auc", "accuracy", "f1", "log_loss", "auc_ovr")


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None, out: str = "auc", small: bool = False) -> DataFrame:
    """Mann-Whitney: of each distinct score, its positives beat all lower negatives and half of its own."""
    by = by or []
    s = df.groupBy(*by, F.col(score).alias("__s")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    if small:
        w = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("below_q", F.coalesce(F.sum("q").over(w), F.lit(0)))
    else:
        s = folds.below(s, "__s", ("q",), tuple(by))
    value = F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2.0)) / F.when(F.sum("p") * F.sum("q") > 0, F.sum("p").cast("double") * F.sum("q"))
    return s.groupBy(*by).agg(value.alias(out))


def auc_ovr(df: DataFrame, label: str, scores: dict[object, str], by: list[str] | None = None, out: str = "auc_ovr", small: bool = False) -> DataFrame:
    """One class against the rest, weighted by the classes' shares. ``scores`` maps a class to its score column."""
    by = by or []
    rows = df.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("cls"), (F.col(label) == F.lit(k)).alias("hit"), F.col(v).cast("double").alias("s")) for k, v in scores.items()))).alias("x")).select(*by, "x.*")
    each = auc(rows, "s", F.col("hit"), [*by, "cls"], "a", small)
    share = rows.groupBy(*by, "cls").agg(F.avg(F.col("hit").cast("double")).alias("w"))
    return each.join(share, [*by, "cls"]).groupBy(*by).agg((F.sum(F.col("a") * F.col("w")) / F.sum("w")).alias(out))


def f1(df: DataFrame, label: str, predicted: str, by: list[str] | None = None, out: str = "f1") -> DataFrame:
    """Per class from the confusion counts, weighted by support."""
    by = by or []
    cells = df.groupBy(*by, F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("l").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))).alias("x")).select(*by, "x.*")
    c = sides.groupBy(*by, "cls").agg(*(F.sum(x).alias(x) for x in ("support", "called", "hit")))
    return c.groupBy(*by).agg((F.sum(F.col("support") * 2.0 * F.col("hit") / (F.col("support") + F.col("called"))) / F.sum("support")).alias(out))


def accuracy(label: str, predicted: str) -> Column:
    return F.avg((F.col(label) == F.col(predicted)).cast("double"))


def log_loss(p_true: Column) -> Column:
    """Positive; probabilities of the true class are kept off 0 and 1."""
    return -F.avg(F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p_true))))


def rmse(label: str, predicted: str) -> Column:
    return F.sqrt(F.avg((F.col(label) - F.col(predicted)) * (F.col(label) - F.col(predicted))))


def mae(label: str, predicted: str) -> Column:
    return F.avg(F.abs(F.col(label) - F.col(predicted)))


def r2(label: str, predicted: str) -> Column:
    return 1 - F.sum((F.col(label) - F.col(predicted)) * (F.col(label) - F.col(predicted))) / F.when(F.var_pop(label) > 0, F.var_pop(label) * F.count(label))


def average_ranks(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """(by, column, out): of each distinct value, how far its rank (equal values share the mean of theirs) lies from the middle of all ranks."""
    values = folds.below(df.groupBy(*by, column).agg(F.sum("__n").alias("__n")), column, ("__n",), tuple(by))
    return values.select(*by, column, (F.col("below___n") + F.col("__n") / 2.0 - F.col("total___n") / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: list[str], out: str = "rho") -> DataFrame:
    """Rank correlation from counts per pair of values; null if either column doesn't vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by, a.alias("__x"), b.alias("__y")).agg(F.count("*").alias("__n"))
    both = pairs.join(average_ranks(pairs, "__x", by, "rx"), [*by, "__x"]).join(average_ranks(pairs, "__y", by, "ry"), [*by, "__y"])
    total = lambda u, v: F.sum(F.col("__n") * F.col(u) * F.col(v))
    spread = F.sqrt(total("rx", "rx")) * F.sqrt(total("ry", "ry"))
    return both.groupBy(*by).agg((total("rx", "ry") / F.when(spread > 0, spread)).alias(out))


def direction(rho: Column, band: float = 0.05) -> Column:
    return F.when(rho > band, "increasing").when(rho < -band, "decreasing").otherwise("unknown")


def check_finite(values: dict[str, float | None]) -> dict[str, float]:
    bad = [k for k, v in values.items() if v is None or v != v or abs(v) == float("inf")]
    if bad:
        raise ValueError(f"metrics that aren't finite: {bad}")
    return values
