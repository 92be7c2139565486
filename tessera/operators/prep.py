"""Preprocessing with train-only statistics: median imputing, scaling, bounded one-hot, and column summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ops

MOST_CATEGORIES = 128


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact, interpolated as usual; a column without values gives 0."""
    row = df.agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in columns)).first() if columns else {}
    return {c: row[c] for c in columns}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in values.items()})


def scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation, the latter 1 where it is 0."""
    row = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first() if columns else {}
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, found: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in found.items()})


def ranked_levels(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> DataFrame:
    """(value, n, slot): slots from 0 by count, then value; values past ``most`` - 1 share the last slot if there are more than ``most``.

    Only the first ``most`` + 1 values are put in order; the others need no place.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.col("n").desc(), "value").limit(most + 1)
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "value")) - 1
    first = first.select(F.col("value").alias("__value"), place.alias("__place"), F.count("*").over(Window.partitionBy()).alias("__many"))
    slot = F.when((F.col("__many") > most) & (F.col("__place") >= most - 1), most - 1).otherwise(F.col("__place"))
    return counts.join(F.broadcast(first), F.col("value").eqNullSafe(F.col("__value")), "left").select("value", "n", F.coalesce(slot, F.lit(most - 1)).cast("int").alias("slot"))


def one_hot(df: DataFrame, column: str, levels: DataFrame, out: str) -> DataFrame:
    """Slot of each row's value; unknown values have none (all zeros as a vector)."""
    return df.join(levels.select(F.col("value").alias(column), F.col("slot").alias(out)), column, "left")


def summaries(df: DataFrame, numeric: list[str], categorical: list[str], least: int = 10, top: int = 5) -> DataFrame:
    """One row per column: missing rate, distinct values, and for numbers with enough values min, max, mean, deviation and
    quantiles, for categories the shares of the most frequent values without naming them. One aggregate for all numbers."""
    x = {c: ops.finite(ops.number(F.col(c))) for c in numeric}
    frame = df.select(*(v.alias(c) for c, v in x.items()), *(F.col(c).cast("string").alias(c) for c in categorical))
    part = lambda c: F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("missing_rate"), F.count_distinct(c).alias("cardinality"), *_numbers(c, c in x, least))
    wide = frame.agg(F.array(*(part(c) for c in [*numeric, *categorical])).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    if not categorical:
        return wide.withColumn("top_shares", F.lit(None).cast("array<double>"))
    long = frame.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categorical))).alias("x")).select("x.*").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column")
    best = counts.withColumns({"total": F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.col("n").desc(), "value"))}).where(F.col("place") <= top)
    shares = best.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", (F.col("n") / F.col("total")).alias("share")))), lambda p: p["share"]).alias("top_shares"))
    return wide.join(shares, "column", "left")


def _numbers(c: str, numeric: bool, least: int) -> list[Column]:
    enough = F.count(c) >= least
    value = lambda v: (F.when(enough, v) if numeric else F.lit(None)).cast("double")
    found = [("min", F.min(c)), ("max", F.max(c)), ("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("q10", F.percentile(c, 0.1)), ("q50", F.percentile(c, 0.5)), ("q90", F.percentile(c, 0.9))] if numeric else [(k, F.lit(None)) for k in ("min", "max", "mean", "std", "q10", "q50", "q90")]
    return [value(v).alias(k) for k, v in found]


def varying(df: DataFrame, column: Column, fold: str, k: int) -> DataFrame:
    """Screening: whether the column varies in any training fold; missing counts as a value."""
    value = F.coalesce(column.cast("string"), F.lit("<missing>"))
    seen = df.select(value.alias("v"), F.col(fold).alias("f")).distinct()
    train = seen.select("v", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: t != F.col("f"))).alias("t"))
    per = train.groupBy("t").agg(F.count_distinct("v").alias("values"))
    return per.agg(F.coalesce(F.bool_or(F.col("values") > 1), F.lit(False)).alias("varies"))
