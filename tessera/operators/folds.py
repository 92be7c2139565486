"""Folds as columns: they survive repartitioning, and every row of a fold is known from its own values."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of the leading order column in which rows are numbered side by side.
RANGES = 1000


def _as_double(df: DataFrame, column: Column) -> Column:
    """A double that never falls as the column grows."""
    kind = df.select(column).schema[0].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return column.cast("double")


def ranged(df: DataFrame, column: Column) -> DataFrame:
    """Adds __range, which never falls as the column grows; cut at its approximate quantiles. Nulls come first, NaN last."""
    keyed = df.withColumn("__key", _as_double(df, column))
    quantiles = keyed.agg(F.percentile_approx("__key", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    cuts = sorted({q for q in quantiles if abs(q) < float("inf")}) or [0.0]
    cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__key", outputCol="__range", handleInvalid="keep")
    return cutter.transform(keyed).withColumn("__range", F.when(F.col("__key").isNull(), -1.0).otherwise(F.col("__range"))).drop("__key")


def with_before(rows: DataFrame, counts: DataFrame, by: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Of sums per group and range: adds to each row __before_<x>, the sum over the group's ranges before its own, and __total_<x>, the group's."""
    w = Window.partitionBy(*by)
    before = lambda x: F.coalesce(F.sum(x).over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(x).alias(f"__by_{x}") for x in by), F.col("__range").alias("__of"), *(c for x in sums for c in (before(x).alias(f"__before_{x}"), F.sum(x).over(w).alias(f"__total_{x}"))))
    same = F.col("__range") == F.col("__of")
    for x in by:
        same &= F.col(x).eqNullSafe(F.col(f"__by_{x}"))
    # Without groups there are at most RANGES + 2 counts; with them, the optimizer picks by size.
    return rows.join(counts if by else F.broadcast(counts), same).drop("__of", *(f"__by_{x}" for x in by))


def placed(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds __place, the row's place from 0 in the ascending order within its group, and __total, the group's rows.

    Rows are numbered within ranges of the leading order column; the counts of
    the ranges before are added. So neither a global order nor a large group
    goes to one task, unless one value of the leading order column is itself
    that frequent. Nulls come first.
    """
    rows = ranged(df, order[0])
    counts = rows.groupBy(*by, "__range").agg(F.count("*").alias("n"))
    numbered = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1)
    whole = with_before(numbered, counts, by, ("n",))
    return whole.select(*df.columns, (F.col("__place") + F.col("__before_n")).alias("__place"), F.col("__total_n").alias("__total"))


def below(df: DataFrame, value: str, sums: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each column of ``sums``, below_<x>, its sum over the group's rows with smaller values, and total_<x>. One row per group and value."""
    rows = ranged(df, F.col(value))
    counts = rows.groupBy(*by, "__range").agg(*(F.sum(x).alias(x) for x in sums))
    w = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({f"__own_{x}": F.coalesce(F.sum(x).over(w), F.lit(0)) for x in sums})
    whole = with_before(summed, counts, by, sums)
    return whole.select(*df.columns, *(c for x in sums for c in ((F.col(f"__own_{x}") + F.col(f"__before_{x}")).alias(f"below_{x}"), F.col(f"__total_{x}").alias(f"total_{x}"))))


def row_hash(row_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), row_id)


def kfold(df: DataFrame, row_id: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Shuffled by a seeded hash: no shuffle of data, folds balanced in expectation."""
    return df.withColumn(out, F.pmod(row_hash(F.col(row_id), seed), F.lit(k)).cast("int"))


def by_key(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.col(key), F.lit(k)).cast("int"))


def stratified(df: DataFrame, label: str, order: Column, k: int, out: str = "fold") -> DataFrame:
    """Per class, the n-th row in the given order goes to fold n mod k, so classes are balanced to one row."""
    return placed(df, [order], (label,)).withColumn(out, F.pmod("__place", F.lit(k)).cast("int")).drop("__place", "__total")


def group(df: DataFrame, column: str, k: int, out: str = "fold") -> DataFrame:
    """All rows of a group in one fold; groups by size (largest first, then by value) go round the folds there and back, which keeps sizes even.

    A group's place is its place among groups of its own size and the number of
    larger ones. There are few different sizes: at most the root of twice the rows.
    """
    sizes = df.groupBy(column).agg(F.count("*").alias("__n"))
    larger = sizes.groupBy(F.col("__n").alias("__size")).agg(F.count("*").alias("__groups"))
    larger = larger.select("__size", F.coalesce(F.sum("__groups").over(Window.orderBy(F.col("__size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__larger"))
    numbered = placed(sizes, [F.col(column)], ("__n",)).join(larger, F.col("__n") == F.col("__size"))
    turn = F.pmod(F.col("__place") + F.col("__larger"), F.lit(2 * k))
    folds = numbered.select(column, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias(out))
    return df.join(folds, column)


def expanding_time(df: DataFrame, order: list[str], out: str = "block", splits: int = 5) -> DataFrame:
    """Blocks of a time order: block 0 only trains; block b = 1.. validates and then joins the training rows of later ones."""
    n = df.count()
    size = n // (splits + 1)
    if size == 0:
        raise ValueError("too few rows for time splits")
    i, first = F.col("__place"), n - splits * size
    block = F.when(i < first, 0).otherwise(1 + F.floor((i - first) / size)).cast("int")
    return placed(df, [F.col(x) for x in order]).withColumn(out, block).drop("__place", "__total")


def holdout(df: DataFrame, label: str, order: Column, share: float = 0.25, out: str = "held_out") -> DataFrame:
    """Per class, the first floor(share n) rows in the given order are held out."""
    return placed(df, [order], (label,)).withColumn(out, F.col("__place") < F.floor(F.col("__total") * share)).drop("__place", "__total")


def disjoint(df: DataFrame, row_id: str, fold: str = "fold") -> DataFrame:
    """Rows in more than one fold: none, if folds are disjoint."""
    return df.groupBy(row_id).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")
