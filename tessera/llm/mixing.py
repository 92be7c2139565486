"""Mixing sources to target weights.

Each source has a weight, and the mix is as large as all sources together.
Water filling caps a source at ``epochs`` times its own size and shares the
excess among the others by weight. Within a source, documents stand in the
order of a hash of their id; that order is range-partitioned by the hash's
leading bits, which cuts a hot source into as many ranges as it needs, and
running sums of sizes come from sums per range plus a running sum inside each
range. A source takes its budget's whole epochs of every document, and then
documents in order up to the exact word at which the budget ends.

Defined results: null texts have size 0 and are taken 0 times; null sources
are one source, the last; null ids order like empty ones; repeated rows are
documents of their own; an empty table gives no rows and a table without words
targets 0; extra columns of any name pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _core as c

WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Rows of one source that share a range of the hash order, about.
RANGE_ROWS = 2_000
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Of one row (__source, __source_size, __rows) per source: the same and its target.

    With sources by size to weight, those before some place are capped; the
    level of the others is what is left over the weights left. Both are
    running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    number = F.row_number().over(by_name)
    cycle = F.array(*(F.lit(int(x)) for x in weights))
    s = sizes.withColumn("__number", number.cast("long")).withColumn("__weight", F.get(cycle, ((F.col("__number") - 1) % len(weights)).cast("int")).cast("long"))
    by_ratio = Window.orderBy((F.col("__source_size") / F.col("__weight")).asc(), "__number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumns({"__total": F.sum("__source_size").over(everything), "__weights": F.sum("__weight").over(everything), "__capped": F.coalesce(F.sum("__source_size").over(before), F.lit(0)), "__gone": F.coalesce(F.sum("__weight").over(before), F.lit(0))})
    level = (F.col("__total") - epochs * F.col("__capped")).cast("double") / (F.col("__weights") - F.col("__gone"))
    # The level that holds is the first, in this order, that its own source doesn't exceed; sources before it are capped.
    s = s.withColumn("__level", level).withColumn("__holds", F.col("__level") * F.col("__weight") <= epochs * F.col("__source_size"))
    first = F.min(F.when(F.col("__holds"), F.struct("__gone", "__level"))).over(everything)
    s = s.withColumn("__final", first["__level"])
    return s.select("__source", "__source_size", "__rows", F.coalesce(F.least(F.lit(float(epochs)) * F.col("__source_size"), F.col("__final") * F.col("__weight")), F.lit(0.0)).alias("__target"))


def take(narrow: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, scratch: c.Scratch | None = None, order: tuple[str, ...] = ("doc_id", "__size")) -> DataFrame:
    """Of rows (doc_id, __source, __size): the same with __source_size, __target, __taken, __whole (epochs of all rows) and
    __key. ``order`` breaks ties of the hash order."""
    scratch = scratch or c.Scratch(narrow.sparkSession)
    sources = scratch.put(targets(narrow.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.count("*").alias("__rows")), weights, epochs), "sources")
    name = F.coalesce(F.concat(F.lit("s"), "__source"), F.lit(""))
    sources = sources.withColumn("__name", name).drop("__source")
    # Each source has as many ranges of the hash as its rows need.
    ranges = F.greatest(F.lit(1), F.floor(F.col("__rows") / RANGE_ROWS))
    bucket = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") * ranges / 2.0**32).cast("long")
    rows = narrow.withColumn("__key", order_key(F.col("doc_id"))).withColumn("__name", name).join(sources, "__name").withColumn("__range", bucket)
    own = Window.partitionBy("__name").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__name", "__range").agg(F.sum("__size").alias("__in_range")).withColumn("__offset", F.coalesce(F.sum("__in_range").over(own), F.lit(0))).drop("__in_range")
    w = Window.partitionBy("__name", "__range").orderBy("__key", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["__name", "__range"]).withColumn("__before", F.col("__offset") + F.coalesce(F.sum("__size").over(w), F.lit(0)))
    budget = F.floor("__target").cast("long")
    whole = F.when(F.col("__source_size") > 0, F.floor(budget / F.col("__source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("__source_size")
    taken = whole * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__before")))
    return rows.withColumn("__taken", taken.cast("long")).withColumn("__whole", whole).drop("__name", "__range", "__offset", "__before", "__rows")


def narrowed(documents: DataFrame, *more: Column) -> DataFrame:
    return documents.select("doc_id", F.col("source").cast("string").alias("__source"), size_of(F.col("text")).alias("__size"), *more)


def mix(documents: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each row of ``documents`` as many times as it is taken; at the cut, a document of which at least half is taken is whole.

    Rows up to a source's cut in the hash order are taken once more than those
    after it, so a row needs no more than its source's cut: texts aren't shuffled.
    """
    scratch = c.Scratch(documents.sparkSession)
    # The columns travel as one, so that none meets a name of this module.
    rows = c.identified(documents.select(F.struct(*(F.col(f"`{x}`") for x in documents.columns)).alias("row")), scratch, "__row")
    narrow = scratch.put(narrowed(rows.select("row.doc_id", "row.source", "row.text", "__row"), F.col("__row")), "sizes")
    taken = take(narrow, weights, epochs, scratch, order=("__row",)).where("__size > 0")
    once_more = 2 * (F.col("__taken") - F.col("__whole") * F.col("__size")) >= F.col("__size")
    place = F.struct(F.col("__key"), F.col("__row"))
    cuts = taken.groupBy("__source").agg(F.max("__whole").alias("__whole"), F.max(F.when(once_more, place)).alias("__cut"))
    cuts = scratch.put(cuts.select(F.coalesce(F.concat(F.lit("s"), "__source"), F.lit("")).alias("__name"), "__whole", "__cut"), "cuts")
    named = rows.withColumn("__name", F.coalesce(F.concat(F.lit("s"), "row.source"), F.lit(""))).withColumn("__key", order_key(F.col("row.doc_id")))
    more = F.coalesce(place <= F.col("__cut"), F.lit(False)).cast("int")
    words = F.coalesce(F.col("row.text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    copies = named.join(cuts, "__name").withColumn("__copies", F.when(words, F.col("__whole").cast("int") + more).otherwise(0)).where("__copies > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = c.Scratch(spark)
    narrow = scratch.put(narrowed(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return take(narrow, scratch=scratch).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
w AS (SELECT *, (number - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum(source_size) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS gone FROM w
      WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - 3 * capped AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level FROM r),
f AS (SELECT arg_min(level, gone) AS final FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least(3.0 * source_size, final * weight), 0e0) AS target FROM l, f),
x AS (SELECT d.*, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(floor(t.target) AS BIGINT) AS budget,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM x
"""
