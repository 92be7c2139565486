"""Queries over the engine's operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.contracts import Feature
from tessera.functions import ops
from tessera.operators import evidence, folds, metrics, prep, retrieval
from tessera.plans.compiler import fit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def field(name: str, dtype: str, **more) -> dict:
    return {"name": name, "dtype": dtype, "description": name.replace("_", " "), **more}


def r(c, n: int = 6):
    return F.round(c, n)


def orders(spark, d) -> DataFrame:
    """Orders with their customer: the frame of the stateful queries."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_mktsegment", "c_acctbal", F.pmod("o_orderkey", F.lit(3)).cast("int").alias("fold"))


ORDERS = {"fields": [field("o_totalprice", "numeric", unit="currency"), field("c_acctbal", "numeric", unit="currency"), field("o_orderpriority", "categorical"), field("c_mktsegment", "categorical"), field("o_orderdate", "datetime"), field("o_orderstatus", "categorical", exclude=True)]}
LINES = {"fields": [field(x, "numeric") for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]}
EVENTS = {"fields": [field("value", "numeric"), field("ts", "datetime"), field("event_type", "categorical")]}
CUSTOMERS = {"fields": [field("c_acctbal", "numeric"), field("c_mktsegment", "categorical")]}
B = "b AS (SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus, c_mktsegment, c_acctbal, CAST(o_orderkey % 3 AS INTEGER) AS fold FROM orders JOIN customer ON o_custkey = c_custkey)"


# ---------------------------------------------------------------- rows


def rowwise(name: str, table: str, key: list[str], dataset: dict, inputs: tuple[str, ...], sql: str, params: dict | None = None, digits: int = 6):
    """One operator over a whole table, through the compiler."""

    def run(spark, d):
        model = fit(t(spark, d, table), dataset, [Feature("x", name, inputs, params or {})])
        return model.transform(t(spark, d, table), keep=tuple(key)).select(*key, r(F.col("x"), digits).alias("x"))

    run.__name__ = f"op_{name}"
    query(f"SELECT {', '.join(key)}, round(CAST({sql} AS DOUBLE), {digits}) AS x FROM {table}")(run)


rowwise("add", "part", ["p_partkey"], {"fields": [field("p_size", "numeric"), field("p_retailprice", "numeric")]}, ("p_size", "p_retailprice"), "p_size + p_retailprice")
rowwise("subtract", "part", ["p_partkey"], {"fields": [field("p_size", "numeric"), field("p_retailprice", "numeric")]}, ("p_size", "p_retailprice"), "p_size - p_retailprice")
rowwise("multiply", "lineitem", ["l_orderkey", "l_linenumber"], LINES, ("l_extendedprice", "l_discount"), "l_extendedprice * l_discount", digits=4)
rowwise("divide", "lineitem", ["l_orderkey", "l_linenumber"], LINES, ("l_extendedprice", "l_discount"), "CASE WHEN abs(l_discount) > 1e-12 THEN l_extendedprice / l_discount END", digits=3)
rowwise("log1p_abs", "customer", ["c_custkey"], CUSTOMERS, ("c_acctbal",), "ln(1 + abs(c_acctbal))", digits=8)
rowwise("sqrt_abs", "customer", ["c_custkey"], CUSTOMERS, ("c_acctbal",), "sqrt(abs(c_acctbal))", digits=8)
rowwise("square", "part", ["p_partkey"], {"fields": [field("p_size", "numeric")]}, ("p_size",), "CAST(p_size AS DOUBLE) * p_size")
rowwise("abs", "customer", ["c_custkey"], CUSTOMERS, ("c_acctbal",), "abs(c_acctbal)")
rowwise("clip", "customer", ["c_custkey"], CUSTOMERS, ("c_acctbal",), "CASE WHEN c_acctbal IS NOT NULL THEN greatest(0.0, least(5000.0, c_acctbal)) END", {"lower": 0.0, "upper": 5000.0})
rowwise("year", "events", ["event_id"], EVENTS, ("ts",), "year(ts)")
rowwise("month", "events", ["event_id"], EVENTS, ("ts",), "month(ts)")
rowwise("dayofweek", "events", ["event_id"], EVENTS, ("ts",), "isodow(ts) - 1")


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS DOUBLE) AS x FROM lineitem")
def op_is_missing(spark, d):
    df = t(spark, d, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return fit(df, LINES, [Feature("x", "is_missing", ("l_discount",))]).transform(df, keep=("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "x")


@query("SELECT l_orderkey, l_linenumber, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6, 8) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def op_days_between(spark, d):
    df = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    model = fit(df, {"fields": [field("l_shipdate", "datetime"), field("o_orderdate", "datetime")]}, [Feature("x", "days_between", ("l_shipdate", "o_orderdate"))])
    return model.transform(df, keep=("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", r(F.col("x"), 8).alias("x"))


KEYED = "CASE WHEN {0} IS NULL THEN 'N:' ELSE concat('V:str:', {0}) END"


@query(f"SELECT c_custkey, {KEYED.format('s')} AS k FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer)")
def category_key(spark, d):
    return t(spark, d, "customer").select("c_custkey", ops.key(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("k"))


@query()
def op_cross(spark, d):
    df = t(spark, d, "orders")
    model = fit(df, {"fields": [field("o_orderstatus", "categorical"), field("o_orderpriority", "categorical")]}, [Feature("x", "cross", ("o_orderpriority", "o_orderstatus"))])
    return model.transform(df, keep=("o_orderkey",)).select("o_orderkey", "x")


# The order of a crossing's inputs is that of their hashes.
def _cross_sql() -> str:
    from tessera.plans.graph import digest

    a, b = sorted(("o_orderstatus", "o_orderpriority"), key=lambda n: digest(["field", n, "categorical"]))
    return f"SELECT o_orderkey, concat('V:str:', length(concat('V:str:', {a})), ':', 'V:str:', {a}, 'V:str:', {b}) AS x FROM orders"


SQL["op_cross"] = _cross_sql()


# ---------------------------------------------------------------- train-only statistics


def stateful(spark, d, features: list[Feature]) -> DataFrame:
    """Fitted on folds 1 and 2, applied to fold 0; one market segment is made missing."""
    df = orders(spark, d).withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    model = fit(df.where("fold <> 0"), ORDERS, features)
    return model.transform(df.where("fold = 0"), keep=("o_orderkey",))


STATE = B.replace("c_mktsegment,", "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,")


@query(f"WITH {STATE}, g AS (SELECT c_mktsegment AS k, count(*) AS n FROM b WHERE fold <> 0 GROUP BY 1), n AS (SELECT count(*) AS n FROM b WHERE fold <> 0) SELECT o_orderkey, round(coalesce(g.n / CAST(n.n AS DOUBLE), 0), 6) AS x FROM b LEFT JOIN g ON b.c_mktsegment IS NOT DISTINCT FROM g.k CROSS JOIN n WHERE fold = 0")
def op_frequency(spark, d):
    return stateful(spark, d, [Feature("x", "frequency", ("c_mktsegment",))]).select("o_orderkey", r(F.col("x")).alias("x"))


@query(f"WITH {STATE}, g AS (SELECT c_mktsegment AS k, avg(o_totalprice) AS m FROM b WHERE fold <> 0 GROUP BY 1), n AS (SELECT avg(o_totalprice) AS m FROM b WHERE fold <> 0) SELECT o_orderkey, round(coalesce(g.m, n.m), 4) AS x FROM b LEFT JOIN g ON b.c_mktsegment IS NOT DISTINCT FROM g.k CROSS JOIN n WHERE fold = 0")
def op_group_mean(spark, d):
    return stateful(spark, d, [Feature("x", "group_mean", ("c_mktsegment", "o_totalprice"))]).select("o_orderkey", r(F.col("x"), 4).alias("x"))


@query(f"WITH {STATE}, g AS (SELECT c_mktsegment AS k, stddev_pop(o_totalprice) AS m FROM b WHERE fold <> 0 GROUP BY 1), n AS (SELECT stddev_pop(o_totalprice) AS m FROM b WHERE fold <> 0) SELECT o_orderkey, round(coalesce(g.m, n.m), 4) AS x FROM b LEFT JOIN g ON b.c_mktsegment IS NOT DISTINCT FROM g.k CROSS JOIN n WHERE fold = 0")
def op_group_std(spark, d):
    return stateful(spark, d, [Feature("x", "group_std", ("c_mktsegment", "o_totalprice"))]).select("o_orderkey", r(F.col("x"), 4).alias("x"))


SEARCHED = [
    Feature("ratio", "divide", ("o_totalprice", "c_acctbal")),
    Feature("size", "log1p_abs", ("o_totalprice",)),
    Feature("segment_price", "group_mean", ("c_mktsegment", "o_totalprice")),
    Feature("priority_share", "frequency", ("o_orderpriority",)),
    Feature("day", "dayofweek", ("o_orderdate",)),
    Feature("over", "subtract", ("o_totalprice", "segment_price")),
]
GRAPH_SQL = f"""WITH {B}, g AS (SELECT c_mktsegment AS k, avg(o_totalprice) AS m FROM b WHERE fold <> 0 GROUP BY 1), f AS (SELECT o_orderpriority AS p, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM b WHERE fold <> 0 GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN abs(c_acctbal) > 1e-12 THEN o_totalprice / c_acctbal END, 4) AS ratio, round(ln(1 + abs(o_totalprice)), 6) AS size, round(g.m, 4) AS segment_price, round(f.s, 6) AS priority_share, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS day, round(o_totalprice - g.m, 4) AS over
FROM b LEFT JOIN g ON c_mktsegment = g.k LEFT JOIN f ON o_orderpriority = f.p WHERE fold = 0"""


def _holdout(spark, d):
    df = orders(spark, d)
    return fit(df.where("fold <> 0"), ORDERS, SEARCHED).transform(df.where("fold = 0"), keep=("o_orderkey",))


@query(GRAPH_SQL)
def fit_transform_holdout(spark, d):
    return _holdout(spark, d).select("o_orderkey", *(r(F.col(x), n).alias(x) for x, n in (("ratio", 4), ("size", 6), ("segment_price", 4), ("priority_share", 6))), "day", r(F.col("over"), 4).alias("over"))


@query(f"WITH {B}, k AS (SELECT *, concat(o_orderpriority, '|', c_mktsegment) AS pair FROM b), g AS (SELECT pair, avg(o_totalprice) AS m FROM k WHERE fold <> 0 GROUP BY 1), n AS (SELECT avg(o_totalprice) AS m FROM b WHERE fold <> 0) SELECT o_orderkey, round((o_totalprice - coalesce(g.m, n.m)) * (o_totalprice - coalesce(g.m, n.m)), 1) AS spread FROM k LEFT JOIN g USING (pair) CROSS JOIN n WHERE fold = 0")
def compile_graph(spark, d):
    """Three generations: a crossing, its group mean, and arithmetic on that."""
    df = orders(spark, d)
    features = [Feature("spread", "square", ("off",)), Feature("off", "subtract", ("o_totalprice", "of_pair")), Feature("of_pair", "group_mean", ("pair", "o_totalprice")), Feature("pair", "cross", ("c_mktsegment", "o_orderpriority"))]
    return fit(df.where("fold <> 0"), ORDERS, features).transform(df.where("fold = 0"), keep=("o_orderkey",)).select("o_orderkey", r(F.col("spread"), 1).alias("spread"))


@query(f"WITH {B} SELECT o_orderkey, o_totalprice, c_acctbal, concat('V:str:', o_orderpriority) AS o_orderpriority, concat('V:str:', c_mktsegment) AS c_mktsegment, round(epoch_us(o_orderdate) / 86400e6, 8) AS o_orderdate FROM b")
def compiled_matrix(spark, d):
    df = orders(spark, d)
    return fit(df, ORDERS).transform(df, keep=("o_orderkey",)).withColumn("o_orderdate", r(F.col("o_orderdate"), 8))


@query("SELECT c_mktsegment, CAST(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END AS BIGINT) AS total, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())")
def group_stats_grouping_sets(spark, d):
    return t(spark, d, "customer").groupingSets([["c_mktsegment"], []], "c_mktsegment").agg(F.grouping_id().cast("long").alias("total"), F.count("*").alias("n"), r(F.avg("c_acctbal")).alias("mean"), r(F.stddev_pop("c_acctbal")).alias("std"))


# ---------------------------------------------------------------- sources and preparation


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders")
def scan_project(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query("SELECT * FROM (VALUES ('c_acctbal', 'numeric', true), ('c_mktsegment', 'categorical', true)) AS v(field, dtype, valid)")
def validate_frame(spark, d):
    from tessera.contracts import Dataset

    data = Dataset.parse(CUSTOMERS)
    data.check(t(spark, d, "customer").schema)
    return spark.createDataFrame([(f.name, f.dtype, True) for f in data.usable], "field string, dtype string, valid boolean")


@query("SELECT s_suppkey AS id, s_acctbal AS balance, 'supplier' AS origin FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer WHERE c_acctbal > 0")
def prep_filter_union(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("origin"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("origin"))
    return s.unionByName(c).dropna(subset=["balance"]).where("balance > 0")


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), m) AS x FROM lineitem, (SELECT median(nullif(l_discount, 0)) AS m FROM lineitem)")
def impute_median(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("x"))
    return prep.impute(df, prep.medians(df, ["x"]))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS x FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def standardize(spark, d):
    df = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return prep.standardize(df, prep.scales(df, ["x"])).withColumn("x", r(F.col("x")))


@query("WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_name, row_number() OVER (ORDER BY n DESC, p_name) - 1 AS place, count(*) OVER () AS total FROM c) SELECT p_partkey, CAST(CASE WHEN total > 16 AND place >= 15 THEN 15 ELSE place END AS INTEGER) AS slot FROM part JOIN k USING (p_name)")
def onehot_topk(spark, d):
    df = t(spark, d, "part").select("p_partkey", "p_name")
    return prep.one_hot(df, "p_name", prep.ranked_levels(df, "p_name", 16), "slot").select("p_partkey", "slot")


@query("""SELECT 'value' AS "column", 0e0 AS missing_rate, count(DISTINCT value) AS cardinality, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90, CAST(NULL AS VARCHAR) AS top_shares FROM events
UNION ALL SELECT 'event_type', 0e0, count(DISTINCT event_type), NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT string_agg(printf('%.6f', s), ',' ORDER BY s DESC, event_type) FROM (SELECT event_type, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM events GROUP BY 1 ORDER BY s DESC, event_type LIMIT 5)) FROM events""")
def column_statistics(spark, d):
    s = prep.summaries(t(spark, d, "events"), ["value"], ["event_type"])
    shares = F.array_join(F.transform("top_shares", lambda x: F.format_string("%.6f", x)), ",")
    return s.select("column", "missing_rate", "cardinality", "min", "max", *(r(F.col(x)).alias(x) for x in ("mean", "std", "q10", "q50", "q90")), F.when(F.col("top_shares").isNotNull(), shares).alias("top_shares"))


@query("SELECT true AS varies, false AS constant_varies")
def screen_constant(spark, d):
    df = folds.by_key(t(spark, d, "orders"), "o_orderkey", 3)
    constant = prep.varying(df, F.col("o_totalprice") * 0, "fold", 3).withColumnRenamed("varies", "constant_varies")
    return prep.varying(df, F.col("o_orderstatus"), "fold", 3).join(constant, F.lit(True))


@query("SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat(c_custkey, '|', c_name, '|', c_mktsegment)), 1, 8) AS BIGINT)) AS BIGINT) AS total FROM customer")
def row_digest(spark, d):
    """Identity of data whatever its order: how many rows, and the sum of their hashes."""
    h = F.md5(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").cast("binary"))
    return t(spark, d, "customer").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(h, 1, 8), 16, 10).cast("long")).alias("total"))


# ---------------------------------------------------------------- folds


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 3 AS INTEGER) AS fold FROM orders")
def fold_stratified(spark, d):
    return folds.stratified(t(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey"), 3).select("o_orderkey", "fold")


@query("SELECT count(*) AS rows, 5 AS folds, true AS even FROM orders")
def fold_kfold(spark, d):
    sizes = folds.kfold(t(spark, d, "orders"), "o_orderkey", 5, seed=3).groupBy("fold").count()
    even = F.max(F.abs(F.col("count") / F.lit(t(spark, d, "orders").count()) - 0.2)) < 0.05
    return sizes.agg(F.sum("count").alias("rows"), F.count("*").cast("int").alias("folds"), even.alias("even"))


@query("WITH s AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS place FROM events GROUP BY 1) SELECT event_id, CAST(CASE WHEN place % 6 < 3 THEN place % 6 ELSE 5 - place % 6 END AS INTEGER) AS fold FROM events JOIN s USING (user_id)")
def fold_group(spark, d):
    return folds.group(t(spark, d, "events"), "user_id", 3).select("event_id", "fold")


@query("WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, CAST(CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE 1 + (i - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS block FROM e")
def fold_time(spark, d):
    return folds.expanding_time(t(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "block")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.25e0) AS held_out FROM orders")
def holdout_stratified(spark, d):
    return folds.holdout(t(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey")).select("o_orderkey", "held_out")


@query("SELECT count(*) AS overlapping FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def fold_disjoint(spark, d):
    return folds.disjoint(folds.kfold(t(spark, d, "orders"), "o_orderkey", 3, 7), "o_orderkey").agg(F.count("*").alias("overlapping"))


@query("SELECT l_orderkey, count(DISTINCT l_linestatus) AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def split_conflicts(spark, d):
    return evidence.split_conflicts(t(spark, d, "lineitem"), ["l_orderkey"], "l_linestatus")


@query("SELECT concept, name, score FROM (SELECT p_brand AS concept, p_partkey AS name, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place = 1 ORDER BY score DESC, name LIMIT 5")
def retrieve_concepts(spark, d):
    columns = t(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("score"))
    return retrieval.concepts(columns, 5)


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS fold FROM orders")
def fold_by_key(spark, d):
    return folds.by_key(t(spark, d, "orders"), "o_orderkey", 5).select("o_orderkey", "fold")


# ---------------------------------------------------------------- metrics

AUC = "SELECT {1}round(sum(p * (b + q / 2e0)) / (CAST(sum(p) AS DOUBLE) * sum(q)), 8) AS {2} FROM (SELECT *, coalesce(sum(q) OVER ({3}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({0}))"


@query(AUC.format("SELECT l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1", "", "auc", ""))
def metric_auc(spark, d):
    return metrics.auc(t(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select(r(F.col("auc"), 8).alias("auc"))


OVR = " UNION ALL ".join(f"SELECT '{k}' AS cls, {c} AS s, count(*) FILTER (l_returnflag = '{k}') AS p, count(*) FILTER (l_returnflag <> '{k}') AS q FROM lineitem GROUP BY 1, 2" for k, c in (("A", "l_quantity"), ("N", "l_extendedprice"), ("R", "l_discount")))


@query("SELECT round(sum(a * p) / sum(p), 8) AS auc_ovr FROM (SELECT cls, sum(p) AS p, sum(p * (b + q / 2e0)) / (CAST(sum(p) AS DOUBLE) * sum(q)) AS a FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (" + OVR + ")) GROUP BY cls)")
def metric_auc_ovr(spark, d):
    return metrics.auc_ovr(t(spark, d, "lineitem"), "l_returnflag", {"A": "l_quantity", "N": "l_extendedprice", "R": "l_discount"}).select(r(F.col("auc_ovr"), 8).alias("auc_ovr"))


PREDICTED = "SELECT o_orderstatus AS l, CASE o_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE o_orderstatus END AS p FROM orders"


def predicted(spark, d):
    k = F.pmod("o_orderkey", F.lit(4))
    return t(spark, d, "orders").select(F.col("o_orderstatus").alias("l"), F.when(k == 0, "F").when(k == 1, "O").when(k == 2, "P").otherwise(F.col("o_orderstatus")).alias("p"))


@query(f"SELECT round(avg(CAST(l = p AS DOUBLE)), 8) AS accuracy FROM ({PREDICTED})")
def metric_accuracy(spark, d):
    return predicted(spark, d).agg(r(metrics.accuracy("l", "p"), 8).alias("accuracy"))


@query(f"WITH x AS ({PREDICTED}), c AS (SELECT k, count(*) FILTER (l = k) AS support, count(*) FILTER (p = k) AS called, count(*) FILTER (l = k AND p = k) AS hit FROM x, (SELECT DISTINCT l AS k FROM x) GROUP BY k) SELECT round(sum(support * 2e0 * hit / (support + called)) / sum(support), 8) AS f1 FROM c")
def metric_f1(spark, d):
    return metrics.f1(predicted(spark, d), "l", "p").select(r(F.col("f1"), 8).alias("f1"))


@query("SELECT round(-avg(ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN l_returnflag = 'R' THEN l_discount * 5 ELSE 1 - l_discount * 5 END)))), 8) AS log_loss FROM lineitem")
def metric_log_loss(spark, d):
    p = F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 5).otherwise(1 - F.col("l_discount") * 5)
    return t(spark, d, "lineitem").agg(r(metrics.log_loss(p), 8).alias("log_loss"))


def _regression(column, digits=6):
    return lambda spark, d: t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")).agg(r(column("y", "p"), digits).alias("x"))


X = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
for _name, _column, _sql in (("rmse", metrics.rmse, "sqrt(avg((y - p) * (y - p)))"), ("mae", metrics.mae, "avg(abs(y - p))"), ("r2", metrics.r2, "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))")):
    QUERIES[f"metric_{_name}"] = _regression(_column, 4)
    SQL[f"metric_{_name}"] = f"SELECT round({_sql}, 4) AS x FROM {X}"


@query(f"WITH {B}, k AS (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY fold, o_totalprice) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY fold ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY fold, c_acctbal) - 1) / 2e0 AS ry FROM b) SELECT fold, round(corr(rx, ry), 8) AS rho, CASE WHEN corr(rx, ry) > 0.05 THEN 'increasing' WHEN corr(rx, ry) < -0.05 THEN 'decreasing' ELSE 'unknown' END AS direction FROM k GROUP BY fold")
def spearman_direction(spark, d):
    s = metrics.spearman(orders(spark, d), "o_totalprice", "c_acctbal", ["fold"])
    return s.select("fold", r(F.col("rho"), 8).alias("rho"), metrics.direction(F.col("rho")).alias("direction"))


@query("SELECT round(avg(m), 8) AS mean FROM (SELECT o_orderkey % 3 AS fold, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS m FROM orders GROUP BY 1)")
def fold_metric_mean(spark, d):
    return folds.by_key(t(spark, d, "orders"), "o_orderkey", 3).groupBy("fold").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("m")).agg(r(F.avg("m"), 8).alias("mean"))


# ---------------------------------------------------------------- ledger

LEDGER_ROWS = [
    (0, "COMPLETE", 0.800, None, 2, False, 1.0, 1.0, 0, 0.0, "s0", True),
    (1, "COMPLETE", 0.810, 0, 2, True, 1.0, 2.0, 10, 0.0, "s1", True),
    (2, "COMPLETE", 0.805, 0, 2, True, 1.0, 3.0, 10, 0.1, "s2", True),
    (3, "FAIL", None, 1, 1, True, 0.5, 0.0, 10, 0.1, "s3", False),
    (4, "COMPLETE", 0.820, 1, 2, True, 1.0, 0.0, 10, 0.2, "s4", True),
    (5, "DUPLICATE", 0.810, 1, 0, True, 0.1, 0.0, 5, 0.0, "s1", False),
    (6, "COMPLETE", 0.825, 4, 2, True, 1.0, 8.0, 20, None, "s6", True),
    (7, "COMPLETE", 0.815, 4, 2, True, 2.0, 0.0, 20, 0.3, "s7", False),
]
LEDGER = "number int, state string, value double, parent int, model_fits long, valid_proposal boolean, duration double, elapsed double, tokens long, api_cost double, signature string, expandable boolean"


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


def _values(rows, schema: str) -> str:
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, x)) + ')' for x in rows)}) AS v({names}))"


T = f"t AS {_values(LEDGER_ROWS, LEDGER)}"
CURVE = f"""{T}, s AS (SELECT *, sum(CAST(coalesce(elapsed, 0) > 0 AS INTEGER)) OVER w AS segment, sum(CAST(state = 'COMPLETE' AND valid_proposal AS INTEGER)) OVER w AS evaluations, sum(model_fits) OVER w AS fits, sum(tokens) OVER w AS total_tokens, min(CAST(api_cost IS NOT NULL AS INTEGER)) OVER w AS known, sum(coalesce(api_cost, 0)) OVER w AS spent FROM t WINDOW w AS (ORDER BY number ROWS UNBOUNDED PRECEDING)),
c AS (SELECT number, state, value, CAST(evaluations AS BIGINT) AS evaluations, CAST(fits AS BIGINT) AS fits, CAST(total_tokens AS BIGINT) AS tokens, max(elapsed) OVER (PARTITION BY segment) + sum(CASE WHEN elapsed > 0 THEN 0 ELSE duration END) OVER (PARTITION BY segment ORDER BY number ROWS UNBOUNDED PRECEDING) AS seconds, CASE WHEN known = 1 THEN spent END AS cost FROM s), curve AS (SELECT * FROM c WHERE state = 'COMPLETE')"""


def ledger(spark) -> DataFrame:
    return spark.createDataFrame(LEDGER_ROWS, LEDGER)


@query(f"WITH {T} SELECT number, state, value, parent, signature FROM t")
def trials_view(spark, d):
    """Written to a transactional store and read back as a table."""
    import os
    import tempfile

    from tessera.sources.ledger import Ledger

    with tempfile.TemporaryDirectory() as folder:
        store = Ledger(os.path.join(folder, "ledger.db"))
        names = [c.split()[0] for c in LEDGER.split(", ")]
        for row in LEDGER_ROWS:
            store.save(dict(zip(names, row, strict=True)))
        return store.view(spark, "number int, state string, value double, parent int, signature string")


@query(f"WITH {CURVE} SELECT number, state, value, evaluations, fits, tokens, round(seconds, 6) AS seconds, round(cost, 6) AS cost FROM curve")
def efficiency_curve(spark, d):
    c = evidence.efficiency_curve(ledger(spark))
    return c.withColumns({"seconds": r(F.col("seconds")), "cost": r(F.col("cost"))})


@query(f"WITH {CURVE}, g AS (SELECT *, value - (SELECT arg_min(value, number) FROM curve) AS gain FROM curve), f AS (SELECT max(gain) AS final FROM g) SELECT arg_min(evaluations, number) FILTER (gain >= 0.005 - 1e-12) AS fixed_target, arg_min(evaluations, number) FILTER (final > 0 AND gain >= 0.95 * final - 1e-12) AS relative_target FROM g, f")
def target_attainment(spark, d):
    return evidence.target_attainment(evidence.efficiency_curve(ledger(spark)), 0.005)


@query(f"WITH {CURVE}, p AS (SELECT *, max(value) OVER (ORDER BY fits, value DESC, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM curve) SELECT number, value, fits FROM p WHERE prev IS NULL OR value > prev")
def pareto_frontier(spark, d):
    return evidence.pareto(evidence.efficiency_curve(ledger(spark)), "fits").select("number", "value", "fits")


@query(f"WITH {T} SELECT number, value FROM t WHERE state = 'COMPLETE' ORDER BY value DESC, number LIMIT 1")
def best_trial(spark, d):
    return evidence.best_trial(ledger(spark)).select("number", "value")


@query(f"WITH {T} SELECT number, value FROM t WHERE state = 'COMPLETE' ORDER BY value DESC, number LIMIT 5")
def elite_top5(spark, d):
    return evidence.elites(ledger(spark)).select("number", "value")


@query(f"WITH {T}, k AS (SELECT number, value, row_number() OVER (ORDER BY value DESC, number) - 1 AS place FROM t WHERE state = 'COMPLETE' AND expandable AND number <= 6) SELECT number, value, CAST(place AS INTEGER) AS place, place = 7 % 3 AS parent FROM k WHERE place < 3")
def beam_frontier(spark, d):
    return evidence.beam_frontier(ledger(spark), 8, 3)


@query(f"WITH {T} SELECT t.number, round(t.value - b.value, 9) AS delta, round(t.value - p.value, 9) AS parent_delta FROM t LEFT JOIN t AS b ON b.number = 0 LEFT JOIN t AS p ON p.number = t.parent")
def trial_deltas(spark, d):
    return evidence.deltas(ledger(spark)).select("number", r(F.col("delta"), 9).alias("delta"), r(F.col("parent_delta"), 9).alias("parent_delta"))


@query(f"WITH {T} SELECT t.number, min(o.number) AS original FROM t JOIN t AS o ON o.signature = t.signature AND o.state = 'COMPLETE' AND o.number < t.number GROUP BY 1")
def duplicate_trials(spark, d):
    return evidence.duplicates(ledger(spark))


HISTORY_ROWS = [(1, "size", "supported"), (1, "ratio", "rejected"), (2, "size", "strongly_supported"), (3, "ratio", "rejected"), (3, "time", "rejected"), (4, "time", "inconclusive"), (5, "share", "supported"), (6, "spread", "rejected"), (6, "level", "rejected")]
HISTORY = "trial int, concept string, status string"
H = f"h AS {_values(HISTORY_ROWS, HISTORY)}"


def history(spark) -> DataFrame:
    return spark.createDataFrame(HISTORY_ROWS, HISTORY)


@query(f"WITH {H} SELECT concept, status, count(*) AS n FROM h GROUP BY 1, 2")
def concept_summary(spark, d):
    return evidence.concept_counts(history(spark))


@query(f"WITH {H}, k AS (SELECT CASE WHEN status = 'rejected' THEN 'rejected' ELSE 'useful' END AS kind, concept, count(*) AS n, min(trial) AS first FROM h WHERE status <> 'inconclusive' GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first, concept) AS place FROM k) SELECT kind, concept, n, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3")
def search_memory(spark, d):
    return evidence.memory(history(spark), 3)


NODE_ROWS = [("a", 1, "h1", "x"), ("b", 2, "h2", "a"), ("a", 2, "h1", "x"), ("c", 3, "h3", "b"), ("z", 4, "h1", "x"), ("e", 4, "h4", "x")]
NODES = "name string, trial int, hash string, inputs string"


@query(f"SELECT name, trial, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY trial, name) AS r FROM {_values(NODE_ROWS, NODES)}) WHERE r = 1")
def lineage(spark, d):
    return evidence.lineage(spark.createDataFrame(NODE_ROWS, NODES)).select("name", "trial", "hash")


@query(f"WITH n AS (SELECT DISTINCT name, inputs FROM {_values(NODE_ROWS, NODES)}) SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT inputs FROM n)")
def leaf_features(spark, d):
    n = spark.createDataFrame(NODE_ROWS, NODES).select("name", F.array("inputs").alias("inputs")).distinct()
    return evidence.unused(n).distinct()


RECORD_ROWS = [(1, '[{"name": "a", "op": "square", "inputs": ["x"]}, {"name": "b", "op": "add", "inputs": ["a", "x"]}]'), (2, "[]"), (3, '[{"name": "c", "op": "abs", "inputs": ["y"]}]')]


@query(f"SELECT trial, json_extract_string(f, '$.name') AS name, json_extract_string(f, '$.op') AS op, CAST(json_array_length(f, '$.inputs') AS INTEGER) AS inputs FROM (SELECT trial, unnest(CAST(features AS JSON[])) AS f FROM {_values(RECORD_ROWS, 'trial int, features string')})")
def feature_history(spark, d):
    rows = spark.createDataFrame(RECORD_ROWS, "trial int, features string")
    f = rows.select("trial", F.explode(F.from_json("features", "array<struct<name:string,op:string,inputs:array<string>>>")).alias("f"))
    return f.select("trial", "f.name", "f.op", F.size("f.inputs").alias("inputs"))


@query(f"SELECT trial, CAST(json_array_length(features) AS INTEGER) AS proposed FROM {_values(RECORD_ROWS, 'trial int, features string')}")
def proposal_history(spark, d):
    rows = spark.createDataFrame(RECORD_ROWS, "trial int, features string")
    return rows.select("trial", F.size(F.from_json("features", "array<struct<name:string>>")).alias("proposed"))


VERDICT_ROWS = [("a", 0.1, True, 3, 3, True), ("b", 0.1, True, 2, 3, True), ("c", 0.1, False, 1, 3, True), ("d", None, True, 3, 3, True), ("e", 0.1, None, 0, 3, True), ("f", 0.1, True, 3, 3, False)]
VERDICTS = "name string, importance double, improves boolean, better int, folds int, fits boolean"


@query(f"SELECT name, CASE WHEN improves IS NULL THEN 'retained' WHEN NOT improves THEN 'rejected' WHEN importance IS NULL OR importance <= 0 THEN 'inconclusive' WHEN fits AND better / CAST(folds AS DOUBLE) >= 0.8 THEN 'strongly_supported' WHEN fits THEN 'supported' ELSE 'inconclusive' END AS status FROM {_values(VERDICT_ROWS, VERDICTS)}")
def hypothesis_status(spark, d):
    rows = spark.createDataFrame(VERDICT_ROWS, VERDICTS)
    return rows.select("name", evidence.verdict(F.col("importance"), F.col("improves"), F.col("better"), F.col("folds"), F.col("fits")).alias("status"))


RUN_ROWS = [("x", 11, "base", 0.70, 1.0), ("x", 22, "base", 0.72, 1.1), ("x", 11, "random", 0.73, 2.0), ("x", 22, "random", 0.71, 2.2), ("y", 11, "base", 0.60, 1.0), ("y", 11, "random", 0.66, 3.0), ("y", 22, "base", 0.61, 1.2), ("y", 22, "random", 0.62, 2.9)]
RUNS = "dataset string, seed int, method string, score double, seconds double"


def runs(spark) -> DataFrame:
    return spark.createDataFrame(RUN_ROWS, RUNS)


@query(f"WITH u AS {_values(RUN_ROWS, RUNS)} SELECT a.dataset, a.seed, round(a.score - b.score, 9) AS difference FROM u AS a JOIN u AS b ON a.dataset = b.dataset AND a.seed = b.seed AND b.method = 'base' WHERE a.method = 'random'")
def paired_runs(spark, d):
    return evidence.paired(runs(spark).where("method = 'random'"), runs(spark).where("method = 'base'"), ["dataset", "seed"], "score").select("dataset", "seed", r(F.col("difference"), 9).alias("difference"))


@query(f"SELECT dataset, method, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS sd, count(*) AS n, round(sum(seconds), 9) AS seconds FROM {_values(RUN_ROWS, RUNS)} GROUP BY 1, 2")
def benchmark_summary(spark, d):
    return runs(spark).groupBy("dataset", "method").agg(r(F.avg("score"), 9).alias("mean"), r(F.stddev_samp("score"), 9).alias("sd"), F.count("*").alias("n"), r(F.sum("seconds"), 9).alias("seconds"))


@query()
def bootstrap_ci(spark, d):
    pairs = evidence.paired(runs(spark).where("method = 'random'"), runs(spark).where("method = 'base'"), ["dataset", "seed"], "score")
    return evidence.bootstrap(pairs, "difference")


# ---------------------------------------------------------------- retrieval

WIDE_ROWS = [("loan_amount", "credit", "loan amount credit finance"), ("income", "credit", "monthly income of the person"), ("repaid", "credit", "repayment history of the loan"), ("sensor_1", "device", "device measurement one"), ("sensor_2", "device", "device measurement two"), ("age", "profile", "age of the person in years")]
WIDE = "name string, concept string, document string"


def wide(spark) -> DataFrame:
    return spark.createDataFrame(WIDE_ROWS, WIDE)


GRAMS = """w AS (SELECT k, concat(' ', unnest(list_filter(string_split(trim(regexp_replace(lower(translate(doc, '_', ' ')), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')), ' ') AS p FROM docs),
g AS (SELECT k, substr(p, i, n) AS gram FROM (SELECT k, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4]) AS n) WHERE length(p) >= n)),
tf AS (SELECT k, gram, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT k, tf.gram, tf * (ln((1 + (SELECT count(*) FROM docs)) / CAST(1 + df AS DOUBLE)) + 1) AS v FROM tf JOIN df USING (gram)),
norm AS (SELECT k, sqrt(sum(v * v)) AS l FROM x GROUP BY 1), weights AS (SELECT k, gram, v / l AS weight FROM x JOIN norm USING (k))"""


@query(f"WITH docs AS (SELECT p_partkey AS k, p_name AS doc FROM part), {GRAMS} SELECT k AS p_partkey, gram, round(weight, 8) AS weight FROM weights")
def tfidf_char_ngrams(spark, d):
    return retrieval.tfidf(t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name").select("p_partkey", "gram", r(F.col("weight"), 8).alias("weight"))


SCORED = f"docs AS (SELECT name AS k, document AS doc FROM {_values(WIDE_ROWS, WIDE)} UNION ALL SELECT '?', 'loan repayment income'), {GRAMS}, scored AS (SELECT n.name, coalesce(s.score, 0) AS score FROM {_values(WIDE_ROWS, WIDE)} AS n LEFT JOIN (SELECT a.k, sum(a.weight * b.weight) AS score FROM weights AS a JOIN weights AS b ON a.gram = b.gram AND b.k = '?' WHERE a.k <> '?' GROUP BY 1) AS s ON s.k = n.name)"


@query(f"WITH {SCORED} SELECT name, round(score, 8) AS score FROM scored ORDER BY score DESC, name LIMIT 3")
def retrieve_semantic(spark, d):
    return retrieval.semantic(wide(spark), "loan repayment income", 3).select("name", r(F.col("score"), 8).alias("score"))


@query(f"SELECT name, CAST(CAST(contains(document, 'loan') AS INTEGER) + CAST(contains(document, 'person') AS INTEGER) AS INTEGER) AS score FROM {_values(WIDE_ROWS, WIDE)} ORDER BY score DESC, name LIMIT 3")
def retrieve_rule(spark, d):
    return retrieval.rule(wide(spark), ["loan", "person"], 3)


@query(f"SELECT name FROM {_values(WIDE_ROWS, WIDE)} ORDER BY md5(concat('7:1:', name)), name LIMIT 3")
def retrieve_random(spark, d):
    return retrieval.random(wide(spark), 3, 7, 1).select("name")


@query(f"WITH {SCORED}, f AS (SELECT name, 0 AS part, row_number() OVER (ORDER BY score DESC, name) AS place FROM scored QUALIFY place <= 2), s AS (SELECT name, 1 AS part, row_number() OVER (ORDER BY md5(concat('7:1:', name)), name) AS place FROM scored), u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part, place) AS r FROM (SELECT * FROM f UNION ALL SELECT * FROM s)) SELECT name FROM u WHERE r = 1 ORDER BY part, place LIMIT 4")
def retrieve_hybrid(spark, d):
    return retrieval.hybrid(wide(spark), "loan repayment income", 4, 7, 1)


# ---------------------------------------------------------------- models


def _planted(spark, d) -> tuple[DataFrame, dict]:
    """Orders with a target that a ratio of two fields decides."""
    df = orders(spark, d).withColumn("label", (F.col("o_totalprice") / F.greatest(F.col("c_acctbal"), F.lit(1.0)) > 50).cast("double"))
    return df, {"fields": [f for f in ORDERS["fields"] if not f.get("exclude")][:2]}


@query()
def cross_validated_model(spark, d):
    """A logistic model on three folds, without and with the ratio; metrics averaged over folds."""
    from tessera.operators.evaluate import evaluate
    from tessera.plans.graph import Graph

    df, data = _planted(spark, d)
    from tessera.contracts import Dataset

    data, rows = Dataset.parse(data), []
    for name, features in (("raw", []), ("log_ratio", [Feature("ratio", "divide", ("o_totalprice", "c_acctbal")), Feature("size", "log1p_abs", ("ratio",))])):
        found = evaluate(df, Graph.of(data, features), "label", "fold", ["auc", "log_loss"], "logistic", explain=False)
        rows.append((name, found.metrics["auc"], found.metrics["log_loss"], found.fits))
    return spark.createDataFrame(rows, "features string, auc double, log_loss double, fits int")


@query()
def permutation_importance(spark, d):
    from tessera.contracts import Dataset
    from tessera.operators.evaluate import evaluate
    from tessera.plans.graph import Graph

    df, data = _planted(spark, d)
    found = evaluate(df, Graph.of(Dataset.parse(data), [Feature("size", "log1p_abs", ("c_acctbal",))]), "label", "fold", ["auc"], "logistic", row_id="o_orderkey")
    return spark.createDataFrame(sorted(found.importance.items()), "column string, importance double")
