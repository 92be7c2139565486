"""Choosing columns of wide schemas: by words, by similarity of character n-grams, at random, or mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "_", " ")), r"\s+", " "))


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Per word, padded by one space on each side, all n-grams that fit; a word shorter than n counts once, whole."""
    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        def size(n: int) -> Column:
            return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: padded.substr(i, F.lit(n)))).otherwise(F.array())
        return F.concat(*(size(n) for n in range(low, high + 1)))
    words = F.filter(F.split(cleaned(text), " "), lambda w: w != "")
    return F.flatten(F.transform(words, of))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, weight): counts times smoothed inverse document frequency, of length one per document."""
    tf = docs.select(key, F.explode(char_grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "gram").withColumn("w", F.col("tf") * (F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def similarity(columns: DataFrame, query: str) -> DataFrame:
    """(name, score): cosine of each column's document to the query, with idf from the columns' documents and the query."""
    spark = columns.sparkSession
    docs = columns.select(F.concat(F.lit("c:"), "name").alias("key"), "document").unionByName(spark.createDataFrame([("q", query)], "key string, document string"))
    w = tfidf(docs, "key", "document")
    q = w.where("key = 'q'").select("gram", F.col("weight").alias("qw"))
    dots = w.where("key <> 'q'").join(q, "gram").groupBy("key").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    return columns.select("name", "concept").join(dots.withColumn("name", F.expr("substr(key, 3)")).drop("key"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def semantic(columns: DataFrame, query: str, k: int, guidance: str = "", useful: tuple[str, ...] = (), boost: float = 0.25) -> DataFrame:
    """The k best by similarity; guidance counts twice, and concepts that helped before get a bonus."""
    s = similarity(columns, " ".join([query, guidance, guidance]).strip())
    s = s.withColumn("score", F.col("score") + F.when(F.col("concept").isin(*useful), boost).otherwise(0.0)) if useful else s
    return s.orderBy(F.col("score").desc(), "name").limit(k)


def concepts(scored: DataFrame, k: int) -> DataFrame:
    """The k concepts whose best column comes first (by score, then name), in that order, each with that column."""
    best = scored.groupBy("concept").agg(F.min(F.struct((-F.col("score")).alias("low"), "name")).alias("best"))
    return best.select("concept", F.col("best.name").alias("name"), (-F.col("best.low")).alias("score")).orderBy(F.col("score").desc(), "name").limit(k)


def rule(columns: DataFrame, tokens: list[str], k: int) -> DataFrame:
    """The k best by how many tokens occur in their documents."""
    hits = sum((F.col("clean").contains(t).cast("int") for t in tokens), F.lit(0))
    return columns.withColumn("clean", cleaned(F.col("document"))).select("name", hits.alias("score")).orderBy(F.col("score").desc(), "name").limit(k)


def random(columns: DataFrame, k: int, seed: int, trial: int) -> DataFrame:
    return columns.select("name", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(trial)), "name").cast("binary")).alias("draw")).orderBy("draw", "name").limit(k)


def hybrid(columns: DataFrame, query: str, k: int, seed: int, trial: int) -> DataFrame:
    """Half by similarity, filled up at random, no column twice."""
    first = semantic(columns, query, (k + 1) // 2).select("name", F.lit(0).alias("part"), F.row_number().over(Window.orderBy(F.col("score").desc(), "name")).alias("place"))
    second = random(columns, 2 * k, seed, trial).select("name", F.lit(1).alias("part"), F.row_number().over(Window.orderBy("draw", "name")).alias("place"))
    once = first.unionByName(second).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("part", "place"))).where("r = 1")
    return once.orderBy("part", "place").limit(k).select("name")
