"""Sharding by extendible hashing.

A document's place is a 60-bit hash of its id. The directory is indexed by
leading hash bits: a bucket over its byte limit splits on one more bit, others
stay. Sums per hash prefix come from one aggregation for ten levels at a time
(map-side combined), rolled up level by level, and only buckets that are still
too large go to the next ten bits.

Defined results: null texts count no bytes; null ids hash like an empty id;
rows that share an id share a hash, so a bucket whose rows all have one hash
can't be split by bits: it is cut into numbered overflow parts, each within
the limit unless it is a single larger document, which gets a shard alone; an
empty table gives no shards; extra columns of any name pass through ``assign``
inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _core as c

BITS = 60
LEVELS = 10
#: Bytes of text in a shard at most.
SHARD_BYTES = 64 << 20
#: Shards that one task fills of a single hash over the limit, about.
LIST_SHARDS = 16
#: Directory entries that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 100_000


def hashed(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def directory(hashes: DataFrame, limit: int, scratch: c.Scratch) -> DataFrame:
    """Leaves of the directory: depth, first hash (``lo``), last hash (``hi``) and bytes. ``hashes`` has columns h and n_bytes."""
    leaves, open_rows, base = None, hashes, 0
    while True:
        top = min(BITS, base + LEVELS)
        cells = open_rows.groupBy(F.shiftright("h", BITS - top).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        # Totals of each level between base and top; the shallowest level that fits is the cell's leaf.
        cells = scratch.put(cells, "cells")
        levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {top} - depth)"))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        # A prefix is a leaf if it fits and its parent doesn't; one that fits at base has its leaf there.
        parent = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        found = scratch.put(fits.join(parent, ["depth", "prefix"], "left_anti").select("depth", "prefix", "bytes"), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        if top == BITS:
            break
        # Cells still too large at the top level.
        over = cells.where(F.col("bytes") > limit).select("cell")
        if not over.limit(1).count():
            break
        open_rows = open_rows.join(over, F.shiftright("h", BITS - top) == F.col("cell"), "left_semi")
        base = top
    return leaves.select("depth", "prefix", "bytes", F.expr(f"shiftleft(prefix, {BITS} - depth)").alias("lo"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth) - 1").alias("hi"))


def assign(documents: DataFrame, limit: int = SHARD_BYTES, scratch: c.Scratch | None = None) -> DataFrame:
    """Of each row: ``row`` (a struct of all its columns), n_bytes, depth, shard (the prefix as bits) and shard_bytes."""
    spark = documents.sparkSession
    scratch = scratch or c.Scratch(spark)
    rows = c.identified(documents.select(F.struct(*(F.col(f"`{x}`") for x in documents.columns)).alias("row")), scratch).withColumns({"h": hashed(F.col("row.doc_id")), "n_bytes": text_size(F.col("row.text"))})
    hashes = scratch.put(rows.select("h", "n_bytes"), "hashes")
    leaves = scratch.put(directory(hashes, limit, scratch), "directory")
    n, deepest = leaves.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    # Rows meet their leaf on the first k bits; leaves above that depth stand in every cell they cover (at most 8 n cells).
    k = min(deepest, max(1, n).bit_length() + 2)
    entries = leaves.select("depth", "prefix", "lo", "hi", F.col("bytes").alias("shard_bytes"), F.explode(F.sequence(F.expr(f"shiftright(lo, {BITS - k})"), F.expr(f"shiftright(hi, {BITS - k})"))).alias("cell"))
    if n * 8 <= BROADCAST_ROWS:
        entries = F.broadcast(entries)
    placed = rows.withColumn("cell", F.shiftright("h", BITS - k)).join(entries, "cell").where("h between lo and hi")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(F.col("prefix")), F.col("depth"), F.lit("0")))
    columns = ("row", "n_bytes", "depth", "shard", "shard_bytes")
    placed = placed.withColumn("shard", bits)
    full = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
    if deepest < BITS or not leaves.where((F.col("depth") == BITS) & (F.col("bytes") > limit)).limit(1).count():
        return placed.select(*columns)
    # One hash over the limit: its rows are dealt to lists of a few shards' bytes, and each list is cut into parts of a
    # running sum in byte order. Rows over half the limit stand alone; smaller ones fill parts of a half, which they pass
    # by less than another half. Only narrow rows are sorted; rows meet their part by their id.
    lists = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / (LIST_SHARDS * limit))).cast("long")
    narrow = placed.where(full).select("uid", "h", "n_bytes", "shard", F.pmod(F.xxhash64("uid"), lists).alias("list"))
    w = Window.partitionBy("h", "list").orderBy("n_bytes", "uid")
    half = max(1, limit // 2)
    before = F.coalesce(F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.when(F.col("n_bytes") > half, F.concat(F.lit("-one-"), F.row_number().over(w).cast("string"))).otherwise(F.concat(F.lit("-"), F.floor(before / half).cast("string")))
    narrow = scratch.put(narrow.withColumn("part", F.concat("shard", F.lit("-"), F.col("list").cast("string"), number)), "overflow")
    sums = narrow.groupBy("h", "part").agg(F.sum("n_bytes").alias("part_bytes"))
    parted = placed.where(full).join(narrow.join(sums, ["h", "part"]).select("uid", "part", "part_bytes"), "uid")
    return placed.where(~full).select(*columns).unionByName(parted.select("row", "n_bytes", "depth", F.col("part").alias("shard"), F.col("part_bytes").alias("shard_bytes")))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, each written by one task per shard. The documents must have no column ``shard``."""
    assigned.select("row.*", "shard").repartition(c.partitions(assigned.sparkSession), "shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str, limit: int = SHARD_BYTES) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs, limit).select("row.doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "shard", "shard_bytes")


OP3_SQL = """
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
levels AS (SELECT unnest(range(0, 31)) AS depth),
sums AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS bytes FROM d, levels GROUP BY ALL),
leaf AS (SELECT doc_id, h, n_bytes, min(depth) AS depth FROM (SELECT d.*, s.depth FROM d, levels l JOIN sums s ON s.depth = l.depth AND s.prefix = d.h >> (60 - l.depth) WHERE s.bytes <= 67108864) GROUP BY ALL)
SELECT doc_id, n_bytes, CAST(leaf.depth AS INTEGER) AS depth, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - leaf.depth)), CAST(leaf.depth AS INTEGER), '0') END AS shard, CAST(s.bytes AS BIGINT) AS shard_bytes
FROM leaf JOIN sums s ON s.depth = leaf.depth AND s.prefix = h >> (60 - leaf.depth)
"""
