"""Exact top-k inner-product search with ball trees.

Vectors are dealt to shards of bounded size; each shard builds a ball tree
(balls of centre and radius, split at the median of the widest direction).
Queries come in blocks. A block goes down a tree level by level: a ball's inner
products with query q are at most q.centre + |q| radius, and pairs of query and
ball whose bound is under the query's k-th score so far are cut. The leaves
left are scored in the order of their bounds, and each raises the k-th scores
at once for what follows. A first pass searches one shard for each block; the
k-th scores found there are shared with all other shards in the second pass.

Scores are integers: components are floor(64 x). Sums that could pass 2**53 are
formed in exact integer arithmetic, of any size where they could pass 2**63; a
score beyond a long's range is shown (and ranked) as the end of that range.

Defined results: vectors that are null, empty or hold null or non-finite
components (or components so large that 64 x is infinite), and rows with null
ids take no part; scores exist between vectors of one length only; repeated
query rows give their result once, repeated candidate rows each count (ties in
score and id in any order, as they are equal); an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import _core as c

SCALE = 64
TOP = 20
EVERY = 20
#: The least score that is shown, which is safe to negate.
NONE = -(2**63) + 1
SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 12
#: Queries of a block that are searched at a time.
AT_ONCE = 1 << 10
LEAF_ROWS = 128


class BallTree:
    """Balls in levels; all leaves lie on the last. ``order`` holds the rows leaf by leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        groups, self.levels = [np.arange(len(ids))], []
        x = vectors.astype(np.float64)
        for level in range(depth + 1):
            if level:
                groups = [half for g in groups for half in self._halves(g, x)]
            centre = np.stack([x[g].mean(axis=0) for g in groups])
            radius = np.array([np.sqrt(((x[g] - m) ** 2).sum(axis=1).max()) for g, m in zip(groups, centre, strict=True)])
            self.levels.append((centre, radius))
        self.leaves = [np.sort(g) for g in groups]
        self.ids, self.vectors = ids, vectors

    @staticmethod
    def _halves(rows: np.ndarray, x: np.ndarray):
        own = x[rows]
        # The direction to the row farthest from the mean; ties by position.
        away = own - own.mean(axis=0)
        along = own @ away[(away**2).sum(axis=1).argmax()]
        cut = np.argsort(along, kind="stable")
        half = (len(rows) + 1) // 2
        return rows[cut[:half]], rows[cut[half:]] if len(rows) > half else rows[cut[:half]][:1]

    def search(self, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        """(query, id, score) of up to k best rows of each query that reach its ``kth`` score (which may be minus infinity)."""
        qf = q.astype(np.float64)
        norm = np.sqrt((qf**2).sum(axis=1))
        slack = 1 + 1e-6 * norm * (np.abs(self.vectors).max(initial=0) + 1) * np.sqrt(q.shape[1])  # far over the rounding of a bound
        who, ball = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level, (centre, radius) in enumerate(self.levels):
            bounds = qf @ centre.T + norm[:, None] * radius + slack[:, None]
            keep = bounds[who, ball] >= kth[who]
            who, ball = who[keep], ball[keep]
            if level + 1 < len(self.levels):
                who, ball = np.repeat(who, 2), np.stack([2 * ball, 2 * ball + 1], axis=1).ravel()
        bound = bounds[who, ball]
        order = np.lexsort((-bound, who))
        who, ball, bound = who[order], ball[order], bound[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        most = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(q).max(initial=0)) * q.shape[1]
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        kth = kth.copy()
        r, width = 0, 1
        while r <= int(rank.max(initial=-1)):
            # Each query's next leaves; twice as many each time, as the k-th scores move less and less.
            now = np.flatnonzero((rank >= r) & (rank < r + width) & (bound >= kth[who]))
            r, width = r + width, 2 * width
            found = [best]
            now = now[np.argsort(ball[now], kind="stable")]
            for part in np.split(now, np.flatnonzero(np.diff(ball[now])) + 1) if len(now) else ():
                rows, own = self.leaves[ball[part[0]]], who[part]
                s = inner(q[own], self.vectors[rows], most)
                i, j = np.nonzero((s >= kth[own][:, None]) & (self.ids[rows] != qid[own][:, None]))
                found.append((own[i], self.ids[rows[j]], s[i, j]))
            i, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, -s, i))
            i, ids, s = i[order], ids[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < k
            best = i[top], ids[top], s[top]
            full = np.flatnonzero(place == k - 1)
            kth[i[full]] = np.maximum(kth[i[full]], s[full].astype(np.float64))
        return best


def inner(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of rows of whole numbers (as doubles); ``most`` bounds their size."""
    if most < 2**53:
        return np.rint(q @ v.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in row] for row in x], object)
    return np.clip(whole(q) @ whole(v).T, NONE, -NONE).astype(np.int64)


def integers(batches):
    """(vec_id, dim, packed whole components) of the vectors that take part."""
    for batch in batches:
        column = batch.column("embedding")
        many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()  # null lists have no values
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)) + 0.0
        ends = np.cumsum(many)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        good = (many > 0) & (bad[ends] == bad[ends - many]) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        blobs = [x[e - n : e].tobytes() for e, n in zip(ends[good].tolist(), many[good].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(many[good], pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "dim", "v"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def build(table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending"), ("v", "ascending")])
    tree = BallTree(table.column("vec_id").to_numpy(), _matrix(table.column("v")))
    return pa.table({"dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def pack_block(table: pa.Table) -> pa.Table:
    """One block of queries; repeated rows once."""
    table = table.sort_by([("vec_id", "ascending"), ("v", "ascending")])
    ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(axis=1)])
    return pa.table({"dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "queries": pa.array([pickle.dumps((ids[new], v[new]))], pa.binary())})


def searcher(k: int):
    """Of a group of one shard's tree and one block of queries (with their k-th scores, if known): each query's best of that shard."""

    def run(table: pa.Table) -> pa.Table:
        empty = {"dim": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "number": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        trees, blocks = [x for x in table.column("tree").to_pylist() if x], [x for x in table.to_pylist() if x["queries"]]
        if not trees or not blocks:
            return pa.table(empty)
        ids, q = pickle.loads(blocks[0]["queries"])
        known = blocks[0]["kth"]
        kth = np.frombuffer(known, np.float64) if known else np.full(len(ids), -np.inf)
        tree, best = pickle.loads(trees[0]), []
        for at in range(0, len(ids), AT_ONCE):
            own = slice(at, at + AT_ONCE)
            i, found, score = tree.search(ids[own], q[own], kth[own], k)
            best.append((i + at, found, score))
        i, found, score = (np.concatenate(x) for x in zip(*best, strict=True))
        return pa.table({"dim": pa.array(np.full(len(i), blocks[0]["dim"], np.int32)), "block": pa.array(np.full(len(i), blocks[0]["block"])), "number": pa.array(i), "query_id": pa.array(ids[i]), "vec_id": pa.array(found), "score": pa.array(score)})

    return run


def search(vectors: DataFrame, queries, k: int = TOP, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that the condition ``queries`` selects, the k best other rows."""
    spark, scratch = vectors.sparkSession, c.Scratch(vectors.sparkSession)
    # Integer vectors once, in narrow rows, from which both shards and query blocks come.
    ready = scratch.put(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(integers, "vec_id long, dim int, v binary"), "integers")
    asked = ready.where(queries)
    sizes = {r["dim"]: r["n"] for r in ready.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    asking = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    many = lambda counts, most: F.coalesce(F.create_map(*(F.lit(int(x)) for d, n in counts.items() for x in (d, -(-n // most))))[F.col("dim")], F.lit(1)) if counts else F.lit(1)
    shards, blocks = many(sizes, shard_rows), many(asking, block_rows)
    # Salted by content as well, so that rows which repeat an id don't share a shard.
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n).cast("long")
    trees = scratch.put(ready.withColumn("shard", deal(shards)).groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, tree binary"), "trees")
    spread = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks).cast("long"))
    packed = scratch.put(spread.groupBy("dim", "block").applyInArrow(pack_block, "dim int, block long, queries binary"), "blocks")
    packed = packed.withColumn("shards", shards.cast("long"))
    home = F.pmod(F.col("block"), F.col("shards"))
    out = "dim int, block long, number long, query_id long, vec_id long, score long"

    def meet(blocks_on_shards: DataFrame, trees_for_blocks: DataFrame) -> DataFrame:
        columns = ["dim", "shard", "block", "tree", "queries", "kth"]
        both = blocks_on_shards.withColumn("tree", F.lit(None).cast("binary")).select(columns).unionByName(trees_for_blocks.withColumns({"queries": F.lit(None).cast("binary"), "kth": F.lit(None).cast("binary")}).select(columns))
        return both.groupBy("dim", "shard", "block").applyInArrow(searcher(k), out)

    none = F.lit(None).cast("binary")
    first_on = packed.withColumn("shard", home).withColumn("kth", none)
    first = scratch.put(meet(first_on, trees.join(first_on.select("dim", "shard", "block"), ["dim", "shard"])), "first")
    counted = first.groupBy("dim", "block", "number").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = counted.groupBy("dim", "block").agg(F.collect_list(F.struct("number", "n", "least")).alias("known"))
    later = packed.join(kth, ["dim", "block"], "left").mapInArrow(attach(k), "dim int, block long, queries binary, shards long, kth binary")
    rest_on = later.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).where(F.col("shard") != home)
    rest = meet(rest_on, trees.join(rest_on.select("dim", "shard", "block"), ["dim", "shard"]))
    w = Window.partitionBy("query_id", "dim", "block", "number").orderBy(F.col("score").desc(), "vec_id")
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def attach(k: int):
    """Each block's k-th scores from the first pass: minus infinity where fewer than k rows were found."""

    def run(batches):
        for batch in batches:
            kth = []
            for queries, known in zip(batch.column("queries").to_pylist(), batch.column("known").to_pylist(), strict=True):
                out = np.full(len(pickle.loads(queries)[0]), -np.inf)
                for x in known or ():
                    if x["n"] >= k:
                        out[x["number"]] = x["least"]
                kth.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("dim", "block", "queries", "shards")), pa.array(kth, pa.binary())], ["dim", "block", "queries", "shards", "kth"])

    return run


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
