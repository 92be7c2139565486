"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _core as c

#: A node with more than one in so many of all edge ends is a hub; there are fewer of them than this.
HUBS = 1000


def components(edges: DataFrame, scratch: c.Scratch) -> DataFrame:
    """Of edges (a, b): rows (node, root) of all nodes but the roots, root being the least node of the component.

    Every round links each node's larger neighbours to its least one, and then
    its smaller ones, until stars remain. Minima are combined before the
    shuffle. Minima and edges are written to the shared folder, which keeps
    lineage and plans short and tells their sizes to the optimizer. Minima of
    hubs (fewer than HUBS, whatever the graph), where there are any, are
    broadcast to the edges where they lie, so that no node's neighbours are
    gathered.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0], scratch).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.put(large, "large")
        scratch.drop("least")
        small = _with_least(large, 2 * state[0], scratch).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = scratch.table("least").select("u", F.col("m").alias("v"))
        after = scratch.put(small.unionByName(down).distinct(), "next")
        scratch.drop("least", "large")
        scratch.rename("next", "edges")
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_least(edges: DataFrame, ends: int, scratch: c.Scratch) -> DataFrame:
    """The edges (u, v) with the least neighbour m of u, which is also left as table ``least``; ``ends`` is at least the number of edges given."""
    least = scratch.put(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hub = F.col("n") > ends // HUBS
    if not least.where(hub).limit(1).count():
        return edges.join(least.select("u", "m"), "u")
    marked = edges.join(F.broadcast(least.where(hub).select("u", "m")), "u", "left")
    rest = marked.where("m is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
    return marked.where("m is not null").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
