"""URL filters: rules, and for other urls the trust of their host in the link graph.

Rules name a host and a path; one fits a url of that host or a subdomain whose
path starts with the rule's, and the longest wins. For the rest, hosts judge:
links from page to page are summed to host edges; personalised PageRank runs
forward from trusted hosts and, in the same passes, distrust runs backward from
blocked hosts (who links to them is suspect), until the ranks settle. A host's
seeds are the shares of its pages that rules allow and block. A host is blocked
when distrust makes up more than SHARE of its trust and distrust together and
is at least LEAST of what a fully blocked host has of itself, so that hosts
which link to blocked ones, or to hosts that do, are blocked unless trust or
distance outweighs it.

Defined results: a null url, or one without ://, has an empty host and path,
fits no rule and is allowed unless its (empty) host is; null pages have no
links; repeated rows are judged alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _core as c

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Rounds go on until the ranks change by less than this share of all seeds.
TOLERANCE = 1e-4
SHARE, LEAST = 0.5, 0.1
#: Hosts whose verdicts may be broadcast to the pages (about 40 bytes each).
BROADCAST_HOSTS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def matching(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null. Rules are few; their list is part of the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of src that link to dst, for different hosts."""
    host, _ = host_and_path(F.col("url"))
    links = pages.where(F.col("html").contains("//")).select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst"))
    return links.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: c.Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of all hosts that a seed's rank reaches. ``seeds`` has host, trust and distrust.

    What still moves shrinks by the damping in every round, so the rounds end.
    """
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed")).where("seed > 0")
    start = scratch.put(start.withColumn("seed", F.col("seed") * (1 - damping)), "seeds")
    edges = scratch.put(edges, "edges")
    ranks = start.withColumnRenamed("seed", "value")
    if edges.limit(1).count():
        sums = lambda k: edges.groupBy(k).agg(F.sum("n").alias("total"))
        forward = edges.join(sums("src"), "src").select(F.col("src").alias("host"), F.lit("trust").alias("kind"), F.col("dst").alias("to"), (damping * F.col("n") / F.col("total")).alias("share"))
        backward = edges.join(sums("dst"), "dst").select(F.col("dst").alias("host"), F.lit("distrust").alias("kind"), F.col("src").alias("to"), (damping * F.col("n") / F.col("total")).alias("share"))
        flows = scratch.put(forward.unionByName(backward), "flows")
        # Every round sends on only what the last one moved; ranks are sums of all that has moved.
        moved, ranks = start.withColumnRenamed("seed", "value"), [start.withColumnRenamed("seed", "value")]
        whole = left = start.agg(F.coalesce(F.sum("seed"), F.lit(0.0))).first()[0]
        k = 0
        while left > tolerance * whole:
            sent = flows.join(moved, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("share") * F.col("value")).alias("value"))
            moved = scratch.put(sent.groupBy("host", "kind").agg(F.sum("value").alias("value")), f"moved-{k}")
            left = moved.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
            ranks.append(moved)
            k += 1
            if len(ranks) == 8:  # few tables at a time
                ranks = [scratch.put(functools.reduce(DataFrame.unionByName, ranks).groupBy("host", "kind").agg(F.sum("value").alias("value")), f"ranks-{k}")]
        ranks = functools.reduce(DataFrame.unionByName, ranks)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, and the host's trust and distrust."""
    scratch = c.Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", matching(F.col("host"), F.col("path"), rules))
    part = lambda v: F.avg(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = own.where("host <> ''").groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    hosts = scratch.put(propagate(seeds, host_edges(pages), scratch, damping), "hosts")
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    bad = (F.col("distrust") > share * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") >= least * (1 - damping))
    return own.join(side, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op9_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
