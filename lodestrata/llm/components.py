"""Connected components by hash-to-min (Rastogi et al. 2013), on rows instead of collected clusters.

A cluster is kept as rows (node, member), so a component of any size is spread over tasks. In each round a node sends
its cluster to the least member and the least member to its cluster; when no row changes, the least member of each node
names its component. Every round is cut by a reliable checkpoint; only a count and a checksum come to the driver.

The node that a large component gathers at has all its members as rows of one join key. Such nodes (at least HUB rows and
a 1/HUBS of all rows, so at most HUBS of them) get their least member by a broadcast of that bound instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HUB, HUBS = 20_000, 4096


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node in an edge; component is the least node. Null ends and loops are ignored."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = F.explode(F.array(*(F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v, u in (("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")))))
    clusters = cut(e.select(both.alias("s")).select("s.*").distinct())
    mark = None
    for _ in range(rounds):
        least = cut(clusters.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")))
        seen = least.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("top")).first()
        if mark == (seen.n, seen.h):
            return least.select(F.col("v").alias("node"), F.col("m").alias("component"))
        mark = (seen.n, seen.h)
        limit = max(HUB, (seen.n or 0) // HUBS + 1)
        if (seen.top or 0) >= limit:
            hubs = F.broadcast(least.where(F.col("n") >= limit).select("v", "m"))  # at most HUBS rows
            known = clusters.join(hubs, "v").unionByName(clusters.join(hubs, "v", "left_anti").join(least.select("v", "m"), "v"))
        else:
            known = clusters.join(least.select("v", "m"), "v")
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        clusters = cut(known.select(sent.alias("s")).select("s.*").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
