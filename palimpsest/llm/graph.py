"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two equi-joins over edges, so a hub with a
third of all edges is pre-aggregated before the shuffle and its join can be split.
Each half round is checkpointed; nothing is collected but a checksum.

Defined results: edges with a null end, and of a node to itself, are left out; repeated
edges count once; the least node names a component, so there are no ties; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges (longs); root is the component's least node."""
    now = checkpointed(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
