"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins whose large side has no key
that must stay in one task, so a hub with very many neighbours can be split by
the adaptive skew join.  The edge list is written to the shared folder after
every round, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import discard, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(lowest, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges to ``(node, root)``; root is the smallest node of the component.

    Self loops are ignored.  A node without an edge to another node is not listed.
    """
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        stars = durable(_star(_star(edges, large=True), large=False))
        discard(edges)
        edges = stars
        new = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (new.n, new.s) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (new.n, new.s)
