"""Connected components of a large sparse graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step on edges (u, v) with u > v.

    Large step: every node links its larger neighbours to its smallest one.  Small step: every node
    links its smaller neighbours, and itself, to the smallest of them.  The smallest neighbour is a
    minimum with map-side combine; the join back to the edges of a hub is left to the skew join.
    """
    pairs = edges
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (u, v): root is the smallest id reachable.

    Ids are non-null longs; direction, self loops and repeated edges do not matter.  Each round is
    written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    now = settle(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u > v").distinct()
    )
    before = None
    while True:
        print_of = now.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        ).first()
        if print_of[0] == 0 or print_of == before:
            break
        before = print_of
        now = settle(_stars(_stars(now, True), False))
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
