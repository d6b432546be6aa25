"""Connected components of a table of links, for merges that must not fold a whole file in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridextract.sources.shared import once, working_tables


def _nearer(links: DataFrame) -> DataFrame:
    """node, far, least: each link seen from a node, with the smallest id among the node and all it is linked to. The least
    ids are summed up before the join, so a node with very many links is one row there."""
    least = once(links.groupBy("node").agg(F.least(F.min("far"), F.first("node")).alias("least")))
    return links.join(least, "node")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest id that can be reached) for every node with a link to another. links: a, b (long).

    Runs when it is called. Each round first hangs the larger neighbours of a node on its least one, then its smaller
    ones, until nothing changes; rounds grow with the logarithm of the nodes, and each is a written table."""
    turned = lambda d: d.union(d.select(F.col("far").alias("node"), F.col("node").alias("far")))
    with working_tables():
        now = once(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("far")).distinct())
        seen = None
        while True:
            larger = once(_nearer(turned(now)).where("far > node").select(F.col("far").alias("node"), F.col("least").alias("far")).distinct())
            down = _nearer(larger)
            ends = F.explode(F.array(F.struct(F.col("far").alias("node"), F.col("least").alias("far")), F.struct(F.col("node").alias("node"), F.col("least").alias("far"))))
            now = once(down.select(ends.alias("e")).select("e.node", "e.far").where("node <> far").distinct())
            state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "far"))).first()
            if state == seen or not state[0]:
                break
            seen = state
        roots = now.select(F.col("far").alias("node"), F.col("far").alias("component")).distinct()
        return once(now.select("node", F.col("far").alias("component")).union(roots), outer=True)
