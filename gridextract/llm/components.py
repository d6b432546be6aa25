"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settled, written


def _star(sym: DataFrame) -> DataFrame:
    """u, v, and the smallest of u and all its neighbours v. The minima are a table of their own, so that the join deals
    out both sides anew and Spark splits the rows of a node with very many neighbours."""
    least = written(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return sym.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node that can be reached) for each node of an edge; a table without edges gives no
    rows. Rows with a null end and loops are left out. Each round is a written table, of which the last one stays; the
    number of rounds grows with the logarithm of the number of nodes."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    seen = None

    def round_(now: DataFrame) -> DataFrame:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(written(large)).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        return small.select("e.u", "e.v").where("u <> v").distinct()

    while True:
        before, now = now, settled(lambda now=now: round_(now))
        discard(before)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
