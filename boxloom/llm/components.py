"""Connected components of a link table, by large-star and small-star rounds.

Each round replaces links by links to smaller neighbours (Kiveris et al., 2014) until only
stars are left; the number of rounds grows with the logarithm of the longest chain.  Minima are
partial aggregates, and the joins are inner equality joins whose hot keys adaptive execution
can split, so a component of any size passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # links point from the larger u to the smaller v already
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every linked node that is not its component's root (its smallest id)."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = checkpoint(e), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e, seen = checkpoint(_small_star(_large_star(e))), now
