"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of `links` (columns u and v, bigint): the least node reachable.

    No neighbourhood is ever gathered: each round takes minima by aggregation and joins them back.  The join of a hub's links
    with its minimum is a sort-merge join on the hub, which adaptive execution splits where it is skewed.  Links of a node to itself and nulls are ignored.  Rounds are written out, which cuts
    lineage.  ValueError if `rounds` is reached, which a graph would need about 2**rounds nodes for.
    """
    ends = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
        discard(before)
        now = _mark(edges)
        if now == seen:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        seen = now
    raise ValueError("components did not settle")
