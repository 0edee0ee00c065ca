"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregate and a join over the links, written to the shared folder; links
and labels never reach the driver. Each node's smallest neighbour is found by an aggregate
with map-side combine, and a hub's links are split over tasks by the join, so a component
of any size is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.blocks import discard, written


def components(links: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is its smallest node.
    The path of the written result is added to ``keep``."""
    spark = links.sparkSession
    # kept as (u, v) with v < u: a forest of depth 1 once nothing changes
    scratch: list[str] = []
    e = written(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links", scratch)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_down(both.where("v > u").join(_lowest(both, scratch), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))),
                        "large-star", scratch)
        low = _lowest(large, scratch)
        out = written(_down(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionByName(low.select("u", F.col("m").alias("v")))), "small-star", scratch)
        # settled when every node has one smaller neighbour, which itself has none
        roles = out.select(F.col("u").alias("n"), F.lit(1).alias("below")).unionByName(
            out.select(F.col("v").alias("n"), F.lit(0).alias("below")).distinct())
        open_ = roles.groupBy("n").agg(F.sum("below").alias("up"), F.count(F.lit(1)).alias("all")).where("up > 1 OR up < all AND up > 0")
        if open_.isEmpty():
            break
        e = out
    named = written(out.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        out.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "named", keep)
    discard(spark, scratch)
    return named


def _down(e: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return (e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _lowest(e: DataFrame, scratch: list[str]) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return written(low.select("u", F.least("u", "m").alias("m")), "lowest", scratch)
