"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .frames import join_uneven


def _with_min(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs`` (u, v) with m, the smallest of u and its partners. Partners are reduced before any shuffle."""
    pairs = scratch.table(pairs)
    lows = scratch.table(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
    return join_uneven(pairs, lows, "u", "n", pairs.count())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u and v, both long) but the roots themselves.

    The root is the smallest node that can be reached. Every step leaves the components as they are, so a lost task
    is simply run again; each round's table is written to the shared folder. Empty links give an empty table. The
    number of rounds is logarithmic in the longest path.
    """
    edges = scratch.table(
        links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (row["n"], row["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, scratch).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = _with_min(large, scratch)
        small = low.select(F.col("u"), F.col("m").alias("v")).unionByName(
            low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        after = scratch.table(small.distinct())
        scratch.drop(edges)
        edges = after
