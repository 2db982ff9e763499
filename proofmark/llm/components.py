"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node it is linked to) for every node of ``links`` (a, b: comparable, not null).

    Each round replaces links by links to the least neighbour: first those of the
    larger neighbours, then those of the smaller ones.  The links become stars
    in a number of rounds that grows with the logarithm of the longest path.
    Links stay in tables; the driver sees one sum per round.  A node's least
    neighbour is found by an aggregate that is combined within tasks, so a node
    with very many links is not gathered anywhere.
    """
    now = common.store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if told == before:
            break
        before = told
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that the join below can split the rows of a node with very many links.
        centre = common.store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links-least")
        large = both.join(centre, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.store(large, "links-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = common.store(small, "links")
        common.forget(now)
        common.forget(large)
        common.forget(centre)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
