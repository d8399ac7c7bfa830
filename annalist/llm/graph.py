"""Connected components of a table of links, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import discard, store


def _is_stars(edges: DataFrame) -> bool:
    """Does every node have one smaller neighbour at most, and is that one a root?"""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b. Returns (node, root) for every node that has a link, root being the smallest
    node of its component; roots themselves are included.

    Large-star and small-star steps by turns: each links nodes to the least neighbour, by one minimum per node (summed
    before the shuffle) and one join. Links never grow in number, and every round is stored, so lost executors cost
    one round at most. A null end makes no link. All joins are by a shuffle: stored links are packed so well that Spark would
    send tables of many millions of them through the driver.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = store(links, "links")
    while not _is_stars(held):
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        tops = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(tops.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = store(small.unionByName(tops.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(held)
        held = new
    roots = held.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
