"""Connected components of a table of links, by alternating stars.

A round joins every node's larger neighbours to the smallest node of its
neighbourhood, then every node's smaller neighbours likewise, until every node is
linked to the smallest of its component and nothing else. Links are a written
table after each half, so a lost executor costs one step; smallest neighbours are
aggregates, which Spark combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    around = _both_ways(links)
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return (around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of longs to (node, root), a row for every node that is not
    its component's smallest; the root is the smallest."""
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "links")
    state = _state(links)
    while state[0]:
        links = written(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
