"""Connected components of links, by alternating star contraction.

Each round replaces the links by at most as many: first every node hands its
smallest neighbour to its larger ones, then every node hands its smallest
neighbour to its smaller ones.  After a logarithmic number of rounds the links
form one star a component, with the smallest node in its middle.  All rounds are
joins and grouped minimums over tables in the shared folder; nothing is gathered
on the driver but two counts a round.  The minimums are written before the join
that uses them, so that both sides of it are plain shuffles and adaptive
execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m")), "least")
    out = links.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct()
    done = written(out, "large")
    discard(least)
    return done


def _small_star(links: DataFrame) -> DataFrame:
    least = written(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
    moved = links.join(least, F.col("a") == F.col("n")).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    done = written(moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "small")
    discard(least)
    return done


def _loose(links: DataFrame) -> int:
    """Nodes that keep the links from being stars: with two parents, or a parent and a child."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)`` that isn't the smallest of its component.

    ``a`` and ``b`` are longs; nulls and self-links are ignored.
    """
    pairs = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, "links")
    while _loose(now):
        for step in (_large_star, _small_star):
            then, now = now, step(now)
            discard(then)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._tessera_path = now._tessera_path  # for discard()
    return out
