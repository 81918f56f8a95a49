"""Connected components of a distributed list of links, by alternating large-star and small-star (Kiveris et al. 2014).

Links stay on the cluster; each round is written to the shared folder and the one before removed, so lineage and disk
stay short. The join by a star's centre reads written tables on both sides, so that Spark can split a centre that a
large part of all links share. It makes one row of each link at most, and what it makes is written, because the small
star reads it more than once. Links from a document to itself and repeated links do no harm: they go before the first
round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.scratch import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    moved = _both(links).where("b > a").join(least.select("a", "m"), "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link to another; component is the smallest node, which has a row too."""
    work = Scratch(links.sparkSession, "components")
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = work.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        least = _both(links).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.max("b").alias("x"))
        least = work.keep(least, "least")
        # Stars, and so done, when no node stands between a smaller and a larger one.
        if least.where("m < a and x > a").isEmpty():
            work.drop_others(least)
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        moved = work.keep(_large_star(links, least), "moved")
        links = work.keep(_small_star(moved), "links")
        work.drop_others(links)
