"""Connected components of a table of links by alternating large-star and small-star rounds.

Each round replaces links by links to smaller nodes and keeps the components (Kiveris et al., 2014); the fixed
point is one star for each component, centred at its smallest node. Rounds run until nothing changes; each is
written to the shared scratch folder, in files of up to ``PART`` links: late rounds hold few, which as many files as there are
shuffle partitions would only make slow. Links stay distributed; only two sums a round reach the driver.
The centre of a large group is a hot key: its minimum is broadcast to its links, which stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lookup, stored

PART = 20_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return lookup(both, least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = lookup(down, least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b, any ordered type): component is the
    smallest node that links reach. Links of a node with itself and links with null are none; an empty table
    gives an empty one."""
    stars = stored(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = None
    while (now := _sum(stars)) != before and now[0]:
        before = now
        stars = stored(_small_star(_large_star(stars)).coalesce(-(-now[0] // PART)), "stars")  # neither step makes more links than it is given
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
