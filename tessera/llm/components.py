"""Connected components of a graph given as a table of links, without bringing any of it to the driver.

Alternating large-star and small-star rounds: each hangs the neighbours of a node on the smallest one
it knows, by aggregations and equi-joins alone, so a hub costs partial aggregates and not a list. Each
round's links are a table in the shared folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

_PAIR = ("u", "v")


def _hung(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Per node u with smallest neighbour m (itself included): its neighbours hang on m; larger_only leaves smaller ones alone."""
    least = pairs.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    rows = pairs.join(least, "u")
    if larger_only:
        return rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _settled(pairs: DataFrame) -> bool:
    """Whether every component is a star: no node hangs on two others, and none that hangs has others on it."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("ends")).where("up > 1 or (up = 1 and ends > 1)").isEmpty()


def components(links: DataFrame, a: str, b: str, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, root) for every node with a link to another: root is the smallest node reachable. Loops and repeats are fine.

    They are table `name` of the scratch space; the links of a round go when the next are written."""
    kind = links.schema[a].dataType
    own = f"{name}-links"
    pairs = links.select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).where("u <> v").distinct()
    pairs = scratch.save(pairs, own)
    while not _settled(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(both, larger_only=True).where("u <> v").distinct()
        pairs = scratch.save(_hung(large, larger_only=False).where("u <> v").distinct(), own)
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = scratch.save(stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct(), name)
    scratch.drop(own)
    return roots
