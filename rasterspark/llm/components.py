"""Connected components of an edge table by alternating small-star and large-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, broadcast_if_small


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """u, v (n rows) -> each node's neighbours are tied to the least of them (and of itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(broadcast_if_small(least, 2 * n if large else n), "u")
    if large:
        return tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: u, v (long) -> node, root: the least node that a node is tied to; nodes without a link are left out.

    Each round is written to the shared folder, so lost executors cost one round at most. Self links and repeated links
    do no harm.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    table = Table(edges, "edges")
    for _ in range(rounds):
        here = table.read()
        n, nodes = here.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        # done once each node has one link, to a node that has none of its own
        if n == nodes and here.join(broadcast_if_small(here.select(F.col("v").alias("u")).distinct(), n), "u", "left_semi").isEmpty():
            break
        # the small star goes first: it reads each link once and leaves about one for each node to the large star
        small = _star(here, False, n).where("u <> v").distinct()
        new = Table(_star(small, True, n).distinct(), "edges")
        table.drop()
        table = new
    else:
        raise RuntimeError(f"not done after {rounds} rounds")
    return here.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(here.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
