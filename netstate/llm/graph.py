"""Connected components of links, with DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.session import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round of large or small stars: neighbours of a node are linked to the smallest of them.

    Large: every neighbour above the node, seen from both ends. Small: the node and its neighbours below it. The minimum is
    aggregated before it is joined back, so a node with very many links sends one row per task.
    """
    up = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    sides = up.union(up.select("b", "a")) if large else up
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    near = sides.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("root").alias("b")).union(near.select("a", F.col("root").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node that can be reached.

    Alternates large and small stars until nothing changes; each round is a written table. Nodes without links, links to
    itself and null ends have no row, unless the node has another link.
    """
    now = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
        after = materialize(_star(_star(now, True), False), "links")
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
