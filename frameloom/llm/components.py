"""Connected components of a table of links, without collecting it anywhere.

Alternating large-star and small-star rounds: each node links its neighbours to
the least of them, until every node points at its component's least node.
Every round is two groupings with map-side minima and two joins in which the
neighbours of nodes with a large share of all links stay where they are (see
heavy_join), and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.shared import heavy_join, removed, written


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """(v, m): each neighbour v of a node u, and the least m of u and its neighbours."""
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    return heavy_join(edges, least, "u", "n").drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); a component is named by its least node.

    Rounds go on until one changes nothing. Every round that changes something
    lowers some node's parent, so they end; their number grows with the
    logarithm of the longest path.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    changed = 1
    while changed:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "links")
        near = _linked_to_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small, "links")
        # done when no node has two parents and no parent has one itself
        changed = small.exceptAll(links).limit(1).count() + links.exceptAll(small).limit(1).count()
        removed(links)
        removed(large)
        links = small
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
