"""Connected components over a table of links, by alternating star steps.

Every step points each node at the smallest node near it, so a link table of any shape shrinks to
stars in a few rounds. Each round is two aggregates and two joins; no neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialise


#: Doublings after which a chain of pointers must be a longer cycle, which only colliding keys can make.
DOUBLINGS = 48


def best_groups(links: DataFrame) -> DataFrame:
    """(node, component) where every node a points at one b, the best of its links by a key that both ends see alike.

    Along such pointers the key never falls, so each chain ends in two nodes that point at each other; the smaller names the group.
    Chains are halved by doubling: one join a round, and as many rounds as the logarithm of the longest chain. The groups
    are those `components` finds, under other names.
    """
    back = links.select(F.col("a").alias("b"), F.col("b").alias("_back"))
    up = materialise(
        links.join(back, "b", "left")
        .select(F.col("a").alias("node"), F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up"), F.lit(True).alias("moved"))
    )
    for _ in range(DOUBLINGS):
        further = up.select(F.col("node").alias("up"), F.col("up").alias("_further"))
        before, up = up, materialise(
            up.drop("moved").join(further, "up").select("node", F.col("_further").alias("up"), (F.col("up") != F.col("_further")).alias("moved"))
        )
        discard(before)
        if up.where("moved").isEmpty():
            return up.select("node", F.col("up").alias("component"))
    return components(links, "a", "b")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reachable.

    Links with a null end or equal ends count for nothing; repeated links count once; an empty table
    gives an empty table. Nodes must be numbers. Each round's links are written to the shared folder,
    and only their count and a checksum reach the driver.
    """
    a, b = F.col(left), F.col(right)
    edges = materialise(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v"), F.col("v")).distinct()
            )
        before = tuple(mark)
        edges = materialise(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are linked to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()
