"""Connected components of a table of links, by contraction.

Every node takes its smallest neighbour as parent, parents are followed to the end by
pointer doubling, and the links are rewritten between the roots that are left. A root is
smaller than all its neighbours, so at least half of the linked nodes vanish in a round.
A hub is one hot key: minima are taken before the shuffle, and relabelling is a join
against a written table with one row a node, which Spark splits when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _ends(parent: DataFrame) -> DataFrame:
    """(a, to) with every parent followed to its root."""
    while True:
        up = parent.select(F.col("a").alias("to"), F.col("to").alias("up"))
        parent = stored(parent.join(up, "to").select("a", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")), "parents")
        if parent.where("moved").isEmpty():
            return parent.select("a", "to")
        parent = parent.select("a", "to")


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of links(a, b) with the smallest node that it reaches."""
    both = links.where("a <> b").select("a", "b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while not both.isEmpty():
        parent = _ends(stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "parents"))
        at_root = parent.select(F.col("a").alias("root"), "to")
        labels = stored(labels.join(at_root, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = both.join(parent, "a").select(F.col("to").alias("c"), "b")
        right = left.join(parent.select(F.col("a").alias("b"), F.col("to").alias("d")), "b")
        both = stored(right.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "links")
    return labels
