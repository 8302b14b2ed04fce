"""Stored tables laid out for the reads that follow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges, graph

#: Sums of a bucket, and of a task that writes, about.
ROWS = 1_000_000


def write_edges(window_edges: DataFrame, name: str, buckets: int | None = None) -> tuple[str, str]:
    """Edge sums stored twice, dealt and sorted by caller and by callee; gives the names of both tables.

    Whatever groups or joins by one end (callers, callees, blast radius, class edges) reads the table of that end without
    a shuffle, and one class reads one bucket. The number of buckets follows the number of sums. A class with more than ``ROWS`` of
    them is dealt to several tasks, each of which sorts its own part into a file of the class's bucket.
    """
    spark = window_edges.sparkSession
    agg = graph.kept(edges.edge_agg(window_edges))
    total = agg.count()
    buckets = buckets or max(1, -(-total // ROWS))
    names = []
    for side, key in (("by_caller", "caller_cls"), ("by_callee", "callee_cls")):
        names.append(f"{name}_{side}_{uuid.uuid4().hex}")
        rest = [c for c in edges.EDGE if c != key]
        largest = agg.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        parts = max(1, -(-largest // ROWS))
        dealt = agg.repartition(max(buckets, -(-total // ROWS)), key, F.pmod(F.xxhash64(*rest), F.lit(parts)))
        dealt.write.bucketBy(buckets, key).sortBy(key, *rest).option("path", f"{graph.scratch(spark)}/{names[-1]}").saveAsTable(names[-1])
    return names[0], names[1]


def callers(table: str, spark, cls: str | None = None) -> DataFrame:
    """(build, callee_cls, callee_idx, callers, observations) from the table by callee."""
    rows = spark.table(table)
    rows = rows if cls is None else edges.callers_of(rows, cls)
    return rows.groupBy("build", *edges.CALLEE).agg(F.count("*").alias("callers"), F.sum("observations").alias("observations"))


def callees(table: str, spark, cls: str | None = None) -> DataFrame:
    """(build, caller_cls, caller_idx, callees, observations) from the table by caller."""
    rows = spark.table(table)
    rows = rows if cls is None else edges.callees_of(rows, cls)
    return rows.groupBy("build", *edges.CALLER).agg(F.count("*").alias("callees"), F.sum("observations").alias("observations"))
