"""Sampled call edges: sums that say nothing about what they do not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import kept as kept_rows

CALLER, CALLEE = ("caller_cls", "caller_idx"), ("callee_cls", "callee_idx")
EDGE = ("build", *CALLER, *CALLEE)


def edge_agg(window_edges: DataFrame) -> DataFrame:
    return window_edges.groupBy(*EDGE).agg(
        F.sum("observations").alias("observations"), F.count("*").alias("windows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
    )


def sample_rates(window_edges: DataFrame) -> DataFrame:
    """Windows that reported at each rate."""
    return window_edges.select("build", "day", "rate").distinct().groupBy("build", "rate").agg(F.count("*").alias("windows"))


def estimate(agg: DataFrame) -> DataFrame:
    """With the uniform rate, or null; calls are only estimated where the rate never changed."""
    rate = F.when((F.col("min_rate") > 0) & (F.col("min_rate") == F.col("max_rate")), F.col("min_rate"))
    return agg.withColumns({"uniform_rate": rate, "estimated_calls": F.col("observations") * rate})


def hot_edges(agg: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("build").orderBy(F.desc("observations"), *CALLER, *CALLEE)
    return agg.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def callers_of(agg: DataFrame, cls: str) -> DataFrame:
    return agg.where(F.col("callee_cls") == cls)


def callees_of(agg: DataFrame, cls: str) -> DataFrame:
    return agg.where(F.col("caller_cls") == cls)


def endpoints(agg: DataFrame) -> DataFrame:
    """Methods with observed edges, and on which side."""
    sides = [agg.select("build", F.col(c).alias("cls"), F.col(i).alias("idx"), F.lit(s).alias("side")) for s, (c, i) in (("outbound", CALLER), ("inbound", CALLEE))]
    return sides[0].union(sides[1]).distinct()


def evidence(agg: DataFrame, side: tuple[str, str] = CALLEE) -> DataFrame:
    return agg.groupBy("build", *side).agg(
        F.count("*").alias("edges"), F.sum("observations").alias("observations"), F.min(F.nullif("min_rate", F.lit(0))).alias("min_rate"),
        F.max("max_rate").alias("max_rate"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
    )


def cap_distinct(window_edges: DataFrame, cap: int, window: tuple[str, ...] = ("build", "instance", "day")) -> DataFrame:
    """For each window, how many distinct edges came in time for the cap, and what was refused.

    Only the first edges of a window are ranked; what was refused is the window's total less what was kept. Callers' classes come first
    in the order, so one pass over all edges finds the classes that may hold any of the first ``cap``: those that come after classes
    with that many are left out. A class has at least as many edges as bits that their hashes set, and all of its rows go by.
    """
    by_class = window_edges.groupBy(*window, CALLER[0]).agg(
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*CALLER, *CALLEE), F.lit(64)).cast("int")))).alias("at_least"), F.sum("observations").alias("observations")
    )
    by_class = kept_rows(by_class)
    before = F.sum("at_least").over(W.partitionBy(*window).orderBy(CALLER[0]).rowsBetween(W.unboundedPreceding, -1))
    first = by_class.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap).select(*window, CALLER[0])
    place = F.dense_rank().over(W.partitionBy(*window).orderBy(*CALLER, *CALLEE))
    ranked = window_edges.join(first, [*window, CALLER[0]], "left_semi").withColumn("place", place).where(F.col("place") <= cap)
    kept = ranked.groupBy(*window).agg(F.count_distinct("place").alias("kept_edges"), F.sum("observations").alias("kept"))
    total = by_class.groupBy(*window).agg(F.sum("observations").alias("total"))
    return total.join(kept, list(window)).select(*window, "kept_edges", (F.col("total") - F.col("kept")).alias("refused"))


def class_edges(agg: DataFrame) -> DataFrame:
    """Rolled up to classes; edges inside a class are counted apart and mixed rates are flagged."""
    return agg.groupBy("build", "caller_cls", "callee_cls").agg(
        F.sum("observations").alias("observations"), F.count("*").alias("edges"), (F.min("min_rate") != F.max("max_rate")).alias("mixed"),
        F.count_if(F.col("caller_cls") == F.col("callee_cls")).alias("inside"),
    )


def recommended_rate(entries: Column, target: int = 20, most: int = 65_536) -> Column:
    """The power of two that would have sampled about ``target`` of the root entries."""
    want = F.floor(entries / target)
    highest = F.when(want < 1, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(want)) - 1))
    return F.least(F.greatest(highest, F.lit(1)), F.lit(most))


def loss(window_edges: DataFrame) -> DataFrame:
    """window_edges with a dropped flag: what each window observed, what it dropped, and whether it is lossy."""
    lost = window_edges.groupBy("build", "day").agg(F.sum("observations").alias("observed"), F.count_if("dropped").alias("dropped"))
    return lost.withColumn("lossy", F.col("dropped") > 0)


def starved(armed: Column, sampled_roots: Column, boundary_calls: Column) -> Column:
    """Sampling is on and calls came in, but none was ever sampled."""
    return armed & (F.coalesce(sampled_roots, F.lit(0)) == 0) & (F.coalesce(boundary_calls, F.lit(0)) > 0)
