"""Timing profiles: exact counts, histograms of the timed calls, and error classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.buckets import bucket_high, bucket_index

METHOD = ("build", "cls", "idx")
PERCENTILES = (50.0, 90.0, 99.0)
#: Error classes with an id of their own in a window; the rest share the next id.
ERROR_IDS = 254


def roll_up(events: DataFrame, *keys: str) -> DataFrame:
    """Calls, errors and timed calls of each key. Counts are exact however few calls are timed."""
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if("err").alias("errors"), F.count_if("timed").alias("timed_calls"))


def histograms(events: DataFrame, *keys: str) -> DataFrame:
    """One row for each bucket with timed calls."""
    return events.where("timed").groupBy(*keys, bucket_index(F.col("nanos")).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(histogram: DataFrame, *keys: str) -> DataFrame:
    """Upper bounds of the buckets where the running count reaches each percentile's share, at least one call."""
    running = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy(*keys)
    h = histogram.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(total)})
    target = {p: F.greatest(F.ceil(F.lit(p) / 100 * F.col("total")), F.lit(1)) for p in PERCENTILES}
    high = bucket_high(F.col("bucket")) - 1
    return h.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= target[p], high)).alias(f"p{p:g}") for p in PERCENTILES])


def error_classes(events: DataFrame, *keys: str) -> DataFrame:
    return events.where("err").groupBy(*keys, "err_name").agg(F.count("*").alias("n"))


def error_report(events: DataFrame, *keys: str) -> DataFrame:
    """Errors, those attributed to a named class, the rest, and the names in order."""
    return events.where("err").groupBy(*keys).agg(
        F.count("*").alias("errors"), F.count("err_name").alias("attributed"), (F.count("*") - F.count("err_name")).alias("unattributed"),
        F.array_join(F.array_sort(F.collect_set("err_name")), "+").alias("names"),
    )


def top_error_classes(events: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("build").orderBy(F.desc("n"), "err_name")
    return error_classes(events, "build").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def assign_error_ids(events: DataFrame, *window: str) -> DataFrame:
    """Ids in the order of first sight in each window; classes beyond the last id share one."""
    first = events.where("err").groupBy(*window, "err_name").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*window).orderBy("first_id"))
    over = F.col("place") > ERROR_IDS
    named = first.withColumn("place", place).select(*window, F.when(over, ERROR_IDS + 1).otherwise(F.col("place")).alias("error_id"), F.when(over, "<overflow>").otherwise(F.col("err_name")).alias("err_name"), "n")
    return named.groupBy(*window, "error_id", "err_name").agg(F.sum("n").alias("n"))


def timed_fraction(events: DataFrame, *keys: str) -> DataFrame:
    return roll_up(events, *keys).withColumn("fraction", F.round(F.col("timed_calls") / F.col("calls"), 4))


def method_rates(events: DataFrame, *keys: str, seconds: int = 86_400) -> DataFrame:
    r = roll_up(events, *keys)
    return r.withColumns({"per_second": F.round(F.col("calls") / seconds, 4), "error_rate": F.round(F.col("errors") / F.col("calls"), 4)})


def hot_methods(events: DataFrame, limit: int) -> DataFrame:
    """The most called methods with percentiles and error classes; ties by build, class and index."""
    totals = roll_up(events, *METHOD).orderBy(F.desc("calls"), *METHOD).limit(limit)
    found = totals.join(percentiles(histograms(events, *METHOD), *METHOD), list(METHOD), "left")
    return found.join(error_report(events, *METHOD).select(*METHOD, "names"), list(METHOD), "left")
