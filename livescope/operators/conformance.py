"""Checks of a run against what is known of it: ground truth, skip reasons, spans, event order, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_truth(truth: DataFrame, bits: DataFrame, loaded: DataFrame, inventory: DataFrame) -> DataFrame:
    """truth(cls, idx, expect) with ok: dead unset, rare set, never loaded, loaded but unset, not in the inventory. A row an assertion."""
    has = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    t = truth.join(has(bits, ["cls", "idx"], "hit"), ["cls", "idx"], "left").join(has(loaded, ["cls"], "seen"), "cls", "left").join(has(inventory, ["cls", "idx"], "known"), ["cls", "idx"], "left")
    hit, seen, known = (F.coalesce(c, F.lit(False)) for c in ("hit", "seen", "known"))
    ok = (
        F.when(F.col("expect") == "dead", known & ~hit).when(F.col("expect") == "rare", hit).when(F.col("expect") == "never_loaded", ~seen)
        .when(F.col("expect") == "loaded_not_invoked", seen & ~hit).when(F.col("expect") == "not_indexed", ~known)
    )
    return t.select("cls", "idx", "expect", ok.alias("ok"))


def unexpected_skips(skipped: DataFrame, allowed: DataFrame, without_probes: DataFrame) -> DataFrame:
    """skipped(build, reason, n): reasons not allowed, and allowed ones beyond the number of classes without a probe (build, n_empty)."""
    sums = skipped.groupBy("build", "reason").agg(F.sum("n").alias("n"))
    known = sums.join(F.broadcast(allowed.select("reason", F.lit(True).alias("allowed"))), "reason", "left").join(without_probes, "build", "left")  # a short allow list
    fault = F.when(F.col("allowed").isNull(), "unexpected reason").when(F.col("n") > F.coalesce("n_empty", F.lit(0)), "more than classes without probes")
    return known.withColumn("fault", fault).where("fault is not null").select("build", "reason", "n", "fault")


def span_counts(lines: DataFrame, pattern: str = r"tracer: ([^ ]+)", error: str = "ERROR") -> DataFrame:
    """lines(line): spans of each tracer, and how many lines are errors, in a row of its own."""
    tracer = F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    kind = F.when(F.contains("line", F.lit(error)), F.lit("#errors")).otherwise(tracer)
    return lines.select(kind.alias("tracer")).where("tracer is not null").groupBy("tracer").agg(F.count("*").alias("spans"))


def marker_counts(events: DataFrame, markers: list[str]) -> DataFrame:
    """events(who, at, kind, marks): load events of each observer, and how many of them already carry each marker."""
    return events.where("kind = 'load'").groupBy("who").agg(F.count("*").alias("loads"), *[F.count_if(F.array_contains("marks", m)).alias(m) for m in markers])


def source_refs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """How often each of names(name) stands as a word in texts(text), lines that are comments left out. Names may be many: a join."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where(~F.ltrim("line").startswith("//"))
    words = lines.select(F.explode(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("refs"))
    return names.select("name").distinct().join(words, "name", "left").select("name", F.coalesce("refs", F.lit(0)).alias("refs"))


def counter_faults(counters: DataFrame, name: Column, value: Column, least: int) -> DataFrame:
    """dead.* must be absent, rare.* at least ``least``."""
    fault = F.when(name.startswith("dead."), "must be absent").when(name.startswith("rare.") & (value < least), "too small")
    return counters.withColumn("fault", fault).where("fault is not null")
