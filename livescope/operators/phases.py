"""Intervals and business phases, to the second.

Ends may be dates or timestamps without zone; intervals are half-open.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Calendar(NamedTuple):
    """Required phases, the recurring ones as (phase, rule, days) and the declared ones as (phase, start, stop, label)."""

    required: tuple[str, ...]
    recurring: tuple[tuple[str, str, int], ...] = ()
    occurrences: tuple[tuple[str, str, str, str], ...] = ()
    least: float = 0.9


# The rules of a calendar and the months that each takes; what a missing calendar file stands for.
RULES = {"last-days-of-month": tuple(range(1, 13)), "last-days-of-quarter": (3, 6, 9, 12), "last-days-of-year": (12,)}
REQUIRED = ("month-end", "quarter-end", "year-end-close", "peak-season", "dr-drill")
DEFAULT = Calendar(REQUIRED, (("month-end", "last-days-of-month", 2), ("quarter-end", "last-days-of-quarter", 3), ("year-end-close", "last-days-of-year", 5)))


def _time(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def seconds(start: str | Column, stop: str | Column) -> Column:
    return F.timestamp_diff("SECOND", _time(start), _time(stop))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """(build, start, stop): union of half-open intervals, empty ones dropped, touching ones joined.

    Equal intervals fold first, so that a build with most windows brings its distinct ones only.
    """
    distinct = intervals.where("start < stop").groupBy("build", "start").agg(F.max("stop").alias("stop"))
    order = W.partitionBy("build").orderBy("start")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = distinct.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", island)
    return marked.groupBy("build", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def _by_month(rows: DataFrame, start: str, stop: str) -> DataFrame:
    """Each interval once for every month that it touches, as month, from_ and to_."""
    last = F.expr(f"CAST(`{stop}` AS timestamp_ntz) - INTERVAL 1 MICROSECOND")
    months = F.sequence(F.trunc(F.to_date(_time(start)), "month"), F.trunc(F.to_date(last), "month"), F.expr("interval 1 month"))
    spread = rows.where(_time(start) < _time(stop)).withColumn("month", F.explode(months))
    return spread.withColumns({"from_": F.greatest(_time(start), _time("month")), "to_": F.least(_time(stop), _time(F.add_months("month", 1)))})


def overlap_seconds(merged: DataFrame, occurrences: DataFrame) -> DataFrame:
    """occurrences(build, phase, p_start, p_stop, ...) with the seconds of each that the build's intervals cover, if any.

    Both sides are cut at months and meet by build and month, so the join is an equality and no build meets all its occurrences with all its intervals.
    """
    own = _by_month(merged, "start", "stop").select("build", "month", F.col("from_").alias("i_from"), F.col("to_").alias("i_to"))
    asked = _by_month(occurrences, "p_start", "p_stop")
    hit = asked.join(own, ["build", "month"]).where("i_from < to_ AND i_to > from_")
    keys = [c for c in occurrences.columns]
    return hit.groupBy(*keys).agg(F.sum(seconds(F.greatest("from_", "i_from"), F.least("to_", "i_to"))).alias("covered"))


def span(intervals: DataFrame) -> DataFrame:
    """Of each build's intervals from the first start to the last stop, with whole days."""
    ends = intervals.where("start < stop").groupBy("build").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return ends.withColumn("window_days", F.floor(seconds("start", "stop") / 86400).cast("int"))


def expand(spans: DataFrame, calendar: Calendar) -> DataFrame:
    """spans(start, stop, ...) with every occurrence that a span overlaps: phase, p_start, p_stop, label.

    A recurring rule takes the last days of months, quarters or years, one day at least. An unknown rule is an error.
    """
    unknown = [r for _, r, _ in calendar.recurring if r not in RULES]
    if unknown:
        raise ValueError(f"unknown calendar rules: {unknown}")
    others = [c for c in spans.columns if c not in ("start", "stop")]
    columns = [*others, "start", "stop", "phase", "p_start", "p_stop", "label"]
    found = None
    if calendar.recurring:
        known = F.array(*[F.struct(F.lit(p).alias("phase"), F.array(*map(F.lit, RULES[r])).alias("months"), F.lit(max(1, n)).alias("days")) for p, r, n in calendar.recurring])
        months = F.sequence(F.trunc(F.add_months(F.to_date("start"), -1), "month"), F.trunc(F.date_add(F.to_date("stop"), 40), "month"), F.expr("interval 1 month"))
        each = spans.withColumn("m", F.explode(months)).withColumn("rule", F.explode(known)).where(F.array_contains("rule.months", F.month("m")))
        found = each.withColumns({
            "phase": F.col("rule.phase"), "p_start": _time(F.expr("date_add(last_day(m), 1 - rule.days)")), "p_stop": _time(F.date_add(F.last_day("m"), 1)),
            "label": F.date_format("m", "yyyy-MM"),
        }).select(columns)
    if calendar.occurrences:
        declared = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("label")) for p, a, b, n in calendar.occurrences])
        own = spans.withColumn("x", F.explode(declared)).withColumns({"phase": F.col("x.phase"), "p_start": _time("x.a"), "p_stop": _time("x.b"), "label": F.col("x.label")}).select(columns)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spans.where("false").selectExpr(*others, "'' AS phase", "CAST(NULL AS timestamp_ntz) AS p_start", "CAST(NULL AS timestamp_ntz) AS p_stop", "'' AS label")
    return found.where((F.col("p_start") < _time("stop")) & (F.col("p_stop") > _time("start"))).drop("start", "stop")


def phase_coverage(builds: DataFrame, merged: DataFrame, calendar: Calendar) -> DataFrame:
    """For each build(build, ...) and required phase its best covered occurrence within the build's span, whether it is enough, and why not.

    A phase that doesn't occur within the span is missing, and so is every phase of a build without windows.
    """
    happens = expand(span(merged).drop("window_days"), calendar)
    covered = overlap_seconds(merged, happens)
    fraction = F.when(F.col("covered").isNotNull(), F.col("covered") / seconds("p_start", "p_stop")).otherwise(0.0)
    # One row an occurrence and a build: the occurrences themselves with what was covered of them.
    both = happens.withColumn("covered", F.lit(None).cast("long")).unionByName(covered).where("p_start < p_stop").withColumn("fraction", fraction)
    best = both.groupBy("build", "phase").agg(
        F.count_if(F.col("covered").isNull()).alias("occurrences"), F.max("fraction").alias("best"), F.max_by(F.col("label"), F.struct("fraction", "label")).alias("label")
    )
    wanted = builds.select("build").distinct().select("build", F.posexplode(F.array(*map(F.lit, calendar.required))).alias("place", "phase"))
    joined = wanted.join(best, ["build", "phase"], "left")
    fraction = F.coalesce("best", F.lit(0.0))
    enough = (fraction >= calendar.least) & F.col("occurrences").isNotNull()
    state = F.when(F.col("occurrences").isNull(), "no occurrence").when(enough, "covered").otherwise("too little observed")
    return joined.select(
        "build", "phase", "place", F.round(fraction, 4).alias("fraction"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), enough.alias("is_covered"), state.alias("state"),
        F.when(fraction > 0, F.col("label")).alias("label"),
    )


def phase_lists(coverage: DataFrame) -> DataFrame:
    """(build, phases_covered, phases_missing), both in the calendar's order."""
    names = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("place", "phase")))), lambda x: x.phase)
    return coverage.groupBy("build").agg(names(F.col("is_covered")).alias("phases_covered"), names(~F.col("is_covered")).alias("phases_missing"))


def read_calendar(spark: SparkSession, path: str) -> Calendar:
    """A calendar document (JSON of requiredPhases, minCoverageFraction, recurring, occurrences); the default one where there is no file."""
    schema = (
        "requiredPhases array<string>, minCoverageFraction double, recurring array<struct<phase string, rule string, days int>>,"
        " occurrences array<struct<phase string, start string, end string, label string>>"
    )
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path).collect()  # a calendar is one document
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return DEFAULT
    if len(rows) != 1:
        raise ValueError(f"a calendar is one document, not {len(rows)}")
    doc = rows[0]
    unknown = [r.rule for r in doc.recurring or () if r.rule not in RULES]
    if unknown:
        raise ValueError(f"unknown calendar rules: {unknown}")
    return Calendar(
        tuple(doc.requiredPhases) if doc.requiredPhases is not None else REQUIRED,
        tuple((r.phase, r.rule, 1 if r.days is None else r.days) for r in doc.recurring or ()),
        tuple((o.phase, o.start, o.end, o.label or "") for o in doc.occurrences or ()),
        0.9 if doc.minCoverageFraction is None else doc.minCoverageFraction,
    )
