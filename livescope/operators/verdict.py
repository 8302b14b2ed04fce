"""One verdict a method: status, every reason that fired in order, and what blocked a nomination.

Unknown is the default. A candidate needs every clause; tri-state inputs stay tri-state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edges import estimate, hot_edges
from .graph import kept

OBSERVABLE, NOT_OBSERVABLE, DE_INSTRUMENTED, NO_PROBE = "OBSERVABLE", "NOT_DYNAMICALLY_OBSERVABLE", "DE_INSTRUMENTED", "NO_PROBE_INSTALLED"
LIVE, UNKNOWN, CANDIDATE = "LIVE", "UNKNOWN", "DEAD_CANDIDATE"

# The reason heads that mean a clause stopped a nomination.
BLOCKING_HEADS = (
    "suppressed", "clinit", "public-api-surface", "not-dynamically-observable", "de-instrumented", "no-probe-installed", "short-circuitable",
    "class-never-loaded", "static-reachable", "static-unresolved", "no-usable-window", "phases-missing", "window-too-short", "rule-class-disabled",
    "rate-limited", "runtime-observed", "runtime-edge-observed",
)


def effective_eligibility(declared: Column, installed: Column) -> Column:
    """Observable by declaration but with no probe anywhere is a class of its own; a missing mask changes nothing."""
    return F.when((declared == OBSERVABLE) & installed.eqNullSafe(F.lit(False)), NO_PROBE).otherwise(declared)


def _clauses() -> list[tuple[Column, str, Column | None, str | None]]:
    """(condition, reason, what it saw, blocker or None), in the order in which reasons are told."""
    c = F.col
    eligible = c("eligibility")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    scale = F.when(c("sample_rate").isNotNull(), said("1 in ", c("sample_rate"))).otherwise("no declared rate")
    return [
        (c("suppressed"), "suppressed", c("suppression"), "suppressed"),
        (~c("suppressed"), "not-suppressed", None, None),
        (c("name") == "<clinit>", "clinit", None, "clinit"),
        (c("is_public_api"), "public-api-surface", None, "public-api"),
        (~c("is_public_api"), "not-public-api", None, None),
        (eligible == NOT_OBSERVABLE, "not-dynamically-observable", None, "not-dynamically-observable"),
        (eligible == DE_INSTRUMENTED, "de-instrumented", None, "de-instrumented"),
        (eligible == OBSERVABLE, "dynamically-observable", None, None),
        ((eligible == OBSERVABLE) & c("installed").eqNullSafe(F.lit(False)), "no-probe-installed", said("index ", c("idx")), "no-probe-installed"),
        ((eligible == OBSERVABLE) & c("installed").eqNullSafe(F.lit(True)), "probe-installed", None, None),
        (c("short_circuitable"), "short-circuitable", None, "short-circuitable"),
        (~c("short_circuitable"), "not-short-circuitable", None, None),
        (c("observed"), "runtime-observed", said("last seen ", c("last_seen")), None),
        (~c("observed"), "runtime-unobserved", None, None),
        (c("class_loaded"), "class-loaded", None, None),
        (~c("class_loaded"), "class-never-loaded", None, "class-never-loaded"),
        (c("static_reachable").eqNullSafe(F.lit(True)), "static-reachable", None, "static-reachable"),
        (c("static_reachable").eqNullSafe(F.lit(False)), "static-unreachable", None, None),
        (c("static_reachable").isNull(), "static-unresolved", None, "static-unresolved"),
        (c("inbound_edges") > 0, "runtime-edge-observed", said(c("inbound_edges"), " edges, ", c("inbound_observations"), " observations at ", scale), "runtime-edge-observed"),
        ((c("inbound_edges") == 0) & c("edges_reported"), "runtime-edge-absent", None, None),
        (c("usable_windows") == 0, "no-usable-window", None, "no-usable-window"),
        (c("usable_windows") > 0, "usable-windows", said(c("usable_windows")), None),
        (c("excluded_windows") > 0, "windows-excluded", said(c("excluded_windows")), None),
        (F.size("phases_missing") > 0, "phases-missing", F.array_join("phases_missing", ", "), "phases-missing"),
        (F.size("phases_missing") == 0, "phases-complete", F.array_join("phases_covered", ", "), None),
        (c("window_days") < c("min_window_days"), "window-too-short", said(c("window_days"), " of ", c("min_window_days"), " days"), "window-too-short"),
        (c("disabled_key").isNotNull(), "rule-class-disabled", c("disabled_key"), "rule-class-disabled"),
        (c("rate_limit").isNotNull(), "rate-limited", c("rate_limit"), "rate-limited"),
    ]


#: What each reason that stops a nomination means to a reader.
EXPLANATIONS = {
    "suppressed": "a suppression rule matches",
    "clinit": "class initialisers run whenever a class does",
    "public-api-surface": "callers outside of this deployment can't be seen",
    "not-dynamically-observable": "its body leaves nothing to observe",
    "de-instrumented": "its probe was taken out again",
    "no-probe-installed": "no instance installed a probe that could be set",
    "short-circuitable": "a proxy, cache or retry can answer without it",
    "class-never-loaded": "no window saw its class",
    "static-reachable": "the call graph reaches it",
    "static-unresolved": "the call graph can't tell",
    "no-usable-window": "no window is evidence of death",
    "phases-missing": "business phases were not observed",
    "window-too-short": "too few days were observed",
    "rule-class-disabled": "reviewers rejected too many verdicts of its kind",
    "rate-limited": "enough was proposed for today",
    "runtime-observed": "it ran",
    "runtime-edge-observed": "it was called",
}


def evaluate(facts: DataFrame) -> DataFrame:
    """facts with reasons (``head`` or ``head: what was seen``), blockers and status.

    Without a column rate_limit no cap is applied.
    """
    if "rate_limit" not in facts.columns:
        facts = facts.withColumn("rate_limit", F.lit(None).cast("string"))

    def fired(values: list[tuple[Column, Column]]) -> Column:
        return F.filter(F.array(*[F.when(when, what) for when, what in values]), lambda x: x.isNotNull())

    clauses = _clauses()
    text = [(when, F.lit(head) if seen is None else F.concat_ws(": ", F.lit(head), seen)) for when, head, seen, _ in clauses]
    told = facts.withColumns({"reasons": fired(text), "blockers": fired([(when, F.lit(block)) for when, _, _, block in clauses if block])})
    status = (
        F.when(F.col("observed") | (F.col("inbound_edges") > 0), LIVE)
        .when(F.col("suppressed"), UNKNOWN)
        .when(F.col("eligibility") == NOT_OBSERVABLE, NOT_OBSERVABLE)
        .when(F.size("blockers") > 0, UNKNOWN)
        .otherwise(CANDIDATE)
    )
    found = told.withColumn("status", status)
    return found.withColumn("reasons", F.when(F.col("status") == CANDIDATE, F.array_append("reasons", F.lit(CANDIDATE))).otherwise(F.col("reasons")))


def evaluate_capped(facts: DataFrame, opened: DataFrame, cap: int) -> DataFrame:
    """evaluate, and candidates without a standing proposal beyond the cap are rate-limited.

    ``cap`` less opened(artifact, opened) of an artifact's new candidates pass, by class, name and descriptor. Only these are
    ranked, so an artifact with most candidates is not one task's work.
    """
    order = W.partitionBy("artifact").orderBy("cls", "name", "desc")
    first = evaluate(kept(facts))  # read twice below
    new = first.where((F.col("status") == CANDIDATE) & ~F.col("proposed")).select("ref", "artifact", "cls", "name", "desc")
    within = new.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).join(opened, "artifact", "left")
    allowed = within.where(F.col("place") <= cap - F.coalesce("opened", F.lit(0))).select("ref", F.lit(True).alias("allowed"))
    limited = (F.col("status") == CANDIDATE) & ~F.col("proposed") & F.col("allowed").isNull()
    marked = first.join(allowed, "ref", "left").withColumn("rate_limit", F.when(limited, F.lit(f"{cap} new proposals a day")))
    return evaluate(marked.drop("allowed", "reasons", "blockers", "status"))


def first_blocking(reasons: Column) -> Column:
    return F.try_element_at(F.filter(reasons, lambda r: F.substring_index(r, ":", 1).isin(*BLOCKING_HEADS)), F.lit(1))


def candidates(verdicts: DataFrame, limit: int) -> DataFrame:
    """The first candidates of each artifact, and how many of its methods could never have been seen."""
    order = W.partitionBy("artifact").orderBy("cls", "name", "desc")
    own = verdicts.where(F.col("status") == CANDIDATE).select("artifact", "cls", "name", "desc", "window_days", "usable_windows", "first_proposed")
    unseen = verdicts.groupBy("artifact").agg(F.count_if(effective_eligibility(F.col("eligibility"), F.col("installed")) == NO_PROBE).alias("never_instrumented"))
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).join(unseen, "artifact")


def run_summary(verdicts: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each artifact's run: every status with its count, zero or not, what the evidence is, and one line about windows."""
    of = lambda status: F.count_if(F.col("status") == status)
    e = effective_eligibility(F.col("eligibility"), F.col("installed"))
    counts = verdicts.groupBy("artifact").agg(
        of(LIVE).alias("live"), of(UNKNOWN).alias("unknown"), of(NOT_OBSERVABLE).alias("not_observable"), of(CANDIDATE).alias("candidates"), F.count_if(e == NO_PROBE).alias("never_instrumented"),
        F.count_if(F.col("inbound_edges") > 0).alias("entered"), F.count_if(F.col("outbound_edges") > 0).alias("left"), F.count_distinct(F.when(F.col("mask_reported"), F.col("cls"))).alias("classes_with_mask"),
        F.max("window_days").alias("window_days"), F.max("usable_windows").alias("usable_windows"), F.max("excluded_windows").alias("excluded_windows"), F.max(F.array_join("phases_covered", ", ")).alias("phases_covered"),
        F.max(F.array_join("phases_missing", ", ")).alias("phases_missing"), F.bool_or("edges_reported").alias("edges_reported"),
    )
    stored = windows.groupBy(F.col("build").alias("artifact")).agg(
        F.count_if(~F.col("environment").eqNullSafe(F.lit("production"))).alias("non_production"), F.count_if("degraded").alias("degraded"), F.count_if("tainted").alias("test_tainted")
    )
    note = (
        F.when(F.col("non_production").isNull(), "no window was stored").when(F.col("usable_windows") == 0, "no window is evidence of death")
        .when(F.col("non_production") > 0, "some windows are not of production").otherwise("all windows are of production")
    )
    joined = counts.join(stored, "artifact", "left").withColumn("note", note)
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("non_production", "degraded", "test_tainted")})


def instrumentation_gaps(verdicts: DataFrame) -> DataFrame:
    """Methods of each class by effective eligibility, those without a probe by name, what that points to, most of them first."""
    e = effective_eligibility(F.col("eligibility"), F.col("installed"))
    named = F.array_sort(F.collect_list(F.when(e == NO_PROBE, F.struct("name", "desc"))))
    of_class = verdicts.groupBy("artifact", "cls").agg(
        F.count_if(e == NO_PROBE).alias("never_instrumented"), F.count_if(e == NOT_OBSERVABLE).alias("not_observable"), F.count_if(e == DE_INSTRUMENTED).alias("de_instrumented"),
        F.count_if(e == OBSERVABLE).alias("observable"), F.bool_or("mask_reported").alias("mask_reported"), F.array_join(F.transform(named, lambda m: F.concat(m["name"], m["desc"])), " ").alias("methods"),
    )
    diagnosis = (
        F.when(~F.col("mask_reported"), "no mask was reported").when(F.col("never_instrumented") == 0, "all observable methods have probes")
        .when(F.col("observable") == 0, "no probe of the class is installed").otherwise("some probes are missing")
    )
    ranked = F.row_number().over(W.partitionBy("artifact").orderBy(F.desc("never_instrumented"), "cls"))
    return of_class.withColumns({"diagnosis": diagnosis, "place": ranked})


def blast_radius(verdicts: DataFrame, agg: DataFrame, limit: int = 200) -> DataFrame:
    """Of each method that sampled calls enter: its callers, the first ``limit`` with their own verdicts, and what to make of it."""
    named = verdicts.select("build", "cls", "idx", "status", F.concat("name", "desc").alias("method"))
    caller = named.select("build", F.col("cls").alias("caller_cls"), F.col("idx").alias("caller_idx"), F.col("status").alias("caller_status"), F.col("method").alias("caller"))
    target = named.select("build", F.col("cls").alias("callee_cls"), F.col("idx").alias("callee_idx"), "status")
    callee = ["build", "callee_cls", "callee_idx"]
    order = W.partitionBy(*callee).orderBy(F.desc("observations"), "caller_cls", "caller_idx")
    each = agg.join(caller, ["build", "caller_cls", "caller_idx"], "left")
    totals = each.groupBy(*callee).agg(F.count("*").alias("callers"), F.sum("observations").alias("observations"), F.coalesce(F.bool_or(F.col("caller_status") == LIVE), F.lit(False)).alias("any_live"))
    text = F.concat(F.coalesce("caller", F.lit("?")), F.lit("="), F.coalesce("caller_status", F.lit("not in the inventory")))
    first = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    shown = first.groupBy(*callee).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]), " ").alias("shown"))
    guidance = F.when(F.col("any_live"), "live callers enter it: a change reaches them").otherwise("no live caller was seen, which proves nothing")
    return totals.join(shown, callee).join(target, callee).withColumns({"cut": F.col("callers") > limit, "guidance": guidance})


def by_class(verdicts: DataFrame, cls: str) -> DataFrame:
    return verdicts.where(F.col("cls") == cls)


def by_package(verdicts: DataFrame, package: str) -> DataFrame:
    """Of a package and all below it."""
    return verdicts.where((F.col("cls") == package) | F.col("cls").startswith(f"{package}."))


def by_file(verdicts: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """Of classes(cls, source_file) in a file, named in full or by the end of its path."""
    found = classes.where((F.col("source_file") == path) | F.col("source_file").endswith(f"/{path}")).select("cls").distinct()
    return verdicts.join(found, "cls", "left_semi")


def windows_listed(windows: DataFrame, by_build: DataFrame) -> DataFrame:
    """Every stored window with its days, whether it proves death, why not, and what its build's windows cover together."""
    environment = F.coalesce("environment", F.lit("unclassified"))
    why = (
        F.when(~F.coalesce(F.col("environment").isin("production", "prod"), F.lit(False)), F.concat(F.lit("not of production: "), environment))
        .when(F.col("tainted"), "test code was running").when(F.col("degraded"), "degraded: shows life only")
    )
    listed = windows.select("build", "instance", F.col("day").alias("start"), F.col("end_day").alias("stop"), F.date_diff("end_day", "day").alias("days"), why.isNull().alias("usable"), F.coalesce(why, F.lit("")).alias("why"))
    of_build = by_build.select("build", F.coalesce("window_days", F.lit(0)).alias("window_days"), F.array_join("phases_covered", ", ").alias("phases_covered"), F.array_join("phases_missing", ", ").alias("phases_missing"))
    return listed.join(of_build, "build")


def hot_paths(agg: DataFrame, inventory: DataFrame, limit: int) -> DataFrame:
    """The most observed edges of each build with both methods' names, their rate if there is one, and the calls that it stands for."""
    named = inventory.select("build", "cls", "idx", F.concat("name", "desc").alias("method"))
    first = hot_edges(estimate(agg), limit)
    for side in ("caller", "callee"):
        own = named.select("build", F.col("cls").alias(f"{side}_cls"), F.col("idx").alias(f"{side}_idx"), F.col("method").alias(side))
        first = first.join(own, ["build", f"{side}_cls", f"{side}_idx"], "left")
    return first.select("build", "place", "caller_cls", "caller", "callee_cls", "callee", "observations", "windows", "uniform_rate", "estimated_calls")
