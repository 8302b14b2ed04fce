"""Facts of each inventory method, assembled from the evidence of its build.

Every side is aggregated once to its own key and joined once: by (build, class, index) coverage, masks and sampled
edges; by (build, class) loads and reported masks; by build windows and phases; by method the call graph, rules and
proposals. What no side has said stays null where null means something: no mask, no proposal, an undecided call graph.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import admission, edges, graph, phases, verdict

BIT = ("build", "cls", "idx")


class Evidence(NamedTuple):
    """The store: windows, and rows of (build, instance, day, ...) beside them."""

    windows: DataFrame  # build, instance, day, end_day, environment, degraded, tainted
    coverage: DataFrame  # ..., cls, idx: probes that a window set
    mask_records: DataFrame  # ..., cls: class records that report a mask
    mask_bits: DataFrame  # ..., cls, idx: probes that are installed
    loads: DataFrame  # ..., cls: classes that a window reports as loaded
    edges: DataFrame  # ..., caller_cls, caller_idx, callee_cls, callee_idx, rate, observations


def by_probe(e: Evidence) -> DataFrame:
    """(build, cls, idx): first and last sight, installed somewhere, edges in and out, observations and rate of those in.

    One aggregation over all sides, so that all of them share one shuffle; edges are distinct before they are counted.
    """
    found = edges.edge_agg(e.edges)
    key = [F.col(c) for c in BIT]
    null = lambda kind: F.lit(None).cast(kind)
    columns = {"seen": null("date"), "installed": null("boolean"), "n_in": null("long"), "n_out": null("long"), "observations": null("long"), "min_rate": null("long"), "max_rate": null("long")}

    def side(rows: DataFrame, keys: list, **own) -> DataFrame:
        return rows.select(*keys, *[own.get(name, value).alias(name) for name, value in columns.items()])

    inbound = [F.col("build"), F.col("callee_cls").alias("cls"), F.col("callee_idx").alias("idx")]
    outbound = [F.col("build"), F.col("caller_cls").alias("cls"), F.col("caller_idx").alias("idx")]
    sides = [
        side(e.coverage.join(e.windows.select("build", "instance", "day", "end_day"), ["build", "instance", "day"]), key, seen=F.col("end_day")),
        side(e.mask_bits, key, installed=F.lit(True)),
        side(found, inbound, n_in=F.lit(1).cast("long"), observations=F.col("observations"), min_rate=F.col("min_rate"), max_rate=F.col("max_rate")),
        side(found, outbound, n_out=F.lit(1).cast("long")),
    ]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    return rows.groupBy(*BIT).agg(
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.bool_or("installed").alias("bit"), F.sum("n_in").alias("inbound_edges"), F.sum("n_out").alias("outbound_edges"),
        F.sum("observations").alias("inbound_observations"), F.when((F.min("min_rate") > 0) & (F.min("min_rate") == F.max("max_rate")), F.min("min_rate")).alias("inbound_rate"),
    )


def by_class(e: Evidence) -> DataFrame:
    """(build, cls): loaded in some window, and whether any record reported a mask."""
    rows = e.loads.select("build", "cls", F.lit(True).alias("loaded"), F.lit(None).cast("boolean").alias("reported")).unionByName(
        e.mask_records.select("build", "cls", F.lit(None).cast("boolean").alias("loaded"), F.lit(True).alias("reported"))
    )
    return rows.groupBy("build", "cls").agg(F.bool_or("loaded").alias("class_loaded"), F.bool_or("reported").alias("mask_reported"))


def by_build(windows: DataFrame, found: DataFrame, calendar: phases.Calendar) -> DataFrame:
    """build: usable and excluded windows, whole days, phases, whether edges were reported, and their rate if there is one.

    ``windows`` are all that were stored; ``found`` are the edges of windows that are evidence.
    """
    marked = admission.usable(windows, F.col("tainted"))
    counts = marked.groupBy("build").agg(F.count_if("death").alias("usable_windows"), F.count_if(~F.col("death")).alias("excluded_windows"))
    intervals = marked.where("death").select("build", F.col("day").alias("start"), F.col("end_day").alias("stop"))
    merged = phases.merge_intervals(intervals)
    covered = phases.phase_lists(phases.phase_coverage(counts, merged, calendar))
    rates = found.groupBy("build").agg(F.lit(True).alias("edges_reported"), F.when((F.min("rate") > 0) & (F.min("rate") == F.max("rate")), F.min("rate")).alias("build_rate"))
    days = phases.span(merged).select("build", "window_days")
    return counts.join(covered, "build", "left").join(days, "build", "left").join(rates, "build", "left")


def method_facts(
    inventory: DataFrame, evidence: Evidence, calendar: phases.Calendar, static: DataFrame, suppressed: DataFrame, kinds: DataFrame, disabled: DataFrame, proposals: DataFrame, min_window_days: int = 0
) -> DataFrame:
    """One row per method of inventory(ref, build, cls, name, desc, idx, eligibility, ...) with all that a verdict asks.

    static(ref, static_reachable), suppressed(ref, suppression), kinds(build, cls, kind), disabled(rule_key),
    proposals(ref, active, first_proposed, reason). Windows that are no evidence add nothing but their count.
    """
    alive = [admission.evidence_only(x, evidence.windows) for x in evidence[1:]]
    own = Evidence(evidence.windows, *alive)
    nobody = F.array(*map(F.lit, calendar.required)) if calendar.required else F.array().cast("array<string>")
    joined = (
        inventory.join(by_probe(own), list(BIT), "left").join(by_class(own), ["build", "cls"], "left").join(kinds, ["build", "cls"], "left")
        .join(by_build(evidence.windows, own.edges, calendar), "build", "left")
        .join(static.select("ref", "static_reachable"), "ref", "left").join(suppressed.select("ref", "suppression"), "ref", "left")
        .join(proposals.select("ref", F.col("active").alias("proposed"), "first_proposed", F.col("reason").alias("revoked_reason")), "ref", "left")
    )
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    facts = joined.withColumns({
        "installed": F.when(F.col("mask_reported"), F.col("bit").isNotNull()), "mask_reported": F.coalesce("mask_reported", F.lit(False)),
        "observed": F.col("first_seen").isNotNull(), "class_loaded": F.coalesce("class_loaded", F.lit(False)), "suppressed": F.col("suppression").isNotNull(),
        **{name: zero(name) for name in ("inbound_edges", "outbound_edges", "inbound_observations", "usable_windows", "excluded_windows")},
        "sample_rate": F.coalesce("inbound_rate", "build_rate"), "edges_reported": F.coalesce("edges_reported", F.lit(False)), "window_days": F.coalesce("window_days", F.lit(0)),
        "phases_covered": F.coalesce("phases_covered", F.array().cast("array<string>")), "phases_missing": F.coalesce("phases_missing", nobody),
        "min_window_days": F.lit(min_window_days), "entry_kind": F.coalesce("kind", F.lit("none")), "proposed": F.coalesce("proposed", F.lit(False)),
    })
    return with_disabled_key(facts, disabled).drop("bit", "kind", "inbound_rate", "build_rate")


def rule_keys(facts: DataFrame) -> DataFrame:
    """With rule_keys: the classes of rules that a verdict of this method belongs to, by entry kind and effective eligibility."""
    effective = verdict.effective_eligibility(F.col("eligibility"), F.col("installed"))
    return facts.withColumn("rule_keys", F.array(F.concat(F.lit("entrypoint:"), "entry_kind"), F.concat(F.lit("eligibility:"), effective)))


def with_disabled_key(facts: DataFrame, disabled: DataFrame) -> DataFrame:
    """With rule_keys and disabled_key, the first of them that is in disabled(rule_key), or null.

    Most methods share a few keys; the disabled ones are written first, so that Spark knows their size and needs no shuffle by key while they are few.
    """
    off = graph.kept(disabled.select("rule_key").distinct())
    first, second = (off.select(F.col("rule_key").alias(f"off_{n}")) for n in (0, 1))
    keyed = rule_keys(facts)
    hit = keyed.join(first, keyed["rule_keys"][0] == F.col("off_0"), "left").join(second, keyed["rule_keys"][1] == F.col("off_1"), "left")
    return hit.withColumn("disabled_key", F.coalesce("off_0", "off_1")).drop("off_0", "off_1")


def edges_of_evidence(window_edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Sums of the edges of windows that are evidence of life."""
    return edges.edge_agg(admission.evidence_only(window_edges, windows))
