"""Proposals and what reviewers said about them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import placed


def feedback_stats(feedback: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """feedback(rule_key, kind): rates over judged reports; few judgements keep a rule active. A state in forced(rule_key, state) holds whatever the rates say."""
    s = feedback.groupBy("rule_key").agg(
        F.count_if(F.col("kind") == "report").alias("reports"), F.count_if(F.col("kind") == "actioned").alias("actioned"), F.count_if(F.col("kind") == "not_useful").alias("not_useful")
    )
    judged = F.col("actioned") + F.col("not_useful")
    rate = F.col("not_useful") / judged
    status = F.when(judged < 10, "ACTIVE").when(rate >= 0.25, "DISABLED").when(rate >= 0.10, "PROBATION").otherwise("ACTIVE")
    found = s.withColumns({"rate": F.round(F.when(judged > 0, rate), 4), "status": status})
    if forced is None:
        return found
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("reports", "actioned", "not_useful")}
    return found.join(forced, "rule_key", "full_outer").withColumns({**zero, "status": F.coalesce("state", "status", F.lit("ACTIVE"))}).drop("state")


def cap_new(candidates: DataFrame, opened: DataFrame, cap: int) -> DataFrame:
    """allowed: candidates already known, and the first ``cap`` less opened(artifact, opened) today of each artifact's new ones.

    New ones come by class, name and descriptor; an artifact with most of them is not one task's work.
    """
    new = placed(candidates.where("not known"), ["artifact"], ["cls", "name", "desc"]).join(opened, "artifact", "left")
    allowed = new.withColumn("allowed", F.col("place") <= cap - F.coalesce("opened", F.lit(0))).drop("place", "opened")
    return candidates.where("known").withColumn("allowed", F.lit(True)).unionByName(allowed)


def reconciled(candidates: DataFrame, previous: DataFrame, inventory: DataFrame, keys: list[str], today: dt.date) -> DataFrame:
    """The next ledger: keys, active, first_proposed, revoked_at, reason.

    Candidates are confirmed: opened or active again, first_proposed set once, what revoked them cleared. Active proposals that
    are none are revoked, by what blocks them in the inventory(keys, blocking), or because it no longer has them.
    """
    now = candidates.select(*keys).distinct().withColumn("now", F.lit(True))
    joined = previous.withColumn("was", F.lit(True)).join(now, keys, "full_outer").join(inventory.select(*keys, "blocking", F.lit(True).alias("there")), keys, "left")
    going = F.col("now").isNull() & F.col("active")
    why = F.when(F.col("there"), F.concat(F.lit("no longer a candidate: "), F.coalesce("blocking", F.lit("clause no longer satisfied")))).otherwise("method no longer present in the inventory")
    return joined.select(
        *keys, F.coalesce("now", F.lit(False)).alias("active"), F.when(F.col("was"), F.col("first_proposed")).otherwise(F.lit(today)).alias("first_proposed"),
        F.when(F.col("now").isNull(), F.when(going, F.lit(today)).otherwise(F.col("revoked_at"))).alias("revoked_at"), F.when(F.col("now").isNull(), F.when(going, why).otherwise(F.col("reason"))).alias("reason"),
    )


def revoked(ledger: DataFrame, today: dt.date) -> DataFrame:
    return ledger.where(F.col("revoked_at") == F.lit(today))


def reconcile(candidates: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """state: confirmed (in both), opened (new) or revoked (no longer a candidate)."""
    now, before = candidates.select(*keys).distinct().withColumn("now", F.lit(True)), previous.select(*keys).distinct().withColumn("before", F.lit(True))
    state = F.when(F.col("now") & F.col("before"), "confirmed").when(F.col("now"), "opened").otherwise("revoked")
    return now.join(before, keys, "full_outer").select(*keys, state.alias("state"))
