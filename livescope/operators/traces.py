"""Frames of request traces, as rows with a parent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import denied_name


def frames(conversations: DataFrame) -> DataFrame:
    turn = F.col("turn")
    return conversations.select(
        F.col("conv_id").alias("trace"), turn.alias("ordinal"), F.when(turn > 0, F.floor((turn - 1) / 2).cast("int")).alias("parent"), F.col("role").alias("frame"),
        F.length("text").alias("size_in"), (F.length("text") - turn % 3).alias("size_out"), F.when(turn % 5 == 4, "E").alias("threw"),
    )


def size_deltas(frames: DataFrame) -> DataFrame:
    return frames.withColumn("delta", F.col("size_out") - F.col("size_in")).where("delta <> 0").select("trace", "ordinal", "frame", "delta")


def outcomes(frames: DataFrame) -> DataFrame:
    return frames.groupBy("frame", F.coalesce("threw", F.lit("none")).alias("threw")).agg(F.count("*").alias("frames"))


def pass_through(frames: DataFrame) -> DataFrame:
    """Frames that neither throw nor change a size."""
    return frames.withColumn("is_pass", F.col("threw").isNull() & (F.col("size_in") == F.col("size_out")))


def collapse(frames: DataFrame) -> DataFrame:
    """Kept frames with their nearest kept ancestor and how many frames were left out on the way.

    Parents are followed through elided frames a step a round; a trace is at most 256 deep.
    """
    marked = pass_through(frames).withColumn("is_pass", F.col("is_pass") & F.col("parent").isNotNull())
    up = marked.select("trace", F.col("ordinal").alias("at"), F.col("parent").alias("next"), F.col("is_pass").alias("skip"))
    out = marked.where("not is_pass").select("trace", "ordinal", F.col("parent").alias("at"), F.lit(0).alias("via"))
    done = None
    for _ in range(256):
        stepped = out.join(up, ["trace", "at"], "left")
        here = stepped.where("at is null or not skip").select("trace", "ordinal", F.col("at").alias("kept_parent"), "via")
        done = here if done is None else done.union(here)
        out = stepped.where("skip").select("trace", "ordinal", F.col("next").alias("at"), (F.col("via") + 1).alias("via"))
        if out.isEmpty():
            break
    return done


def invocations(frames: DataFrame) -> DataFrame:
    """How often each method ran: folded frames stand for as many as they say."""
    return frames.groupBy("frame").agg(F.sum(F.coalesce("repeated", F.lit(1).cast("long"))).alias("invocations"))


def via_counts(frames: DataFrame) -> DataFrame:
    """Frames and traces of the thread that a trace was on, and of those that joined it."""
    via = F.coalesce("via", F.lit("own")).alias("via")
    return frames.groupBy(via).agg(F.count("*").alias("frames"), F.count_distinct("trace").alias("traces"), F.count_distinct(F.when(F.col("via").isNotNull(), F.col("trace"))).alias("joined"))


def capped(frames: DataFrame, most: int = 20_000, deepest: int = 256) -> DataFrame:
    """Of each trace: frames within both caps, and which cap was hit."""
    place = F.row_number().over(W.partitionBy("trace").orderBy("ordinal"))
    fits, shallow = F.col("place") <= most, F.col("depth") < deepest
    return frames.withColumn("place", place).groupBy("trace").agg(
        F.count_if(fits & shallow).alias("kept"), F.bool_or(~fits).alias("frames_capped"), F.bool_or(~shallow).alias("depth_capped")
    )


def projected(observed: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """observed(type, member): how many are shown by an exact (type, member) list, and how many of those it names are refused by their name."""
    listed = F.lit(False)
    for kind, member in allowed:
        listed = listed | ((F.col("type") == kind) & (F.col("member") == member))
    denied = denied_name(F.col("member"))
    return observed.groupBy("type").agg(F.count_if(listed & ~denied).alias("shown"), F.count_if(listed & denied).alias("refused"))


def health(documents: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The latest cumulative counters of each instance, and whether one is above its limit."""
    latest = documents.groupBy("instance").agg(*[F.max_by(c, "started_at").alias(c) for c in limits])
    alert = F.lit(False)
    for c, most in limits.items():
        alert = alert | (F.col(c) > most)
    return latest.withColumn("alert", alert)


def fold_siblings(frames: DataFrame) -> DataFrame:
    """Identical siblings (all that they say, and the same subtree) as the first of them, with how many it stands for.

    What hangs below a folded sibling goes with it. Each trace is walked from its last frame to its
    first in one task; a trace has 20,000 frames at most, as ``capped`` sees to.
    """
    own = ["frame", "threw", "via", "truncated", "seen"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        said = pdf[own].astype(object).where(pdf[own].notna(), None).values.tolist()
        ordinals, parents = pdf["ordinal"].tolist(), [None if pd.isna(p) else int(p) for p in pdf["parent"]]
        children: dict[int, list[int]] = {}  # of each frame, the shapes of its children, last first
        shapes: dict[tuple, int] = {}
        shape = {}
        for at, parent, says in zip(reversed(ordinals), reversed(parents), reversed(said), strict=True):
            shape[at] = shapes.setdefault((*says, *children.pop(at, ())), len(shapes))
            if parent is not None:
                children.setdefault(parent, []).append(shape[at])
        first: dict[tuple, int] = {}
        times: dict[int, int] = {}
        for at, parent, n in zip(ordinals, parents, pdf["repeated"].tolist(), strict=True):
            if parent is not None and parent not in times:
                continue  # below a frame that was folded away
            kept = first.setdefault((parent, shape[at]), at)
            times[kept] = times.get(kept, 0) + int(n)
        out = pdf[pdf["ordinal"].isin(times.keys())][["trace", "ordinal", "parent", "frame"]].copy()
        out["parent"] = out["parent"].astype("Int64")
        out["repeated"] = out["ordinal"].map(times)
        return out

    schema = "trace string, ordinal long, parent long, frame string, repeated long"
    return frames.where("ordinal is not null").select("trace", "ordinal", "parent", "repeated", *own).groupBy("trace").applyInPandas(fold, schema)


#: Conditional jumps of one and of two operands.
JUMPS_ONE = ("IFEQ", "IFNE", "IFLT", "IFGE", "IFGT", "IFLE", "IFNULL", "IFNONNULL")
JUMPS_TWO = ("IF_ICMPEQ", "IF_ICMPNE", "IF_ICMPLT", "IF_ICMPGE", "IF_ICMPGT", "IF_ICMPLE", "IF_ACMPEQ", "IF_ACMPNE")


def arm(op: Column, lhs: Column, rhs: Column) -> Column:
    """then or else of a conditional jump, case of any other; one operand is compared with zero."""
    other = F.when(op.isin(*JUMPS_TWO), rhs).otherwise(F.lit(0))
    test = F.when(op == "IFNULL", "EQ").when(op == "IFNONNULL", "NE").otherwise(F.right(op, F.lit(2)))
    holds = (
        F.when(test == "EQ", lhs == other).when(test == "NE", lhs != other).when(test == "LT", lhs < other)
        .when(test == "GE", lhs >= other).when(test == "GT", lhs > other).when(test == "LE", lhs <= other)
    )
    return F.when(~op.isin(*JUMPS_ONE, *JUMPS_TWO), "case").when(holds, "then").otherwise("else")


def group_arms(taken: DataFrame) -> DataFrame:
    """taken(trace, ordinal, seq, site, op, lhs, rhs): how often each arm of a site was taken in a frame, and its place by first sight."""
    arms = taken.withColumn("arm", arm(F.col("op"), F.col("lhs"), F.col("rhs")))
    counted = arms.groupBy("trace", "ordinal", "site", "arm").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    place = F.row_number().over(W.partitionBy("trace", "ordinal").orderBy("first_seq"))
    return counted.select("trace", "ordinal", "site", "arm", "n", place.alias("place"))
