"""Which windows are evidence, of life and of death."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Environments that count as production.
ALLOWED = ("production", "prod")


def parse_environments(spec: str) -> list[str]:
    return [x for x in (part.strip().lower() for part in spec.split(",")) if x]


def sane(start: Column, end: Column) -> Column:
    """A window may not end before it starts; one without either end is not sane."""
    return F.coalesce(end >= start, F.lit(False))


#: Counters of the health object that must be whole numbers of zero or more where present.
COUNTERS = (
    "edgesSampleRate", "edgesSampledRoots", "edgesRecorded", "edgesDropped", "edgesTruncatedDepth", "edgesTruncatedRoot", "edgesTruncatedDistinct", "edgeTierFailures",
    "edgeTracesReaped",
)


def check_health(doc: Column) -> tuple[Column, Column]:
    """Of a document (variant): why its health object is refused, or null, and its count of missing strip masks, where a flag is 0 or 1."""
    value = lambda key: F.try_variant_get(doc, f"$.agentHealth{key}", "variant")
    kind = lambda key: F.coalesce(F.schema_of_variant(value(key)), F.lit("VOID"))
    number = lambda key: F.try_variant_get(doc, f"$.agentHealth{key}", "bigint")
    bad = ~(kind(".classesSkipped").startswith("OBJECT") | (kind(".classesSkipped") == "VOID"))
    for key in COUNTERS:
        k = kind(f".{key}")
        bad = bad | ~((k == "VOID") | ((k == "BIGINT") & (number(f".{key}") >= 0)))
    k, flag = kind(".stripMaskMissing"), F.try_variant_get(doc, "$.agentHealth.stripMaskMissing", "boolean")
    bad = bad | ~(k.isin("VOID", "BOOLEAN") | ((k == "BIGINT") & (number(".stripMaskMissing") >= 0)))
    reason = F.when(~kind("").startswith("OBJECT"), "missing_agent_health").when(bad, "bad_field")
    missing = F.when(k == "BOOLEAN", flag.cast("bigint")).otherwise(F.coalesce(number(".stripMaskMissing"), F.lit(0).cast("bigint")))
    return reason, F.when(reason.isNull(), missing)


def classify_environment(labels: Sequence[Column], allowed: Sequence[str] = ALLOWED) -> tuple[Column, Column]:
    """The first label that is not blank, trimmed and in lower case, and whether it is allowed."""
    label = F.lower(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in labels]))
    return label, F.coalesce(label.isin(*allowed), F.lit(False))


def evidence_flag(production: Column, liveness: Column) -> Column:
    """Production, and the agent did not say no; a missing word is not a no."""
    return production & ~liveness.eqNullSafe(F.lit(False))


def usable(windows: DataFrame, tainted: Column | None = None) -> DataFrame:
    """With production, life and death: a degraded window shows life but proves no death."""
    _, production = classify_environment([F.col("environment")])
    life = production & ~(tainted if tainted is not None else F.lit(False))
    return windows.withColumns({"production": production, "life": life, "death": life & ~F.col("degraded")})


def evidence_split(windows: DataFrame) -> DataFrame:
    """Windows of a build: usable, excluded as degraded, and not of production, by environment."""
    u = usable(windows)
    return u.groupBy("build", F.coalesce("environment", F.lit("unclassified")).alias("environment")).agg(
        F.count_if("death").alias("usable"), F.count_if(F.col("life") & ~F.col("death")).alias("excluded"), F.count_if(~F.col("life")).alias("withheld")
    )


def withheld(bits: DataFrame, windows: DataFrame) -> DataFrame:
    """What a window without evidence would have added, counted and not merged."""
    held = usable(windows).where("not life").select("build", "instance", "day")
    return bits.join(held, ["build", "instance", "day"], "left_semi").groupBy("build").agg(
        F.count("*").alias("bits"), F.count_distinct("instance", "day", "cls").alias("records"), F.count_distinct("cls").alias("classes")
    )


def evidence_only(rows: DataFrame, windows: DataFrame, of: str = "life") -> DataFrame:
    """The rows of windows that are evidence of ``life`` or ``death``; nothing else goes into a merge."""
    tainted = F.col("tainted") if "tainted" in windows.columns else None
    return rows.join(usable(windows, tainted).where(of).select("build", "instance", "day"), ["build", "instance", "day"], "left_semi")
