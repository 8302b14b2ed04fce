"""Coverage bits and install masks, one row a set bit. All merges are commutative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIT = ("build", "cls", "idx")


def explode_bits(records: DataFrame, column: str = "probes") -> DataFrame:
    """A row for each set bit, least significant first; out of range is not set."""
    octet = F.expr(f"conv(hex(substring(`{column}`, cast(idx div 8 as int) + 1, 1)), 16, 10)").cast("int")
    spread = records.withColumn("idx", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length(column) * 8 - 1, F.lit(0)))))
    return spread.where(F.expr(f"octet_length(`{column}`) > 0") & (F.shiftright(octet * 1, 0).bitwiseAND(F.expr("shiftleft(1, idx % 8)")) != 0)).drop(column)


def pack_bits(bits: DataFrame, keys: list[str], least_bytes: int = 0) -> DataFrame:
    """The bits of each key as hexadecimal octets, wide enough for the highest one."""
    octets = bits.select(*keys, "idx").distinct().groupBy(*keys, F.floor(F.col("idx") / 8).cast("int").alias("at")).agg(
        F.sum(F.expr("shiftleft(1, idx % 8)")).alias("octet")
    )
    grouped = octets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "octet"))).alias("m"), F.max("at").alias("top"))
    places = F.sequence(F.lit(0), F.greatest("top", F.lit(least_bytes - 1)))
    return grouped.select(*keys, F.array_join(F.transform(places, lambda i: F.lpad(F.hex(F.coalesce(F.element_at("m", i), F.lit(0))), 2, "0")), "").alias("octets"))


def merge_bits(bits: DataFrame) -> DataFrame:
    """OR over windows and instances, with first and last sight at the window's end."""
    return bits.groupBy(*BIT).agg(F.min(F.date_add("day", 1)).alias("first_seen"), F.max(F.date_add("day", 1)).alias("last_seen"), F.count("*").alias("windows"))


def death_evidence(installed: DataFrame, probes: DataFrame) -> DataFrame:
    """Installed and never set: the only evidence of death."""
    return installed.select(*BIT).distinct().join(probes.select(*BIT).distinct(), list(BIT), "left_anti")


def popcounts(bits: DataFrame) -> DataFrame:
    return bits.select(*BIT).distinct().groupBy("build", "cls").agg(F.count("*").alias("set_bits"))


def newly_set(bits: DataFrame) -> DataFrame:
    """For each window, how many bits no earlier window of the build had set."""
    first = bits.groupBy(*BIT).agg(F.min(F.struct("day", "instance")).alias("at"))
    return first.groupBy("build", F.col("at.instance").alias("instance"), F.col("at.day").alias("day")).agg(F.count("*").alias("new_bits"))


def merge_masks(masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bits ever installed; and classes that reported a mask, with windows, first and last."""
    records = masks.select("build", "cls", "instance", "day").distinct()
    reported = records.groupBy("build", "cls").agg(F.count("*").alias("windows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return masks.select(*BIT).distinct(), reported


def installed_state(keys: DataFrame, masks: DataFrame) -> DataFrame:
    """keys with installed: null where the class reported no mask, else whether the bit is in it."""
    bits, reported = merge_masks(masks)
    known = keys.join(reported.select("build", "cls", F.lit(True).alias("reported")), ["build", "cls"], "left")
    return known.join(bits.withColumn("bit", F.lit(True)), list(BIT), "left").withColumn(
        "installed", F.when(F.col("reported"), F.col("bit").isNotNull())
    ).drop("reported", "bit")


def mask_totals(masks: DataFrame) -> DataFrame:
    bits, _ = merge_masks(masks)
    return bits.groupBy("build").agg(F.count_distinct("cls").alias("classes"), F.count("*").alias("indices"))


def inconsistent(probes: DataFrame, masks: DataFrame) -> DataFrame:
    """Probes that are set though the same record's own mask says they are not installed."""
    record = ["build", "instance", "day", "cls"]
    with_mask = probes.join(masks.select(*record).distinct(), record, "left_semi")
    return with_mask.join(masks, [*record, "idx"], "left_anti").groupBy("build", "cls").agg(F.count("*").alias("bits"))


def loaded_classes(events: DataFrame) -> DataFrame:
    loads = events.select("build", "instance", "day", "cls").distinct()
    return loads.groupBy("build", "cls").agg(F.min(F.date_add("day", 1)).alias("first_seen"), F.max(F.date_add("day", 1)).alias("last_seen"), F.count("*").alias("load_windows"))


def changed_since(bits: DataFrame) -> DataFrame:
    """For each class record of an instance, whether it set a bit that the instance had not set before."""
    first = bits.groupBy("build", "instance", "cls", "idx").agg(F.min("day").alias("day"))
    new = first.groupBy("build", "instance", "cls", "day").agg(F.count("*").alias("n"))
    records = bits.select("build", "instance", "cls", "day").distinct()
    return records.join(new, ["build", "instance", "cls", "day"], "left").select("build", "instance", "cls", "day", F.col("n").isNotNull().alias("changed"))


def fully_covered(masks: DataFrame, probes: DataFrame) -> DataFrame:
    bits, _ = merge_masks(masks)
    hit = bits.join(probes.select(*BIT).distinct().withColumn("hit", F.lit(True)), list(BIT), "left")
    return hit.groupBy("build", "cls").agg(F.bool_and(F.col("hit").isNotNull()).alias("fully_covered"))


def guard_schema(records: DataFrame, order: list[Column]) -> DataFrame:
    """records(build, cls, schema_hash, ...) with accepted: the first stored hash of a class wins."""
    first = records.groupBy("build", "cls").agg(F.min_by("schema_hash", F.struct(*order)).alias("first_hash"))
    return records.join(first, ["build", "cls"]).withColumn("accepted", F.col("schema_hash") == F.col("first_hash")).drop("first_hash")


def last_window(bits: DataFrame) -> DataFrame:
    """The latest window of each build and class."""
    w = W.partitionBy("build", "cls").orderBy(F.desc("day"), "instance")
    return bits.select("build", "cls", "day", "instance").distinct().withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def seen_classes(bits: DataFrame) -> DataFrame:
    """When each class was first and last seen, with how many probes, on how many days."""
    return bits.groupBy("build", "cls").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("idx").alias("bits"), F.count_distinct("day").alias("days")
    )
