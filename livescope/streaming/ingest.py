"""Windows and call events as streams: the batch operators over whatever has arrived."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..sources import windows


def _sinks(decoded: DataFrame) -> dict[str, DataFrame]:
    return {
        "windows": windows.windows(decoded), "coverage": windows.coverage_records(decoded), "loads": windows.loaded_classes(decoded), "edges": windows.edges(decoded), "profiles": windows.profiles(decoded),
    }


def write_tables(decoded: DataFrame, sink: str, part: str, mode: str = "overwrite") -> dict:
    """Decoded documents written once, counted in that pass, and then as the tables that accepted ones bring. Gives the counts.

    Every table has its own folder below ``sink`` and in it one for ``part`` (such as ``epoch=7``); writing a part again replaces it.
    """
    spark, seen = decoded.sparkSession, Observation()
    decoded.observe(seen, *windows.counters()).write.mode(mode).parquet(f"{sink}/documents/{part}")
    stored = spark.read.parquet(f"{sink}/documents/{part}")
    for name, table in _sinks(stored).items():
        table.write.mode(mode).parquet(f"{sink}/{name}/{part}")
    return seen.get


def append_windows(spark: SparkSession, source: str, sink: str, checkpoint: str, allowed: Sequence[str] = (), strict: bool = False, files: int | None = None) -> list[dict]:
    """Decode all documents that are waiting, each batch as a part of its own; the counts of the batches that ran.

    A batch that runs again overwrites what it wrote, so a retry adds nothing twice. ``files`` bounds a batch.
    """
    counts: list[dict] = []

    def write(batch: DataFrame, number: int) -> None:
        counts.append(write_tables(windows.decode_windows(batch, allowed, strict), sink, f"epoch={number}"))

    stream = windows.stream_windows(spark, source, files=files)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


def roll_up_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per-minute calls and errors of a stream of call events with ts; later rows than the watermark are dropped."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy("build", "cls", "idx", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("calls"), F.count_if("err").alias("errors"))


GUARDED = "build string, cls string, instance string, start_ms long, accepted boolean, new_bits int"


def _guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One class of a build: the first hash that was ever stored, and every bit that was ever set, over all batches."""
    first, seen = state.get if state.exists else (None, b"")
    seen = int.from_bytes(seen, "little")
    rows = pd.concat(batches).sort_values(["start_ms", "instance"], kind="stable")
    out = []
    for instance, start, schema_hash, probes in zip(rows["instance"], rows["start_ms"], rows["schema_hash"], rows["probes"], strict=True):
        first = schema_hash if first is None else first
        accepted = schema_hash == first
        bits = int.from_bytes(probes or b"", "little") if accepted else 0
        out.append((*key, instance, start, accepted, (bits & ~seen).bit_count()))
        seen |= bits
    state.update((first, seen.to_bytes(-(-seen.bit_length() // 8), "little")))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in GUARDED.split(", ")])


def guard_stream(records: DataFrame) -> DataFrame:
    """A stream of coverage records (build, cls, instance, start_ms, schema_hash, probes) with accepted and new_bits.

    The first hash of a class that arrives wins, within a batch the one of the earliest window; records with another hash are not accepted
    and set nothing. new_bits counts bits that no accepted record before has set. State is a hash and a bit a probe for each class of a build;
    a batch brings a class's records to one task, so ``files`` of the source bounds them.
    """
    keyed = records.select("build", "cls", "instance", "start_ms", "schema_hash", "probes").groupBy("build", "cls")
    return keyed.applyInPandasWithState(_guard, GUARDED, "first_hash string, seen binary", "append", "NoTimeout")


def append_guarded(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int | None = None) -> None:
    """Guard the coverage records of all documents that are waiting; state goes on from earlier calls with the same checkpoint."""
    records = windows.coverage_records(windows.decode_windows(windows.stream_windows(spark, source, files=files)))
    stream = guard_stream(records.where("production")).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
