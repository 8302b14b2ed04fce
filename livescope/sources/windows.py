"""Observation windows as JSON documents: reading, one ordered chain of checks, and the tables that accepted ones bring.

A document is refused whole with the name of the first check that fails; a coverage record of a test runner is dropped and
counted; everything else is kept as it came. A missing key is not a null one, a boolean is not a number, an empty string is refused
and a blank one is not. A window that is no evidence of production is stored and marked, or refused in strict mode.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import test_markers
from ..operators import admission
from ..operators import documents as records

#: Wire versions that are understood.
VERSIONS = (1, 2)
#: Larger documents, packed or unpacked, are refused unread.
LARGEST = 64 << 20
# Keys of a document in the order in which they are asked for, and where its environment label may stand.
TEXT, NUMBERS = ("buildSha", "artifact", "instanceId"), ("windowStartMs", "windowEndMs")
LABELS = ("agentHealth.environment", "jvmClassification.env", "jvmClassification.environment", "environment", "env")
_BASE64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
_BODY = pa.schema([("body", pa.string()), ("source_file", pa.string()), ("fault", pa.string())])


# ---- files


def unpacked(content: bytes, largest: int = LARGEST) -> tuple[str | None, str | None]:
    """The text of a plain or gzip file and null, or null and why it is refused. No more than ``largest`` bytes are unpacked."""
    if content[:2] == b"\x1f\x8b":
        out, rest = [], content
        left = largest + 1
        try:
            while rest:  # members may follow one another
                member = zlib.decompressobj(31)
                out.append(member.decompress(rest, left))
                left -= len(out[-1])
                if left <= 0:
                    return None, "payload_too_large"
                if not member.eof:
                    return None, "bad_gzip"
                rest = member.unused_data
        except zlib.error:
            return None, "bad_gzip"
        content = b"".join(out)
    if len(content) > largest:
        return None, "payload_too_large"
    try:
        return content.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        return None, "malformed_body"


def _unpack(largest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):  # a file at a time: one may take all its memory
                body, fault = unpacked(content.as_py(), largest)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (body, path.as_py(), fault)], schema=_BODY)

    return unpack


def _bodies(files: DataFrame, largest: int) -> DataFrame:
    kept = files.where(F.col("length") <= largest).select("path", "content").mapInArrow(_unpack(largest), "body string, source_file string, fault string")
    # Where content isn't asked for it isn't read.
    large = files.where(F.col("length") > largest).select(F.lit(None).cast("string").alias("body"), F.col("path").alias("source_file"), F.lit("payload_too_large").alias("fault"))
    return kept.unionByName(large)


def read_windows(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """A document a file, plain or gzip whatever its name: body, source_file, fault. A file that can't be read is a row with a fault.

    Spark's readers pass over files without a single byte.
    """
    return _bodies(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), largest)


def stream_windows(spark: SparkSession, path: str, largest: int = LARGEST, files: int | None = None) -> DataFrame:
    """The same documents as files arrive, at most ``files`` of them a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
    return _bodies((reader.option("maxFilesPerTrigger", files) if files else reader).load(path), largest)


# ---- checks


def _at(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}" if key else "$", kind)


def _kind(v: Column, key: str) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID for null, ...; null where the key is missing."""
    return F.schema_of_variant(_at(v, key))


def _set(v: Column, key: str) -> Column:
    """The key is there and not null."""
    return F.coalesce(_kind(v, key) != "VOID", F.lit(False))


def _map(v: Column, key: str) -> Column:
    return _at(v, key, "map<string, variant>")


def _list(v: Column, key: str) -> Column:
    return _at(v, key, "array<variant>")


def _truthy(v: Column, key: str) -> Column:
    """Set, and none of the values that count as nothing: false, zero, an empty text, list or object."""
    text = F.to_json(_at(v, key))
    return F.coalesce(~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _text_fault(v: Column, key: str) -> Column:
    return F.when(F.coalesce((_kind(v, key) != "STRING") | (_at(v, key, "string") == ""), F.lit(True)), "bad_field")


def _int_fault(v: Column, key: str) -> Column:
    return F.when(F.coalesce(_kind(v, key) != "BIGINT", F.lit(True)), "bad_field")


def _required(v: Column, key: str, fault: Callable[[Column, str], Column]) -> Column:
    return F.when(_kind(v, key).isNull(), "missing_field").otherwise(fault(v, key))


def _first(values: Column, fault: Callable[[Column], Column]) -> Column:
    """The fault of the first element that has one."""
    return F.try_element_at(F.filter(F.transform(values, fault), lambda x: x.isNotNull()), F.lit(1))


def _object_fault(v: Column) -> Column:
    return F.when(_map(v, "").isNull(), "bad_field")


def _frames(r: Column) -> Column:
    return F.transform(F.coalesce(_list(r, "frames"), F.array().cast("array<variant>")), lambda f: F.coalesce(F.try_variant_get(f, "$", "string"), F.lit("")))


def _of_test(r: Column) -> Column:
    return records.test_record(_at(r, "class", "string"), _frames(r))


def _base64_fault(v: Column, key: str) -> Column:
    return F.when(F.coalesce((_kind(v, key) != "STRING") | ~_at(v, key, "string").rlike(_BASE64), F.lit(True)), "bad_probe_bitset")


def _coverage_fault(r: Column) -> Column:
    bits = F.coalesce(F.when(_kind(r, "probes").isNotNull(), _base64_fault(r, "probes")), F.when(_set(r, "probesInstalled"), _base64_fault(r, "probesInstalled")))
    frames = F.when(_truthy(r, "frames") & _list(r, "frames").isNull(), "bad_field")
    return F.coalesce(_object_fault(r), _text_fault(r, "class"), _text_fault(r, "schemaHash"), frames, F.when(~_of_test(r), bits))


def _ids_fault(entries: Column, value_fault: Callable[[Column], Column]) -> Column:
    """Of a map by error id: ids are numbers from 1 to 255."""
    good = lambda k: F.trim(k).rlike("^[0-9]+$") & F.coalesce(F.try_to_number(F.trim(k), F.lit("99999")).between(1, 255), F.lit(False))
    return _first(F.map_entries(entries), lambda e: F.when(~good(e.key), "bad_error_class_id").otherwise(value_fault(e.value)))


def _name_fault(v: Column) -> Column:
    return F.when(F.coalesce((F.schema_of_variant(v) != "STRING") | (F.trim(F.try_variant_get(v, "$", "string")) == ""), F.lit(True)), "bad_field")


def _count_fault(v: Column) -> Column:
    return F.when(F.coalesce((F.schema_of_variant(v) != "BIGINT") | (F.try_variant_get(v, "$", "bigint") < 0), F.lit(True)), "bad_field")


def _profile_fault(r: Column) -> Column:
    keys = F.map_keys(_map(r, ""))
    scheme = F.when(_kind(r, "bucketScheme").isNotNull() & ~_at(r, "bucketScheme", "string").eqNullSafe(F.lit(records.HISTOGRAM)), "unknown_bucket_scheme")
    buckets = F.when(_truthy(r, "buckets") & _list(r, "buckets").isNull(), "bad_field")
    ready = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, records.PERCENTILES))), "bad_field")
    legacy = F.when(_set(r, "errorTypes") & _map(r, "errorTypes").isNull(), "bad_field")
    by_id = F.when(_set(r, "errorsByClass") & _map(r, "errorsByClass").isNull(), "bad_field").otherwise(_ids_fault(_map(r, "errorsByClass"), _count_fault))
    return F.coalesce(_object_fault(r), scheme, buckets, ready, legacy, _text_fault(r, "class"), _int_fault(r, "idx"), by_id)


def _edge_fault(r: Column) -> Column:
    keys = F.map_keys(_map(r, ""))
    rates = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, records.RATES))), "bad_field")
    count = F.when(_kind(r, "count").isNotNull(), _int_fault(r, "count"))
    number = lambda key: F.coalesce(_at(r, key, "bigint"), F.lit(0))
    negative = F.when((number("fromIdx") < 0) | (number("toIdx") < 0) | (number("count") < 0), "bad_field")
    return F.coalesce(_object_fault(r), rates, _text_fault(r, "fromClass"), _text_fault(r, "toClass"), _int_fault(r, "fromIdx"), _int_fault(r, "toIdx"), count, negative)


def _listed(v: Column, key: str, fault: Callable[[Column], Column]) -> Column:
    return F.when(_set(v, key) & _list(v, key).isNull(), "bad_field").otherwise(_first(_list(v, key), fault))


def decode_windows(bodies: DataFrame, allowed: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """bodies(body, and fault where files were read) with doc (variant), environment, production, and reject_reason: the first check that failed, or null.

    ``allowed`` are environments that count as production besides the two usual ones; ``strict`` refuses all others.
    """
    found = bodies.withColumn("doc", F.try_parse_json("body"))
    v = F.col("doc")
    label, in_list = admission.classify_environment([_at(v, key, "string") for key in LABELS], (*admission.ALLOWED, *allowed))
    production = admission.evidence_flag(in_list, _at(v, "agentHealth.livenessEvidence", "boolean"))
    version = F.when(_int_fault(v, "schemaVersion").isNull() & ~_at(v, "schemaVersion", "bigint").isin(*VERSIONS), "schema_version_mismatch")
    health, missing = admission.check_health(v)
    rate = F.coalesce(_at(v, "agentHealth.edgesSampleRate", "bigint"), F.lit(0))
    loaded = _list(v, "classesLoaded")
    names = F.transform(F.coalesce(loaded, F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$", "string"))
    read_fault = F.col("fault") if "fault" in bodies.columns else F.lit(None).cast("string")
    checks = [
        read_fault,
        F.when(F.octet_length("body") > LARGEST, "payload_too_large"),
        F.when(_map(v, "").isNull(), "malformed_body"),
        _required(v, "schemaVersion", _int_fault), version,
        *[_required(v, key, _text_fault) for key in TEXT], *[_required(v, key, _int_fault) for key in NUMBERS],
        F.when(~admission.sane(_at(v, "windowStartMs", "bigint"), _at(v, "windowEndMs", "bigint")), "bad_field"),
        health, F.when((rate > 0) & (F.bit_count(rate) != 1), "bad_field"),
        F.when(F.lit(strict) & ~production, "not_production_classified"),
        F.when(_truthy(v, "agentHealth.testRunnerDetected"), "test_runner_window"),
        F.when(_truthy(v, "classesLoaded") & loaded.isNull(), "bad_field"),
        _first(loaded, lambda c: F.when(F.coalesce((F.schema_of_variant(c) != "STRING") | (F.try_variant_get(c, "$", "string") == ""), F.lit(True)), "bad_field")),
        F.when(F.size(test_markers(names)) > 0, "test_runner_window"),
        _listed(v, "coverage", _coverage_fault),
        F.when(_set(v, "errorClasses") & _map(v, "errorClasses").isNull(), "bad_field").otherwise(_ids_fault(_map(v, "errorClasses"), _name_fault)),
        _listed(v, "tier2", _profile_fault),
        _listed(v, "edges", _edge_fault),
        F.when((F.size(F.coalesce(_list(v, "edges"), F.array().cast("array<variant>"))) > 0) & (rate == 0), "bad_field"),
    ]
    return found.withColumns({"environment": F.coalesce(label, F.lit("unclassified")), "production": production, "mask_missing": missing, "reject_reason": F.coalesce(*checks)}).drop("fault")


def check_endpoints(decoded: DataFrame, known: DataFrame, document: str = "source_file") -> DataFrame:
    """decoded with unknown_edge_endpoint for documents whose edges name a method that known(build, cls, idx) lacks, and edges_verified.

    A build without any known method can't be checked: its edges stay, unverified. Endpoints are looked up last, by one join of distinct
    endpoints; documents are told apart by the column ``document``.
    """
    e = edges(decoded, document)
    ends = e.select(document, "build", F.explode(F.array(F.struct(F.col("caller_cls").alias("cls"), F.col("caller_idx").alias("idx")), F.struct(F.col("callee_cls").alias("cls"), F.col("callee_idx").alias("idx")))).alias("m"))
    ends = ends.select(document, "build", "m.cls", "m.idx").distinct()
    builds = known.select("build").distinct()
    dangling = ends.join(builds, "build", "left_semi").join(known.select("build", "cls", "idx").distinct(), ["build", "cls", "idx"], "left_anti").select(document).distinct()
    of_known = builds.select(F.col("build").alias("known_build"), F.lit(True).alias("edges_verified"))
    with_build = decoded.join(of_known, _at(F.col("doc"), "buildSha", "string") == F.col("known_build"), "left").drop("known_build")
    marked = with_build.join(dangling.withColumn("dangling", F.lit(True)), document, "left")
    reason = F.coalesce("reject_reason", F.when(F.col("dangling"), "unknown_edge_endpoint"))
    return marked.withColumns({"reject_reason": reason, "edges_verified": F.coalesce("edges_verified", F.lit(False))}).drop("dangling")


# ---- what accepted documents bring


def _accepted(decoded: DataFrame, *others: str) -> DataFrame:
    v = F.col("doc")
    return decoded.where("reject_reason is null").select(
        *others, _at(v, "buildSha", "string").alias("build"), _at(v, "artifact", "string").alias("artifact"), _at(v, "instanceId", "string").alias("instance"),
        _at(v, "windowStartMs", "bigint").alias("start_ms"), _at(v, "windowEndMs", "bigint").alias("end_ms"), "production", "environment", "doc",
    )


KEYS = ("build", "instance", "start_ms", "end_ms")


def windows(decoded: DataFrame) -> DataFrame:
    """One row an accepted document: its keys, environment, production, degraded, clock_degraded, mask_missing, edges reported."""
    flag = lambda key: _truthy(F.col("doc"), f"agentHealth.{key}")
    return _accepted(decoded, "mask_missing").select(
        *KEYS, "artifact", "environment", "production", flag("degraded").alias("degraded"), flag("clockDegraded").alias("clock_degraded"), "mask_missing", _kind(F.col("doc"), "edges").isNotNull().alias("edges_present"),
        _at(F.col("doc"), "agentHealth.edgesSampleRate", "bigint").alias("rate"),
    )


def coverage_records(decoded: DataFrame) -> DataFrame:
    """A record a row, those of test runners left out: cls, schema_hash, probes and installed (binary, null where no mask was sent)."""
    rows = _accepted(decoded).select(*KEYS, "production", F.explode(_list(F.col("doc"), "coverage")).alias("r"))
    r = F.col("r")
    return rows.where(~_of_test(r)).select(
        *KEYS, "production", _at(r, "class", "string").alias("cls"), _at(r, "schemaHash", "string").alias("schema_hash"),
        F.unbase64(F.coalesce(_at(r, "probes", "string"), F.lit(""))).alias("probes"), F.unbase64(_at(r, "probesInstalled", "string")).alias("installed"),
    )


def accepted_coverage(decoded: DataFrame) -> DataFrame:
    """build, instance, start_ms, end_ms, cls, probes (binary) of accepted documents."""
    return coverage_records(decoded).select(*KEYS, "cls", "probes")


def loaded_classes(decoded: DataFrame) -> DataFrame:
    return _accepted(decoded).select(*KEYS, "production", F.explode(_at(F.col("doc"), "classesLoaded", "array<string>")).alias("cls"))


def edges(decoded: DataFrame, *others: str) -> DataFrame:
    """An edge a row with the window's rate."""
    rows = _accepted(decoded, *others).select(*others, *KEYS, "production", _at(F.col("doc"), "agentHealth.edgesSampleRate", "bigint").alias("rate"), F.explode(_list(F.col("doc"), "edges")).alias("r"))
    r = F.col("r")
    return rows.select(
        *others, *KEYS, "production", "rate", _at(r, "fromClass", "string").alias("caller_cls"), _at(r, "fromIdx", "int").alias("caller_idx"), _at(r, "toClass", "string").alias("callee_cls"),
        _at(r, "toIdx", "int").alias("callee_idx"), F.coalesce(_at(r, "count", "bigint"), F.lit(0)).alias("observations"),
    )


def _errors(r: Column, table: Column) -> Column:
    named = F.transform_values(F.map_filter(table, lambda k, v: k.isNotNull()), lambda k, v: F.trim(F.try_variant_get(v, "$", "string")))
    by_number = F.coalesce(F.transform_keys(named, lambda k, v: F.trim(k).cast("int").cast("string")), F.expr("cast(map() as map<string, string>)"))
    by_id = F.transform_keys(_at(r, "errorsByClass", "map<string, bigint>"), lambda k, v: F.trim(k).cast("int").cast("string"))
    return records.resolve_errors(by_id, by_number, _at(r, "errorTypes", "map<string, bigint>"))


def profiles(decoded: DataFrame) -> DataFrame:
    """A timing record a row: calls, errors by name of the same window's table, what is unresolved and unattributed, buckets."""
    rows = _accepted(decoded).select(*KEYS, "production", _map(F.col("doc"), "errorClasses").alias("table"), F.explode(_list(F.col("doc"), "tier2")).alias("r"))
    r = F.col("r")
    number = lambda key: F.coalesce(_at(r, key, "bigint"), F.lit(0))
    own = rows.withColumn("e", _errors(r, F.col("table"))).withColumn("a", records.attribution(number("errors"), F.col("e.named")))
    return own.select(
        *KEYS, "production", _at(r, "class", "string").alias("cls"), _at(r, "idx", "int").alias("idx"), number("calls").alias("calls"), number("errors").alias("errors"), F.col("e.named").alias("named"),
        F.col("e.unresolved").alias("unresolved"), F.col("e.source").alias("source"), "a.attributed", "a.unattributed", F.coalesce(_at(r, "buckets", "array<bigint>"), F.array().cast("array<bigint>")).alias("buckets"),
    )


# ---- counts


#: Every reason for which a document is refused.
REASONS = (
    "malformed_body", "bad_gzip", "payload_too_large", "schema_version_mismatch", "missing_field", "bad_field", "missing_agent_health", "bad_probe_bitset", "unknown_bucket_scheme", "not_production_classified",
    "test_runner_window", "unknown_edge_endpoint", "bad_error_class_id",
)


#: Counters of the health object that are summed, by the name that they get.
HEALTH = {
    "transform_failures": "transformFailures", "ring_dropped": "ringDropped", "sampled_roots": "edgesSampledRoots", "edges_recorded": "edgesRecorded", "edges_dropped": "edgesDropped", "truncated_depth": "edgesTruncatedDepth",
    "truncated_root": "edgesTruncatedRoot", "truncated_distinct": "edgesTruncatedDistinct", "traces_reaped": "edgeTracesReaped",
}


def counters(*names: str) -> list[Column]:
    """What a batch of decoded documents amounts to, as aggregates of one pass: for ``agg``, or for ``observe`` beside a write. All, or those named."""
    v, ok = F.col("doc"), F.col("reject_reason").isNull()
    some = lambda array: F.when(ok, F.coalesce(array, F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    coverage, tier2, calls = some(_list(v, "coverage")), some(_list(v, "tier2")), some(_list(v, "edges"))
    of_test = F.size(F.filter(coverage, _of_test))
    with_mask = F.size(F.filter(coverage, lambda r: ~_of_test(r) & _set(r, "probesInstalled")))
    total = lambda array, key: F.aggregate(array, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(_at(r, key, "bigint"), F.lit(0)))
    health = lambda key: F.coalesce(F.sum(F.when(ok, _at(v, f"agentHealth.{key}", "bigint"))), F.lit(0))
    zero = lambda column: F.coalesce(F.sum(column), F.lit(0))
    summed = {
        "records": F.size(coverage) - of_test, "test_records": of_test, "records_with_mask": with_mask, "records_without_mask": F.size(coverage) - of_test - with_mask,
        "loaded": F.when(ok, F.coalesce(F.size(_list(v, "classesLoaded")), F.lit(0))).otherwise(0), "profile_records": F.size(tier2), "calls": total(tier2, "calls"), "errors": total(tier2, "errors"),
        "records_without_error_types": F.size(F.filter(tier2, lambda r: (F.coalesce(_at(r, "errors", "bigint"), F.lit(0)) > 0) & ~_truthy(r, "errorsByClass") & ~_truthy(r, "errorTypes"))),
        "legacy_error_types": F.size(F.filter(tier2, lambda r: ~_set(r, "errorsByClass") & _truthy(r, "errorTypes"))), "edge_records": F.size(calls), "edge_observations": total(calls, "count"),
    }
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    found: dict[str, Column] = {
        "received": F.count(F.lit(1)), "accepted": count(ok), "rejected": count(~ok), "bytes": zero(F.octet_length("body")),
        **{f"rejected_{reason}": count(F.col("reject_reason") == reason) for reason in REASONS},
        "production": count(ok & F.col("production")), "not_evidence": count(ok & ~F.col("production")), "unclassified": count(ok & (F.col("environment") == "unclassified")),
        "degraded": count(ok & _truthy(v, "agentHealth.degraded")), "clock_degraded": count(ok & _truthy(v, "agentHealth.clockDegraded")),
        "windows_with_edges": count(ok & _kind(v, "edges").isNotNull()), "windows_without_edges": count(ok & _kind(v, "edges").isNull()),
        **{name: zero(column) for name, column in summed.items()}, "mask_missing": zero(F.when(ok, F.col("mask_missing"))), **{name: health(key) for name, key in HEALTH.items()},
    }
    return [column.alias(name) for name, column in found.items() if not names or name in names]


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("documents"))


def reject_log(decoded: DataFrame, received: str, limit: int) -> DataFrame:
    """The latest refused documents, newest first: what was said of each, as far as it can be read."""
    refused = decoded.where("reject_reason is not null").select(received, "reject_reason", _at(F.col("doc"), "buildSha", "string").alias("build"), _at(F.col("doc"), "instanceId", "string").alias("instance"))
    return refused.orderBy(F.desc(received), "build", "instance", "reject_reason").limit(limit)
