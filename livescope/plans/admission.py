"""Documents from files and streams through the one chain of checks, and the tables and counts that come of them, each with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import admission, coverage, graph
from ..sources import spoiled, windows
from ..sources import derived as d
from ..streaming import ingest
from .registry import query

_D = f"WITH {spoiled.SPOILED}"


def _decoded(spark, sf, **options):
    """Every document with its fault number, through the chain and the look-up of edge endpoints."""
    documents = graph.kept(spoiled.documents(spark, sf))  # as they would come, from storage
    return windows.check_endpoints(windows.decode_windows(documents, **options), spoiled.known_methods(spark, sf))


def _of_faults(*faults):
    """The reasons that documents with these faults were given, besides those that were accepted."""

    def run(spark, sf):
        return _decoded(spark, sf).where(F.col("f").isin(*faults)).groupBy("f", F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("documents"))

    return run


def _faults_sql(*faults):
    return f"{_D} SELECT f, coalesce(reason, 'accepted') AS reason, count(*) AS documents FROM sd WHERE f IN ({', '.join(map(str, faults))}) GROUP BY ALL"


for _name, _faults in {
    "B3_documents": (7, 42), "B4_documents": (8, 9, 10, 12, 36, 38, 42), "B5_documents": (11, 31, 42), "B10_documents": (13, 15, 42), "B12_documents": (18, 19, 33, 42), "B13": (23, 24, 25, 42), "B14": (20, 21, 22, 26, 27, 41),
    "B17": (28, 29, 30, 42), "B18": (32, 43), "B1_documents": (0, 1, 2, 3, 4, 5, 6, 14, 16, 17, 37),
}.items():
    query(_name, _faults_sql(*_faults))(_of_faults(*_faults))


@query(
    "B6_documents",
    f"""{_D} SELECT build, instance, day, CASE WHEN f = 35 THEN 'prod' WHEN f = 36 THEN 'prod' WHEN instance = 'pod-8' THEN 'staging' WHEN instance = 'pod-9' THEN 'unclassified' ELSE 'production' END AS environment,
  production FROM sd WHERE reason IS NULL""",
)
def b6_documents(spark, sf):
    return _decoded(spark, sf).where("reject_reason IS NULL").select("build", "instance", "day", "environment", "production")


@query("B9", f"{_D} SELECT count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NULL AND (production OR (instance = 'pod-8' AND f <> 33))) AS production FROM sd")
def b9(spark, sf):
    """With environments allowed by a list as users write it."""
    decoded = _decoded(spark, sf, allowed=admission.parse_environments(" staging,, QA ,"))
    return decoded.where("reject_reason IS NULL").agg(F.count("*").alias("accepted"), F.count_if("production").alias("production"))


_ORDER = "CASE WHEN reason IN ('bad_error_class_id', 'unknown_bucket_scheme', 'bad_probe_bitset', 'test_runner_window') OR f IN (14, 16, 17, 22, 24, 25, 27, 28, 29, 30, 31, 32) THEN NOT production ELSE reason IS NULL AND NOT production END"


@query(
    "B8",
    f"""{_D}, x AS (SELECT *, {_ORDER} AS first FROM sd) SELECT build, count(*) FILTER (first) AS refused, count(*) FILTER (reason IS NULL AND production) AS accepted FROM x GROUP BY build""",
)
def b8(spark, sf):
    """Strict mode: refused where the default only marks, before a document's records are looked at."""
    return _decoded(spark, sf, strict=True).groupBy("build").agg(F.count_if(F.col("reject_reason").eqNullSafe(F.lit("not_production_classified"))).alias("refused"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"))


@query("B11", f"{_D} SELECT build, count(*) FILTER (of_test) AS dropped, count(*) FILTER (NOT of_test) AS kept FROM rr GROUP BY build")
def b11(spark, sf):
    decoded = _decoded(spark, sf)
    return decoded.groupBy("build").agg(*windows.counters("test_records", "records")).select("build", F.col("test_records").alias("dropped"), F.col("records").alias("kept"))


_NAMED = """SELECT sd.*, CASE f WHEN 39 THEN 4 WHEN 40 THEN 0 WHEN 41 THEN 0 ELSE 3 END AS named, CASE f WHEN 39 THEN 0 WHEN 40 THEN 0 WHEN 41 THEN 4 ELSE 1 END AS unresolved,
  CASE f WHEN 39 THEN 'legacy_names' WHEN 40 THEN 'unavailable' ELSE 'errors_by_class' END AS source FROM sd WHERE reason IS NULL"""


@query("B15", f"{_D}, x AS ({_NAMED}) SELECT build, instance, day, source, CAST(unresolved AS BIGINT) AS unresolved, CAST(CASE WHEN source = 'errors_by_class' AND named > 0 THEN 2 ELSE 0 END AS BIGINT) AS io_errors FROM x")
def b15(spark, sf):
    day = F.date_from_unix_date((F.col("start_ms") / 86_400_000).cast("int"))
    io = F.coalesce(F.try_element_at("named", F.lit("java.io.E")), F.lit(0).cast("long"))
    return windows.profiles(_decoded(spark, sf)).select("build", "instance", day.alias("day"), "source", "unresolved", io.alias("io_errors"))


@query("B16", f"{_D}, x AS ({_NAMED}) SELECT build, CAST(sum(named) AS BIGINT) AS attributed, CAST(sum(5 - named) AS BIGINT) AS unattributed, count(*) AS records FROM x GROUP BY build")
def b16(spark, sf):
    return windows.profiles(_decoded(spark, sf)).groupBy("build").agg(F.sum("attributed").alias("attributed"), F.sum("unattributed").alias("unattributed"), F.count("*").alias("records"))


@query("B21", f"{_D}, x AS (SELECT *, row_number() OVER (ORDER BY day DESC, CASE WHEN f IN (0, 37, 4) THEN NULL ELSE build END NULLS FIRST, CASE WHEN f IN (0, 37) THEN NULL WHEN f = 5 THEN '' ELSE instance END NULLS FIRST, reason) AS n FROM sd WHERE reason IS NOT NULL) SELECT day, reason AS reject_reason, count(*) AS documents FROM x WHERE n <= 40 GROUP BY ALL")
def b21(spark, sf):
    """The 40 latest refused documents, by day and reason."""
    return windows.reject_log(_decoded(spark, sf), "day", 40).groupBy("day", "reject_reason").agg(F.count("*").alias("documents"))


@query("B21_counts", f"{_D} SELECT reason AS reject_reason, count(*) AS documents FROM sd WHERE reason IS NOT NULL GROUP BY ALL")
def b21_counts(spark, sf):
    return windows.rejects(_decoded(spark, sf))


_COUNTS = f"""SELECT sd.build, count(*) AS received, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason = 'bad_field') AS rejected_bad_field,
  count(*) FILTER (reason = 'unknown_edge_endpoint') AS rejected_unknown_edge_endpoint, count(*) FILTER (reason IS NULL AND production) AS production, count(*) FILTER (reason IS NULL AND NOT production) AS not_evidence,
  count(*) FILTER (reason IS NULL AND instance = 'pod-9' AND f NOT IN (35, 36)) AS unclassified, count(*) FILTER (reason IS NULL AND day(day) % 7 = 0) AS degraded,
  count(*) FILTER (reason IS NULL AND n_edges IS NOT NULL) AS windows_with_edges, count(*) FILTER (reason IS NULL AND n_edges IS NULL) AS windows_without_edges, coalesce(CAST(sum(n_edges) FILTER (reason IS NULL) AS BIGINT), 0) AS edge_records,
  coalesce(CAST(sum(n_edges * f) FILTER (reason IS NULL) AS BIGINT), 0) AS edge_observations, count(*) FILTER (reason IS NULL) AS profile_records, CAST(count(*) FILTER (reason IS NULL) * 10 AS BIGINT) AS calls, CAST(count(*) FILTER (reason IS NULL) * 5 AS BIGINT) AS errors,
  count(*) FILTER (reason IS NULL AND f = 40) AS records_without_error_types, count(*) FILTER (reason IS NULL AND f = 39) AS legacy_error_types, coalesce(CAST(sum(CASE f WHEN 36 THEN 1 WHEN 38 THEN 7 ELSE 0 END) FILTER (reason IS NULL) AS BIGINT), 0) AS mask_missing,
  count(*) FILTER (reason IS NULL) AS transform_failures, coalesce(CAST(sum(CASE WHEN f = 33 THEN 0 ELSE f END) FILTER (reason IS NULL) AS BIGINT), 0) AS edges_dropped FROM sd GROUP BY sd.build"""
_PER_RECORD = """SELECT build, count(*) FILTER (NOT of_test) AS records, count(*) FILTER (of_test) AS test_records, count(*) FILTER (NOT of_test AND masked) AS records_with_mask, count(*) FILTER (NOT of_test AND NOT masked) AS records_without_mask, count(*) AS loaded FROM rr GROUP BY build"""
_KEPT = (
    "received", "accepted", "rejected", "rejected_bad_field", "rejected_unknown_edge_endpoint", "production", "not_evidence", "unclassified", "degraded", "windows_with_edges", "windows_without_edges", "edge_records", "edge_observations",
    "profile_records", "calls", "errors", "records_without_error_types", "legacy_error_types", "mask_missing", "transform_failures", "edges_dropped", "records", "test_records", "records_with_mask", "records_without_mask", "loaded",
)


@query("B22", f"{_D}, a AS ({_COUNTS}), b AS ({_PER_RECORD}) SELECT * FROM a JOIN b USING (build)")
def b22(spark, sf):
    return _decoded(spark, sf).groupBy("build").agg(*windows.counters()).select("build", *_KEPT)


_BITS = f"{_D} SELECT cb.build, cb.instance, cb.cls, cb.idx, count(*) AS windows FROM cb JOIN sd USING (build, instance, day) WHERE (reason IS NULL OR reason = 'unknown_edge_endpoint') AND (f <> 34 OR cls <> (SELECT min(cls) FROM rc WHERE rc.build = cb.build AND rc.instance = cb.instance AND rc.day = cb.day)) GROUP BY ALL"


def _bits(records):
    return coverage.explode_bits(records.select("build", "instance", "cls", "probes")).groupBy("build", "instance", "cls", "idx").agg(F.count("*").alias("windows"))


def _files(spark, sf, folder):
    """Each document as a file: its text written as one partition's only line group, every third one packed."""
    docs = spoiled.documents(spark, sf).select(F.translate("source_file", "/", "-").alias("name"), F.translate("body", "\n", " ").alias("body"))
    for kind, rest in (("none", "<> 0"), ("gzip", "= 0")):
        docs.where(f"crc32(name) % 3 {rest}").repartition("name").write.partitionBy("name").option("compression", kind).mode("append").text(folder)


@query("A1", _BITS)
def a1(spark, sf):
    """One document a file, plain and packed."""
    path = f"{graph.scratch(spark)}/documents-{uuid.uuid4().hex}"
    _files(spark, sf, path)
    return _bits(windows.accepted_coverage(windows.decode_windows(windows.read_windows(spark, path))))


@query("A2", _BITS)
def a2(spark, sf):
    """The same files as a stream, in batches."""
    path = f"{graph.scratch(spark)}/stream-{uuid.uuid4().hex}"
    _files(spark, sf, f"{path}/in")
    ingest.append_windows(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint")
    return _bits(spark.read.parquet(f"{path}/out/coverage"))


@query("C10_documents", f"{_D} SELECT build, cls, count(*) FILTER (masked AND f <> 33) AS full_masks, count(*) FILTER (masked AND f = 33) AS empty_masks, count(*) FILTER (NOT masked) AS without FROM rr WHERE NOT of_test GROUP BY ALL")
def c10_documents(spark, sf):
    """A mask of no bits is a mask; a record without one says nothing."""
    r = windows.coverage_records(_decoded(spark, sf))
    return r.groupBy("build", "cls").agg(
        F.count_if(F.octet_length("installed") > 0).alias("full_masks"), F.count_if(F.octet_length("installed") == 0).alias("empty_masks"), F.count_if(F.col("installed").isNull()).alias("without")
    )


@query(
    "C7_stream",
    f"""{_D}, r AS (SELECT rr.build, rr.instance, rr.day, rr.cls, idx FROM rr JOIN cb USING (build, instance, day, cls) WHERE NOT of_test AND rr.production UNION ALL
  SELECT cb.build, cb.instance, cb.day, cb.cls, idx FROM cb JOIN sd USING (build, instance, day) WHERE reason = 'unknown_edge_endpoint' AND production),
x AS (SELECT *, row_number() OVER (PARTITION BY build, cls, idx ORDER BY day, instance) = 1 AS new FROM r) SELECT build, cls, instance, day, count(*) FILTER (new) AS new_bits FROM x GROUP BY ALL""",
)
def c7_stream(spark, sf):
    """New bits of each record, from a stream of documents with state."""
    path = f"{graph.scratch(spark)}/guarded-{uuid.uuid4().hex}"
    _files(spark, sf, f"{path}/in")
    ingest.append_guarded(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint")
    day = F.date_from_unix_date((F.col("start_ms") / 86_400_000).cast("int"))
    return spark.read.parquet(f"{path}/out").where("accepted").select("build", "cls", "instance", day.alias("day"), F.col("new_bits").cast("long").alias("new_bits"))
