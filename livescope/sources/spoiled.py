"""Window documents made of ``events``, whole ones and ones with one fault each, by rule, with what must become of them.

The fault of a window is its day times ten plus the digit of its instance, modulo 45; numbers without a fault are whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import pack_bits
from . import derived as d

FAULTS = 45
#: fault number -> reject reason; numbers that are not here are accepted.
REASONS = {
    **dict.fromkeys((0, 37), "malformed_body"), 1: "schema_version_mismatch", **dict.fromkeys((2, 4), "missing_field"), 8: "missing_agent_health", **dict.fromkeys((13, 15), "test_runner_window"),
    **dict.fromkeys((3, 5, 7, 9, 10, 11, 12, 14, 16, 17, 22, 24, 25, 27, 28, 29, 30, 31), "bad_field"), **dict.fromkeys((18, 19), "bad_probe_bitset"), **dict.fromkeys((20, 21, 26), "bad_error_class_id"),
    23: "unknown_bucket_scheme", 32: "unknown_edge_endpoint",
}


def _case(key: str, default: str, cases: dict[int, str]) -> str:
    """SQL: "key":value with other values for some faults; an empty value leaves the key out."""
    whole = lambda v: "''" if v == "" else f"""concat('"{key}":', {v})"""
    return "CASE f " + " ".join(f"WHEN {n} THEN {whole(v)}" for n, v in cases.items()) + f" ELSE {whole(default)} END"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(build, instance, day, f, source_file, body): a document a window."""
    packed = pack_bits(d.coverage_bits(spark, sf), ["build", "instance", "day", "cls"])
    w = packed.groupBy("build", "instance", "day").agg(F.array_sort(F.collect_list(F.struct("cls", F.base64(F.unhex("octets")).alias("bits")))).alias("cov"))
    f = ((F.dayofmonth("day") * 10 + F.substring("instance", 5, 1).cast("int")) % FAULTS).alias("f")
    rows = w.select("*", f, (F.unix_date("day").cast("long") * 86_400_000).alias("start"))
    record = """concat('{"class":"', r.cls, '","schemaHash":"', CASE WHEN f = 17 AND i = 0 THEN '' ELSE 'h' END, '","probes":', CASE WHEN f = 18 AND i = 0 THEN '"not base64!"' ELSE concat('"', r.bits, '"') END,
      CASE WHEN f = 19 AND i = 0 THEN ',"probesInstalled":"A"' WHEN r.cls = 'app.view' THEN '' WHEN f = 33 THEN ',"probesInstalled":""' ELSE ',"probesInstalled":"/w=="' END,
      CASE WHEN f = 34 AND i = 0 THEN ',"frames":["app.x","org.testng.Run"]' ELSE '' END, '}')"""
    coverage = f"concat('[', array_join(transform(cov, (r, i) -> {record}), ','), ']')"
    loaded = """concat('[', array_join(transform(cov, r -> concat('"', r.cls, '"')), ','), ']')"""
    label = """concat('"', CASE WHEN instance = 'pod-8' THEN 'staging' WHEN instance = 'pod-9' THEN ' ' ELSE ' Production' END, '"')"""
    health = [
        _case("environment", label, {35: "", 36: ""}), _case("edgesSampleRate", "'64'", {11: "'3'", 31: "'0'"}), _case("edgesDropped", "CAST(f AS STRING)", {10: "'-1'", 33: "'null'"}),
        _case("stripMaskMissing", "''", {12: "'\"x\"'", 36: "'true'", 38: "'7'"}).replace("""concat('"stripMaskMissing":', '')""", "''"), _case("classesSkipped", _lit('{"a":1}'), {9: "'[]'"}),
        _case("testRunnerDetected", "'false'", {13: "'true'"}), _case("livenessEvidence", "'true'", {33: "'false'", 34: "'null'"}), "CASE WHEN dayofmonth(day) % 7 = 0 THEN '\"degraded\":true' ELSE '' END", """'"transformFailures":1'""",
    ]
    agent = f"concat('{{', array_join(filter(array({', '.join(health)}), x -> x <> ''), ','), '}}')"
    tier2 = """concat('[{"class":"', cov[0].cls, '","idx":0,"calls":10,"errors":5', CASE f WHEN 26 THEN ',"errorsByClass":{"a":1}' WHEN 27 THEN ',"errorsByClass":{"1":-1}' WHEN 39 THEN ',"errorTypes":{"old.E":4}' WHEN 40 THEN ',"errorsByClass":{}'
      ELSE ',"errorsByClass":{" 1":2,"9":1,"2":1}' END, CASE f WHEN 23 THEN ',"bucketScheme":"linear"' WHEN 24 THEN ',"p99":7' WHEN 25 THEN ',"percentiles":{}' ELSE ',"bucketScheme":"loglinear-16-v1"' END, ',"buckets":[0,3,2]}]')"""
    edge = """concat('[{"fromClass":"', cov[0].cls, '","fromIdx":0,"toClass":"', cov[0].cls, '","toIdx":', CASE f WHEN 29 THEN '-1' WHEN 32 THEN '99' ELSE '1' END, CASE f WHEN 28 THEN ',"ratio":0.5' ELSE '' END,
      ',"count":', CASE f WHEN 30 THEN '"3"' ELSE CAST(f AS STRING) END, '}]')"""
    parts = [
        _case("schemaVersion", "'2'", {1: "'9'", 2: "", 3: "'\"2\"'"}), _case("buildSha", "concat('\"', build, '\"')", {4: ""}), _case("artifact", "'\"app\"'", {6: "'\" \"'"}), _case("instanceId", "concat('\"', instance, '\"')", {5: "'\"\"'"}),
        _case("windowStartMs", "start", {}).replace("CASE f  ELSE", "CASE WHEN true THEN"), _case("windowEndMs", "start + 86400000", {7: "start - 1"}), _case("agentHealth", agent, {8: ""}),
        _case("classesLoaded", loaded, {14: "'\"app\"'", 15: "'[\"app.x\",\"org.junit.Run\"]'"}), _case("coverage", coverage, {16: "'{\"a\":1}'"}),
        _case("errorClasses", _lit('{"1":" java.io.E ","2":"app.F"}'), {20: _lit('{"x":"E"}'), 21: _lit('{"256":"E"}'), 22: _lit('{"1":" "}'), 41: "''"}).replace("""concat('"errorClasses":', '')""", "''"), _case("tier2", tier2, {}).replace("CASE f  ELSE", "CASE WHEN true THEN"),
        f"CASE WHEN dayofmonth(day) % 3 = 0 AND f NOT IN (28, 29, 30, 31, 32) THEN '' WHEN dayofmonth(day) % 3 = 1 AND f NOT IN (28, 29, 30, 31, 32) THEN '\"edges\":[]' ELSE concat('\"edges\":', {edge}) END",
        """CASE f WHEN 35 THEN '"jvmClassification":{"env":"","environment":"prod"}' WHEN 36 THEN '"env":"PROD"' ELSE '' END""",
    ]
    whole = f"concat('{{\n', array_join(filter(array({', '.join(parts)}), x -> x <> ''), ',\n '), '}}')"
    body = f"CASE f WHEN 0 THEN substring({whole}, 1, 40) WHEN 37 THEN '[1]' ELSE {whole} END"
    name = F.concat_ws("/", "build", "instance", F.col("day").cast("string"))
    return rows.select("build", "instance", "day", "f", name.alias("source_file"), F.expr(body).alias("body"))


def known_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Methods that the inventory of two of three builds knows."""
    e = d.call_events(spark, sf).where("build <> 'b2'").select("build", "cls").distinct()
    return e.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(8))))


_REASON = "CASE " + " ".join(f"WHEN f IN ({', '.join(str(n) for n in sorted(REASONS) if REASONS[n] == r)}) THEN '{r}'" for r in dict.fromkeys(REASONS.values()) if r != "unknown_edge_endpoint")
SPOILED = f"""{d.COVERAGE}, sp AS (SELECT build, instance, day, (day(day) * 10 + CAST(substr(instance, 5, 1) AS INTEGER)) % {FAULTS} AS f FROM wi),
sd AS (SELECT *, {_REASON} WHEN f = 32 AND build <> 'b2' THEN 'unknown_edge_endpoint' END AS reason, f NOT IN (33) AND (instance NOT IN ('pod-8', 'pod-9') OR f IN (35, 36)) AS production,
  CASE WHEN f IN (28, 29, 30, 31, 32) OR day(day) % 3 = 2 THEN 1 WHEN day(day) % 3 = 1 THEN 0 END AS n_edges FROM sp),
rc AS (SELECT build, instance, day, cls, row_number() OVER (PARTITION BY build, instance, day ORDER BY cls) - 1 AS i FROM (SELECT DISTINCT build, instance, day, cls FROM cb)),
rr AS (SELECT sd.*, cls, i, f = 34 AND i = 0 AS of_test, cls <> 'app.view' OR (f = 19 AND i = 0) AS masked FROM rc JOIN sd USING (build, instance, day) WHERE reason IS NULL)"""
