"""Telemetry tables derived from the business tables, so that every operator has rows that grow with the input.

Each rule stands once for Spark and once as a DuckDB common table expression; both use
integer and string arithmetic only, so they agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        e.ts.cast("timestamp_ntz").alias("ts"),
        F.to_date("ts").alias("day"),
        F.concat(F.lit("b"), F.col("user_id") % 3).alias("build"),
        F.concat(F.lit("pod-"), F.col("user_id") % 10).alias("instance"),
        F.concat(F.lit("app."), "event_type").alias("cls"),
        (F.get_json_object("props", "$.k").cast("int") % 8).alias("idx"),
        F.round(F.col("value") * 1000000).cast("long").alias("nanos"),
        (F.col("event_id") % 4 != 0).alias("timed"),
        (F.col("event_id") % 17 == 0).alias("err"),
        F.concat(F.lit("E"), F.col("event_id") % 5).alias("err_name"),
    )


CALL_EVENTS = """ce AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day, 'b' || (user_id % 3) AS build, 'pod-' || (user_id % 10) AS instance,
    'app.' || event_type AS cls, CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS idx,
    CAST(round(value * 1000000) AS BIGINT) AS nanos, event_id % 4 <> 0 AS timed, event_id % 17 = 0 AS err, 'E' || (event_id % 5) AS err_name
  FROM events)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation window a build, instance and day."""
    w = call_events(spark, sf_dir).select("build", "instance", "day").distinct()
    environment = F.when(F.col("instance") == "pod-8", "staging").when(F.col("instance") != "pod-9", "production")
    return w.withColumns({"end_day": F.date_add("day", 1), "degraded": F.dayofmonth("day") % 7 == 0, "environment": environment})


WINDOWS = f"""{CALL_EVENTS}, wi AS (
  SELECT build, instance, day, CAST(day + 1 AS DATE) AS end_day, day(day) % 7 = 0 AS degraded,
    CASE WHEN instance = 'pod-8' THEN 'staging' WHEN instance <> 'pod-9' THEN 'production' END AS environment
  FROM (SELECT DISTINCT build, instance, day FROM ce))"""


def coverage_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_events(spark, sf_dir).select("build", "instance", "day", "cls", "idx").distinct()


COVERAGE = f"{WINDOWS}, cb AS (SELECT DISTINCT build, instance, day, cls, idx FROM ce)"


def install_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The installed probes that each window's record of a class reports; app.view reports no mask."""
    records = call_events(spark, sf_dir).where("cls <> 'app.view'").select("build", "instance", "day", "cls").distinct()
    return records.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(8)))).where((F.col("idx") + F.length("cls")) % 5 != 0)


MASKS = f"""{COVERAGE}, ib AS (
  SELECT build, instance, day, cls, CAST(idx AS INTEGER) AS idx FROM (SELECT DISTINCT build, instance, day, cls FROM ce WHERE cls <> 'app.view'), range(9) r(idx)
  WHERE (idx + length(cls)) % 5 <> 0)"""


def window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    keys = [
        F.col("l_linestatus").alias("build"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("day"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("caller_cls"),
        F.col("l_suppkey").alias("caller_idx"),
        F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("callee_cls"),
        F.col("l_partkey").alias("callee_idx"),
        F.when(F.col("l_returnflag") == "N", 64).otherwise(1024).cast("long").alias("rate"),
    ]
    return li.groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("observations"))


EDGES = """we AS (
  SELECT l_linestatus AS build, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS day, 's' || (l_suppkey % 20) AS caller_cls, l_suppkey AS caller_idx,
    'p' || (l_partkey % 50) AS callee_cls, l_partkey AS callee_idx, CAST(CASE WHEN l_returnflag = 'N' THEN 64 ELSE 1024 END AS BIGINT) AS rate,
    CAST(sum(l_quantity) AS BIGINT) AS observations
  FROM lineitem GROUP BY ALL)"""


def instance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_edges with the instance that saw them."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_linestatus").alias("build"), F.concat(F.lit("pod-"), F.col("l_linenumber") % 3).alias("instance"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("caller_cls"), F.col("l_suppkey").alias("caller_idx"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("callee_cls"), F.col("l_partkey").alias("callee_idx"),
    ).agg(F.sum("l_quantity").cast("long").alias("observations"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.concat(F.lit("p."), "p_brand", F.lit("."), "p_type").alias("cls"),
        F.when(F.col("p_partkey") % 50 == 7, "<clinit>").otherwise(F.concat(F.lit("m"), F.col("p_partkey") % 500)).alias("name"),
        F.concat(F.lit("("), "p_partkey", F.lit(")V")).alias("desc"),
        (F.col("p_size") % 11 == 0).alias("is_public_api"),
        (F.col("p_brand") == "Brand#1").alias("is_test"),
        (F.col("p_size") % 5 != 0).alias("observable"),
        (F.col("p_size") % 13 == 0).alias("short_circuitable"),
        F.col("p_brand").alias("artifact"),
    )


METHODS = """me AS (
  SELECT p_partkey, 'p.' || p_brand || '.' || p_type AS cls, CASE WHEN p_partkey % 50 = 7 THEN '<clinit>' ELSE 'm' || (p_partkey % 500) END AS name, '(' || p_partkey || ')V' AS "desc", p_size % 11 = 0 AS is_public_api,
    p_brand = 'Brand#1' AS is_test, p_size % 5 <> 0 AS observable, p_size % 13 = 0 AS short_circuitable, p_brand AS artifact FROM part)"""


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").where("p_partkey % 97 = 0")
    return p.select(F.col("p_partkey").alias("ref"), F.when(F.col("p_partkey") % 194 == 0, "test").otherwise(F.col("p_type")).alias("kind"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day for every order; builds are fine enough to leave days without any."""
    day = F.to_date("o_orderdate")
    build = F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 40)
    return read(spark, sf_dir, "orders").select(build.alias("build"), day.alias("start"), F.date_add(day, 1).alias("stop"))


INTERVALS = """iv AS (
  SELECT o_orderpriority || '/' || (o_custkey % 40) AS build, CAST(o_orderdate AS DATE) AS start, CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) AS stop FROM orders)"""


def window_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(build, instance, day, body): a JSON document a window, some spoiled by rule."""
    from ..operators.coverage import pack_bits

    bits = coverage_bits(spark, sf_dir)
    packed = pack_bits(bits, ["build", "instance", "day", "cls"])
    fault = F.dayofmonth("day") * 10 + F.substring("instance", 5, 1).cast("int")
    probes = F.when(fault % 37 == 5, "not base64!").otherwise(F.base64(F.unhex("octets")))
    windows_ = packed.groupBy("build", "instance", "day").agg(
        F.array_sort(F.collect_list(F.struct(F.col("cls").alias("class"), F.lit("h").alias("schemaHash"), probes.alias("probes")))).alias("coverage")
    )
    start = F.unix_date("day").cast("long") * 86_400_000
    loaded = F.when(fault % 29 == 4, F.array(F.lit("org.junit.Runner"))).otherwise(F.transform("coverage", lambda r: r["class"]))
    document = F.struct(
        F.when(fault % 11 == 3, 9).otherwise(2).alias("schemaVersion"),
        F.when(fault % 13 != 6, F.col("build")).alias("buildSha"),
        F.lit("app").alias("artifact"),
        F.when(fault % 17 == 2, "").otherwise(F.col("instance")).alias("instanceId"),
        start.alias("windowStartMs"),
        F.when(fault % 19 == 8, start - 1).otherwise(start + 86_400_000).alias("windowEndMs"),
        F.when(fault % 23 != 7, F.struct(F.lit(0).alias("transformFailures"))).alias("agentHealth"),
        loaded.alias("classesLoaded"),
        "coverage",
    )
    body = F.when(fault % 7 == 1, F.substring(F.to_json(document), 1, 40)).otherwise(F.to_json(document))
    return windows_.select("build", "instance", "day", body.alias("body"))


DOCUMENTS = f"""{COVERAGE}, fx AS (SELECT build, instance, day, day(day) * 10 + CAST(substr(instance, 5, 1) AS INTEGER) AS f FROM wi),
dr AS (SELECT build, instance, day, CASE WHEN f % 7 = 1 THEN 'malformed_body' WHEN f % 11 = 3 THEN 'schema_version_mismatch' WHEN f % 13 = 6 THEN 'missing_field'
  WHEN f % 17 = 2 OR f % 19 = 8 THEN 'bad_field' WHEN f % 23 = 7 THEN 'missing_agent_health' WHEN f % 29 = 4 THEN 'test_runner_window' WHEN f % 37 = 5 THEN 'bad_probe_bitset' END AS reject_reason FROM fx)"""
