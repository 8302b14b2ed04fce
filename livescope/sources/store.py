"""An evidence store for the inventory of ``part``: windows, coverage, masks, loads and sampled edges from ``lineitem``,
calls and entry points between parts, proposals, and feedback from ``orders``. Builds are brands.

Each rule stands once for Spark and once as a DuckDB common table expression, in integer and string arithmetic.
Brands differ by rule in what their windows are good for, so that every clause of a verdict has methods to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import derived as d

TODAY = "2024-01-05"


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Methods with ref, build, number of the brand, probe index, members of the class and declared eligibility."""
    of_class = W.partitionBy("cls")
    k = F.col("p_partkey")
    return d.methods(spark, sf).withColumns({
        "ref": k, "build": F.col("artifact"), "bn": F.substring("artifact", 7, 10).cast("int"),
        "idx": F.row_number().over(of_class.orderBy("name", "desc")) - 1, "members": F.count("*").over(of_class).cast("int"),
        "eligibility": F.when(~F.col("observable"), "NOT_DYNAMICALLY_OBSERVABLE").when(k % 31 == 0, "DE_INSTRUMENTED").otherwise("OBSERVABLE"),
    })


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """What lineitem says of each method in a window: a month of an instance."""
    li = d.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    at = inventory(spark, sf).select("p_partkey", "build", "bn", "cls", "idx", "members")
    seen = li.join(at, F.col("l_partkey") == F.col("p_partkey")).withColumns({
        "instance": F.concat(F.lit("pod-"), F.col("l_suppkey") % 4), "day": F.trunc(F.to_date("l_shipdate"), "month"),
    })
    quarter_ends = (F.col("bn") % 12 == 5) & (F.month("day") % 3 == 0)
    other_years = (F.col("bn") % 12 == 6) & (F.year("day") != 1996)
    return seen.where(~quarter_ends & ~other_years)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    w = calls(spark, sf).select("build", "bn", "instance", "day").distinct()
    environment = F.when(F.col("bn") % 12 == 3, F.lit(None)).when(F.col("instance") == "pod-3", "staging").otherwise("production")
    return w.select(
        "build", "instance", "day", F.add_months("day", 1).alias("end_day"), environment.cast("string").alias("environment"),
        ((F.col("bn") % 12 == 4) | ((F.col("instance") == "pod-1") & (F.month("day") % 5 == 0))).alias("degraded"),
        ((F.col("instance") == "pod-2") & (F.month("day") % 4 == 1)).alias("tainted"),
    )


def coverage_bits(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).where("l_quantity >= 49 AND l_returnflag = 'R'").select("build", "instance", "day", "cls", "idx").distinct()


def loads(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).where("NOT (cls LIKE '%.PROMO' AND bn % 5 = 2)").select("build", "instance", "day", "cls").distinct()


def mask_records(spark: SparkSession, sf: str) -> DataFrame:
    """Class records that report a mask at all, with the number of probes."""
    return calls(spark, sf).where("instance = 'pod-0' AND month(day) = 1 AND NOT (cls LIKE '%.LARGE' AND bn % 4 = 1)").select("build", "instance", "day", "cls", "members").distinct()


def mask_bits(spark: SparkSession, sf: str) -> DataFrame:
    each = mask_records(spark, sf).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("members") - 1)))
    return each.where((F.col("idx") + F.length("cls")) % 7 != 0).drop("members")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled calls between methods of a class; some brands' agents report none."""
    e = calls(spark, sf).where("l_discount >= 0.1 AND l_quantity < 5 AND bn % 8 <> 7")
    return e.groupBy(
        "build", "instance", "day", F.col("cls").alias("caller_cls"), ((F.col("idx") + 1 + F.col("l_suppkey") % 3) % F.col("members")).cast("int").alias("caller_idx"),
        F.col("cls").alias("callee_cls"), F.col("idx").alias("callee_idx"), F.when(F.col("l_returnflag") == "N", 64).otherwise(1024).cast("long").alias("rate"),
    ).agg(F.sum("l_quantity").cast("long").alias("observations"))


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, resolution, semantics) from every part: within tens of parts, a few between them; some parts are called by nothing."""
    p = d.read(spark, sf, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    near = F.array(k - k % 10 + (k % 10) * 3 % 7, k - k % 10 + (k % 10) * 5 % 7)
    far = F.array(k - k % 1000 + (k % 1000 * 13 + 1) % 1000)
    resolution = F.when(F.col("p_size") % 10 == 0, "unresolved").when(F.col("p_size") % 10 <= 4, "exact").otherwise("cha")
    semantics = F.when(F.col("p_size") % 7 == 0, F.when(k % 2 == 0, "noop").otherwise("no-op")).otherwise("blocking")
    dst = F.explode(F.concat(near, F.when(k % 8 == 1, far).otherwise(F.array().cast("array<bigint>"))))
    return p.select(k.alias("src"), dst.alias("dst"), resolution.alias("resolution"), semantics.alias("semantics"))


def thinned_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """call_edges without those from every seventeenth part."""
    return call_edges(spark, sf).where("src % 17 <> 5")


def components(spark: SparkSession, sf: str) -> DataFrame:
    """(component, ref): library and test code that call one another."""
    k = F.col("p_partkey")
    return d.read(spark, sf, "part").where("p_partkey % 50 BETWEEN 11 AND 14").select((k - k % 50).alias("component"), k.alias("ref"))


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger before this run."""
    k = F.col("p_partkey")
    active = k % 2 == 0
    return d.read(spark, sf, "part").where("p_partkey % 9 = 4").select(
        k.alias("ref"), F.col("p_brand").alias("artifact"), active.alias("active"), F.date_add(F.to_date(F.lit("2024-01-01")), (k % 30).cast("int")).alias("first_proposed"),
        F.when(~active, F.lit(None).cast("date")).alias("revoked_at"), F.when(~active, "older").alias("reason"),
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """(rule_key, kind): a report for every order, and what reviewers made of it."""
    c = F.col("o_custkey") % 8
    kinds = F.array(*map(F.lit, ("PROMO", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD")))
    key = F.when(c == 6, "entrypoint:none").when(c == 7, "eligibility:OBSERVABLE").otherwise(F.concat(F.lit("entrypoint:"), F.get(kinds, c.cast("int"))))
    bad = F.when(c == 0, F.col("o_orderstatus") == "O").otherwise(F.col("o_orderkey") % 20 == 0)
    said = F.array(F.lit("report"), F.when(bad, "not_useful").otherwise(F.when(F.col("o_orderstatus") != "P", "actioned")))
    return d.read(spark, sf, "orders").select(key.alias("rule_key"), F.explode(F.filter(said, lambda k: k.isNotNull())).alias("kind"))


STORE = f"""{d.METHODS}, im AS (SELECT me.*, p_partkey AS ref, artifact AS build, CAST(substr(artifact, 7) AS INTEGER) AS bn, CAST(row_number() OVER (PARTITION BY cls ORDER BY name, "desc") - 1 AS INTEGER) AS idx,
  count(*) OVER (PARTITION BY cls) AS members, CASE WHEN NOT observable THEN 'NOT_DYNAMICALLY_OBSERVABLE' WHEN p_partkey % 31 = 0 THEN 'DE_INSTRUMENTED' ELSE 'OBSERVABLE' END AS eligibility FROM me),
sa AS (SELECT im.build, bn, cls, idx, members, 'pod-' || (l_suppkey % 4) AS instance, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_quantity, l_discount, l_returnflag, l_suppkey
  FROM lineitem JOIN im ON l_partkey = p_partkey WHERE NOT (bn % 12 = 5 AND month(l_shipdate) IN (3, 6, 9, 12)) AND NOT (bn % 12 = 6 AND year(l_shipdate) <> 1996)),
sw AS (SELECT build, instance, day, CAST(day + INTERVAL 1 MONTH AS DATE) AS end_day, CASE WHEN bn % 12 = 3 THEN NULL WHEN instance = 'pod-3' THEN 'staging' ELSE 'production' END AS environment,
  bn % 12 = 4 OR (instance = 'pod-1' AND month(day) IN (5, 10)) AS degraded, instance = 'pod-2' AND month(day) IN (1, 5, 9) AS tainted FROM (SELECT DISTINCT build, bn, instance, day FROM sa)),
lw AS (SELECT *, NOT degraded AS death FROM sw WHERE environment = 'production' AND NOT tainted),
sc AS (SELECT DISTINCT build, instance, day, cls, idx FROM sa WHERE l_quantity >= 49 AND l_returnflag = 'R'),
sl AS (SELECT DISTINCT build, instance, day, cls FROM sa WHERE NOT (ends_with(cls, '.PROMO') AND bn % 5 = 2)),
mo AS (SELECT DISTINCT build, instance, day, cls, members FROM sa WHERE instance = 'pod-0' AND month(day) = 1 AND NOT (ends_with(cls, '.LARGE') AND bn % 4 = 1)),
sm AS (SELECT build, instance, day, cls, CAST(i AS INTEGER) AS idx FROM (SELECT *, unnest(range(members)) AS i FROM mo) WHERE (i + length(cls)) % 7 <> 0),
se AS (SELECT build, instance, day, cls AS caller_cls, CAST((idx + 1 + l_suppkey % 3) % members AS INTEGER) AS caller_idx, cls AS callee_cls, idx AS callee_idx,
  CAST(CASE WHEN l_returnflag = 'N' THEN 64 ELSE 1024 END AS BIGINT) AS rate, CAST(sum(l_quantity) AS BIGINT) AS observations FROM sa WHERE l_discount >= 0.1 AND l_quantity < 5 AND bn % 8 <> 7 GROUP BY ALL)"""

WHOLE_GRAPH = """cg AS (SELECT p_partkey AS src, unnest(list_concat([p_partkey - p_partkey % 10 + (p_partkey % 10) * 3 % 7, p_partkey - p_partkey % 10 + (p_partkey % 10) * 5 % 7],
    CASE WHEN p_partkey % 8 = 1 THEN [p_partkey - p_partkey % 1000 + (p_partkey % 1000 * 13 + 1) % 1000] ELSE [] END)) AS dst,
  CASE WHEN p_size % 10 = 0 THEN 'unresolved' WHEN p_size % 10 <= 4 THEN 'exact' ELSE 'cha' END AS resolution, CASE WHEN p_size % 7 <> 0 THEN 'blocking' WHEN p_partkey % 2 = 0 THEN 'noop' ELSE 'no-op' END AS semantics
  FROM part),
sk AS (SELECT p_partkey - p_partkey % 50 AS component, p_partkey AS ref FROM part WHERE p_partkey % 50 BETWEEN 11 AND 14),
ep AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 194 = 0 THEN 'test' ELSE p_type END AS kind FROM part WHERE p_partkey % 97 = 0)"""
GRAPH = WHOLE_GRAPH.replace("  FROM part)", "  FROM part WHERE p_partkey % 17 <> 5)")

LEDGER = f"""pv AS (SELECT p_partkey AS ref, p_brand AS artifact, p_partkey % 2 = 0 AS active, CAST(DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS DATE) AS first_proposed FROM part WHERE p_partkey % 9 = 4),
op AS (SELECT artifact, count(*) AS opened FROM pv WHERE first_proposed = DATE '{TODAY}' GROUP BY ALL)"""

FEEDBACK = """fo AS (SELECT CASE o_custkey % 8 WHEN 6 THEN 'entrypoint:none' WHEN 7 THEN 'eligibility:OBSERVABLE' ELSE 'entrypoint:' || ['PROMO', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'STANDARD'][o_custkey % 8 + 1] END AS rule_key,
  CASE WHEN o_custkey % 8 = 0 THEN o_orderstatus = 'O' ELSE o_orderkey % 20 = 0 END AS bad, o_orderstatus FROM orders),
fs AS (SELECT rule_key, count(*) FILTER (NOT bad AND o_orderstatus <> 'P') AS good, count(*) FILTER (bad) AS bad FROM fo GROUP BY ALL),
dk AS (SELECT rule_key FROM fs WHERE good + bad >= 10 AND bad / (good + bad) >= 0.25)"""
