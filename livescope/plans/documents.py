"""Registered queries of inventory documents, exports and record checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import documents, graph
from ..sources import derived as d
from ..sources import facts
from .registry import query

_W = f"WITH {facts.FACTS}"
_OBS = "CASE k % 6 WHEN 0 THEN 'Dynamically_Observable' WHEN 1 THEN ' stripped ' WHEN 2 THEN 'no' END"
_FLAG = "CASE k % 6 WHEN 3 THEN true WHEN 4 THEN false END"
_ELIGIBLE = "CASE k % 6 WHEN 0 THEN 'OBSERVABLE' WHEN 1 THEN 'DE_INSTRUMENTED' WHEN 3 THEN 'OBSERVABLE' ELSE 'NOT_DYNAMICALLY_OBSERVABLE' END"


def _said(spark, sf):
    """Methods as an inventory document says them: some things left out by rule."""
    m = facts.method_facts(spark, sf).selectExpr(
        "concat('b', c % 40) AS build", "'shop' AS artifact", "cls", "k AS idx", "name", "desc", "CASE WHEN k % 4 <> 0 THEN k END AS line", "CASE WHEN k % 3 = 0 THEN is_synthetic END AS synthetic",
        f"{_OBS} AS observability", f"{_FLAG} AS dynamicallyObservable", "CASE WHEN k % 5 = 0 THEN false END AS shortCircuitable", "CASE WHEN k % 9 = 0 THEN 'slow' END AS tier2Reason",
    )
    return m


def _bodies(spark, sf):
    """One document a build; some are spoiled by rule."""
    body = documents.write_inventory(_said(spark, sf))
    n = F.substring("build", 2, 9).cast("int")
    spoiled = F.when(n % 10 == 3, F.substring("body", 1, 60)).when(n % 10 == 4, F.regexp_replace("body", '"idx":[0-9]+,', "")).when(n % 10 == 5, F.regexp_replace("body", '"name":"com[^"]*",', ""))
    edges = F.when(n % 10 == 6, ',"callEdges":[{"from":"a","to":"b","resolution":"guess"}]}').when(n % 10 == 7, ',"callEdges":[{"from":"a","to":"b"},{"from":"a","to":"c","resolution":"cha","semantics":"noop"}]}')
    with_edges = F.when(edges.isNotNull(), F.concat(F.expr("substring(body, 1, length(body) - 1)"), edges))
    return body.select("build", F.coalesce(spoiled, with_edges, "body").alias("body"))


_FAULT = "CASE c % 40 % 10 WHEN 3 THEN 'unreadable' WHEN 4 THEN 'method without idx' WHEN 5 THEN 'class without name' WHEN 6 THEN 'bad resolution' END"


@query("A3", f"""{_W} SELECT 'b' || (c % 40) AS build, cls, k AS idx, name, "desc", CASE WHEN k % 4 <> 0 THEN k END AS line, k % 3 = 0 AND is_synthetic AS is_synthetic, k % 5 <> 0 AS short_circuitable, {_ELIGIBLE} AS eligibility
FROM mf WHERE c % 10 NOT IN (3, 4, 5, 6)""")
def a3(spark, sf):
    parsed = documents.parse_inventories(_bodies(spark, sf))
    return documents.inventory_methods(parsed).select("build", "cls", "idx", "name", "desc", "line", "is_synthetic", "short_circuitable", "eligibility")


@query("A3_faults", f"{_W} SELECT DISTINCT 'b' || (c % 40) AS build, {_FAULT} AS fault FROM cf")
def a3_faults(spark, sf):
    return documents.parse_inventories(_bodies(spark, sf)).select("build", "fault")


@query("A3_edges", f"""{_W} SELECT DISTINCT 'b' || (c % 40) AS build, 'a' AS src, x AS dst, CASE x WHEN 'b' THEN 'unresolved' ELSE 'cha' END AS resolution, CASE x WHEN 'b' THEN 'blocking' ELSE 'noop' END AS semantics
FROM cf, (VALUES ('b'), ('c')) v(x) WHERE c % 10 = 7""")
def a3_edges(spark, sf):
    return documents.inventory_edges(documents.parse_inventories(_bodies(spark, sf)))


@query("A4", f"{_W} SELECT k, {_ELIGIBLE} AS eligibility FROM mf")
def a4(spark, sf):
    return _said(spark, sf).select(F.col("idx").alias("k"), documents.eligibility(F.col("observability"), F.col("dynamicallyObservable")).alias("eligibility"))


@query("A5", f"""{_W} SELECT c % 16 AS part, row_number() OVER (PARTITION BY c % 16 ORDER BY c) AS line_no, cls || '#*' AS line FROM cf""")
def a5(spark, sf):
    folder = f"{graph.scratch(spark)}/rules-{uuid.uuid4().hex}"
    part = (F.col("c") % 16).alias("part")
    lines = facts.class_facts(spark, sf).groupBy(part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "cls"))), lambda x: F.concat(x.cls, F.lit("#*"))), "\n").alias("text"))
    lines.repartition("part").write.partitionBy("part").text(folder)
    read = documents.read_rule_lines(spark, f"{folder}/part=*")
    return read.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), "line_no", "line").where("line <> ''")


@query("A8", f"""{_W} SELECT cls, name, "desc", k % 3 > 0 AS covered FROM mf WHERE k % 7 <> 0""")
def a8(spark, sf):
    folder = f"{graph.scratch(spark)}/report-{uuid.uuid4().hex}"
    escaped = lambda c: F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    counter = F.when(F.col("k") % 7 != 0, F.format_string('<counter type="INSTRUCTION" missed="1" covered="%d"/>', F.col("k") % 3)).otherwise("")
    method = F.concat(F.lit('<method name="'), escaped(F.col("name")), F.lit('" desc="'), F.col("desc"), F.lit('"><counter type="LINE" missed="0" covered="9"/>'), counter, F.lit("</method>"))
    rows = facts.method_facts(spark, sf).groupBy("c", "cls").agg(F.array_join(F.collect_list(method), "").alias("inner"))
    one = F.concat(F.lit('<class name="'), "cls", F.lit('">'), "inner", F.lit("</class>"))
    reports = rows.groupBy((F.col("c") % 16).alias("part")).agg(F.concat(F.lit("<report>"), F.array_join(F.collect_list(one), ""), F.lit("</report>")).alias("text"))
    reports.repartition("part").write.partitionBy("part").text(folder)
    return documents.read_xml_coverage(spark, f"{folder}/part=*")


@query("A10", f"""{_W} SELECT k, CASE WHEN k % 2 = 0 THEN 'production' ELSE 'env' || (k % 3) END AS environment, k % 2 = 0 OR k % 3 <> 0 AS liveness FROM mf""")
def a10(spark, sf):
    folder = f"{graph.scratch(spark)}/evolving-{uuid.uuid4().hex}"
    m = facts.method_facts(spark, sf).select("k")
    m.where("k % 2 = 0").write.parquet(f"{folder}/version=1")
    m.where("k % 2 = 1").select("k", F.concat(F.lit("env"), F.col("k") % 3).alias("environment")).write.parquet(f"{folder}/version=2")
    held = spark.read.option("mergeSchema", "true").parquet(folder).drop("version")
    return documents.evolve(held, {"environment": F.lit("production"), "liveness": (F.col("k") % 2 == 0) | (F.col("k") % 3 != 0)})


@query("A11", f"""{_W}, x AS (SELECT 'b' || (c % 40) AS build, cls, list({{'idx': k, 'name': name, 'desc': "desc", 'tier2Reason': CASE WHEN k % 9 = 0 THEN 'slow' END}} ORDER BY k) AS methods FROM mf GROUP BY ALL)
SELECT build, replace(CAST(to_json({{'buildSha': build, 'artifact': 'shop', 'classes': list({{'name': cls, 'methods': methods}} ORDER BY cls)}}) AS VARCHAR), ',"tier2Reason":null', '') AS body FROM x GROUP BY build""")
def a11(spark, sf):
    return documents.write_inventory(_said(spark, sf).select("build", "artifact", "cls", "idx", "name", "desc", "tier2Reason"))


@query("A12", f"""{_W} SELECT k, CAST(to_json({{'class': cls, 'method': name, 'status': CASE WHEN k % 2 = 0 THEN 'LIVE' ELSE 'UNKNOWN' END, 'staticReachable': CASE WHEN k % 3 = 0 THEN k % 2 = 0 END}}) AS VARCHAR) AS body FROM mf""")
def a12(spark, sf):
    v = facts.method_facts(spark, sf).selectExpr("k", "cls", "name", "CASE WHEN k % 2 = 0 THEN 'LIVE' ELSE 'UNKNOWN' END AS status", "CASE WHEN k % 3 = 0 THEN k % 2 = 0 END AS reachable")
    return documents.to_wire(v, {"cls": "class", "name": "method", "status": "status", "reachable": "staticReachable"}, "k")








_RATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 70 - 3 END AS rate, o_orderkey % 4 AS n_edges FROM orders"


@query("B5", f"WITH r AS ({_RATES}) SELECT o_orderkey, CASE WHEN rate IS NOT NULL AND rate NOT IN (1, 2, 4, 8, 16, 32, 64) THEN 'bad_field' WHEN n_edges > 0 AND rate IS NULL THEN 'missing_field' END AS fault FROM r")
def b5(spark, sf):
    """What every order's sample rate is refused for; B5_documents takes the same faults through whole documents."""
    o = d.read(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 70 - 3 END AS rate", "o_orderkey % 4 AS n_edges")
    return o.select("o_orderkey", documents.edge_rate_fault(F.col("rate"), F.col("n_edges")).alias("fault"))
