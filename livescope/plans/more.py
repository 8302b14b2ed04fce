"""Further registered queries: rules, ledgers, reports and conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, edges, rules
from ..sources import derived as d
from ..sources import windows
from .registry import _FRAMES, _LIFE, SQL, _decoded, _frames, query


@query(
    "C8",
    f"""WITH {d.COVERAGE}, r AS (SELECT DISTINCT build, instance, day, cls, CASE WHEN (day(day) + length(instance || cls)) % 5 = 0 THEN 'new' ELSE 'old' END AS h FROM cb),
f AS (SELECT *, first_value(h) OVER (PARTITION BY build, cls ORDER BY day, instance) AS first_hash FROM r)
SELECT build, cls, count(*) FILTER (h = first_hash) AS accepted, count(*) FILTER (h <> first_hash) AS dropped FROM f GROUP BY ALL""",
)
def c8(spark, sf):
    r = d.coverage_bits(spark, sf).select("build", "instance", "day", "cls").distinct()
    odd = (F.dayofmonth("day") + F.length(F.concat("instance", "cls"))) % 5 == 0
    guarded = coverage.guard_schema(r.withColumn("schema_hash", F.when(odd, "new").otherwise("old")), [F.col("day"), F.col("instance")])
    return guarded.groupBy("build", "cls").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("dropped"))


@query("B2", f"WITH {d.DOCUMENTS} SELECT build, count(*) FILTER (f % 7 <> 1 AND f % 11 <> 3) AS understood FROM fx GROUP BY ALL")
def b2(spark, sf):
    version = F.try_variant_get("doc", "$.schemaVersion", "bigint").isin(*windows.VERSIONS)
    return _decoded(spark, sf).groupBy("build").agg(F.count_if(F.coalesce(version, F.lit(False))).alias("understood"))


@query(
    "E10",
    f"""WITH {d.EDGES}, l AS (SELECT build, day, CAST(sum(observations) AS BIGINT) AS observed, count(*) FILTER (observations % 7 = 0) AS dropped FROM we GROUP BY ALL)
SELECT *, dropped > 0 AS lossy FROM l""",
)
def e10(spark, sf):
    return edges.loss(d.window_edges(spark, sf).withColumn("dropped", F.col("observations") % 7 == 0))


def _lines(spark, sf):
    k = F.col("p_partkey")
    line = (
        F.when(k % 6 == 0, F.lit("  # only a comment")).when(k % 6 == 1, F.concat("cls", F.lit("#"), "name", F.lit("  # why # not")))
        .when(k % 6 == 2, F.col("cls")).when(k % 6 == 3, F.concat("cls", F.lit("#"), "name", "desc")).when(k % 6 == 4, F.lit("")).otherwise(F.concat(F.lit("*#"), "name"))
    )
    plain = d.methods(spark, sf).withColumn("cls", F.translate("cls", "#", ""))
    return plain.select(k.alias("line_no"), line.alias("line"))


_PARSED = f"""{d.METHODS}, pa AS (SELECT p_partkey AS line_no, CASE p_partkey % 6 WHEN 5 THEN '*' ELSE replace(cls, '#', '') END AS class_glob, CASE p_partkey % 6 WHEN 2 THEN '*' ELSE name END AS method_glob,
  CASE p_partkey % 6 WHEN 3 THEN "desc" ELSE '*' END AS desc_glob, CASE p_partkey % 6 WHEN 1 THEN 'why # not' ELSE '' END AS comment FROM me WHERE p_partkey % 6 NOT IN (0, 4))"""


@query("I1", f"WITH {_PARSED} SELECT * FROM pa")
def i1(spark, sf):
    return rules.parse_rules(_lines(spark, sf))


def _classes(spark, sf):
    member = F.struct("name", (F.col("p_partkey") % 4 == 0).alias("generated"))
    grouped = d.methods(spark, sf).groupBy("cls", "artifact").agg(F.collect_list(member).alias("members"))
    marks = F.when(F.col("artifact").isin("Brand#8", "Brand#9"), F.array(F.lit("javax.annotation.Generated"))).otherwise(F.array(F.lit("x.Other")))
    return grouped.withColumn("annotations", marks)


_DERIVED = f"""{d.METHODS}, de AS (SELECT DISTINCT cls, '*' AS method_glob FROM me WHERE artifact IN ('Brand#8', 'Brand#9')
  UNION ALL SELECT cls, name FROM me WHERE artifact NOT IN ('Brand#8', 'Brand#9') AND p_partkey % 4 = 0)"""


@query("I4", f"WITH {_DERIVED} SELECT * FROM de")
def i4(spark, sf):
    return rules.derived_rules(_classes(spark, sf))


def _composed(spark, sf):
    user = rules.parse_rules(_lines(spark, sf)).select(F.col("class_glob").alias("cls"), "method_glob")
    return rules.compose({"user": user, "derived": rules.derived_rules(_classes(spark, sf))})


@query("I5", f"WITH {_DERIVED}, {_PARSED[len(d.METHODS) + 2 :]} SELECT class_glob AS cls, method_glob, 'user' AS origin, 0 AS layer FROM pa UNION ALL SELECT cls, method_glob, 'derived', 1 FROM de")
def i5(spark, sf):
    return _composed(spark, sf)


@query("I6", f"SELECT origin, count(*) AS rules FROM ({SQL['I5']}) GROUP BY ALL")
def i6(spark, sf):
    return rules.counts_by_origin(_composed(spark, sf))


@query("K17", f"WITH {d.METHODS} SELECT cls, name, count(*) AS overloads, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM me GROUP BY ALL")
def k17(spark, sf):
    found = d.methods(spark, sf).groupBy("cls", "name").agg(F.count("*").alias("overloads"))
    return found.withColumn("resolution", F.when(F.col("overloads") == 1, "resolved").otherwise("ambiguous"))


@query(
    "K18",
    f"""WITH {d.WINDOWS} SELECT build, CASE WHEN count(*) FILTER ({_LIFE}) = 0 THEN 'nothing is production' WHEN count(*) FILTER ({_LIFE} AND NOT degraded) = 0 THEN 'all degraded'
  WHEN count(*) FILTER (NOT {_LIFE}) > 0 THEN 'some withheld' ELSE 'open' END AS note FROM wi GROUP BY ALL""",
)
def k18(spark, sf):
    from ..operators.admission import usable

    g = usable(d.windows(spark, sf)).groupBy("build").agg(F.count_if("life").alias("life"), F.count_if("death").alias("death"), F.count("*").alias("n"))
    note = F.when(F.col("life") == 0, "nothing is production").when(F.col("death") == 0, "all degraded").when(F.col("life") < F.col("n"), "some withheld").otherwise("open")
    return g.select("build", note.alias("note"))


@query(
    "L14",
    r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'null' WHEN regexp_matches(text, '(?s)^[^@]+@.*\.') OR regexp_matches(text, '[0-9]{12,}') OR regexp_matches(text, '(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)')
  OR regexp_matches(text, '(^|[^A-Za-z0-9])[A-Z]{5}[0-9]{4}[A-Z]([^A-Za-z0-9]|$)') THEN 'redacted' ELSE 'len' END AS kind, length(text) AS n FROM documents""",
)
def l14(spark, sf):
    from ..functions.redaction import denied_text

    t = F.col("text")
    kind = F.when(t.isNull(), "null").when(denied_text(t), "redacted").otherwise("len")
    return d.read(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.char_length(t).cast("long").alias("n"))


@query(
    "L4",
    f"""WITH RECURSIVE {_FRAMES}, m AS (SELECT trace, ordinal, parent, threw IS NULL AND size_in = size_out AND parent IS NOT NULL AS skip FROM fr),
w AS (SELECT trace, ordinal, parent AS up, 0 AS via FROM m WHERE NOT skip UNION ALL SELECT w.trace, w.ordinal, m.parent, via + 1 FROM w JOIN m ON m.trace = w.trace AND m.ordinal = w.up WHERE skip)
SELECT w.trace, w.ordinal, up AS kept_parent, via FROM w LEFT JOIN m ON m.trace = w.trace AND m.ordinal = w.up WHERE up IS NULL OR NOT coalesce(skip, false)""",
)
def l4(spark, sf):
    from ..operators.traces import collapse

    return collapse(_frames(spark, sf))


