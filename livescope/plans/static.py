"""Registered queries of the inventory operators, over facts derived from ``part``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assembly, documents, graph, static
from ..sources import facts
from .registry import SQL, query

_W = f"WITH {facts.FACTS}"
_WR = f"WITH RECURSIVE {facts.FACTS}"


def _in(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PROBEABLE = "NOT is_synthetic AND NOT is_bridge AND NOT is_abstract AND NOT is_native AND name <> '<clinit>'"
_OBSERVABLE = """NOT (is_abstract OR is_native OR n_ins <= 2 OR (n_ins = 3 AND ops[1] = 25 AND ops[2] = 180 AND ops[3] BETWEEN 172 AND 177)
  OR (name = '<init>' AND is_plain AND invokes = 1 AND ctor_invokes = 1))"""
_TESTS = f"""tc AS (SELECT cls, list_has_any(annotations, {_in(static.TEST_ANNOTATIONS)}) OR cls IN (SELECT cls FROM mf WHERE list_has_any(annotations, {_in(static.TEST_ANNOTATIONS)}))
  OR regexp_matches(string_split(cls, '/')[-1], '(Test|Tests|IT)$') OR starts_with(string_split(cls, '/')[-1], 'Test') OR contains(origin, '/src/test/') OR contains('/' || origin || '/', '/test-classes/') AS is_test FROM cf)"""
_KIND = "CASE a " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in static.ENTRY_KINDS.items()) + " END"
_ENTRIES = f"""us AS (SELECT * FROM mf WHERE NOT is_synthetic AND NOT is_bridge AND name <> '<clinit>'),
en AS (SELECT DISTINCT * FROM (SELECT cls, name, "desc", {_KIND} AS kind, false AS propagated FROM (SELECT cls, name, "desc", unnest(annotations) AS a FROM us)) WHERE kind IS NOT NULL
  UNION SELECT us.cls, name, "desc", {_KIND} AS kind, true FROM us JOIN (SELECT cls, unnest(annotations) AS a FROM cf) x ON x.cls = us.cls AND a IN {str(static.CLASS_LEVEL)} WHERE is_public AND name <> '<init>')"""
_BELOW = "su AS (SELECT parent AS ancestor, ref FROM ln UNION SELECT su.ancestor, ln.ref FROM su JOIN ln ON ln.parent = su.ref)"


@query("F1", f'{_W} SELECT k, cls, name, "desc" FROM mf WHERE {_PROBEABLE}')
def f1(spark, sf):
    return static.probeable(facts.method_facts(spark, sf)).select("k", "cls", "name", "desc")


@query("F4", f"{_W} SELECT k, {_OBSERVABLE} AS observable FROM mf")
def f4(spark, sf):
    return facts.method_facts(spark, sf).select("k", static.observable().alias("observable"))


@query("F5", f"""{_W} SELECT k, list_has_any([regexp_replace(regexp_replace(a, ';$', ''), '^(.*[/$]|L)', '') FOR a IN mf.annotations || cf.annotations], {_in(static.SHORT_CIRCUITING)}) AS short_circuitable
FROM mf JOIN cf USING (cls)""")
def f5(spark, sf):
    classes = facts.class_facts(spark, sf).select("cls", F.col("annotations").alias("of_class"))
    return facts.method_facts(spark, sf).join(classes, "cls").select("k", static.short_circuitable(F.col("annotations"), F.col("of_class")).alias("short_circuitable"))


@query("F6", f"{_W} SELECT cls, is_public AND NOT list_has_any(string_split(lower(cls), '/')[1:-2], ['internal', 'impl']) AS is_public_api FROM cf")
def f6(spark, sf):
    return facts.class_facts(spark, sf).select("cls", static.public_api(F.col("is_public"), F.col("cls")).alias("is_public_api"))


@query("F7", f"{_W}, {_TESTS} SELECT * FROM tc")
def f7(spark, sf):
    return static.test_classes(facts.class_facts(spark, sf), facts.method_facts(spark, sf)).select("cls", "is_test")


def _entries(spark, sf):
    return static.entry_points_annotated(facts.class_facts(spark, sf), facts.method_facts(spark, sf))


@query("F8", f"{_W}, {_ENTRIES} SELECT * FROM en")
def f8(spark, sf):
    return _entries(spark, sf)


@query("F9", f"""{_W} SELECT cls, name, "desc", 'main' AS kind FROM mf WHERE is_public AND is_static AND name = 'main' AND "desc" = '([Ljava/lang/String;)V'""")
def f9(spark, sf):
    return static.entry_points_main(facts.method_facts(spark, sf))


@query("F10", f"""{_W} SELECT DISTINCT CASE WHEN c % 6 = 0 THEN 'absent/P' || c ELSE cls END AS cls, '<init>' AS name, '()V' AS "desc", 'ServiceLoader' AS kind FROM cf WHERE c % 3 = 0""")
def f10(spark, sf):
    named = F.when(F.col("c") % 6 == 0, F.concat(F.lit("absent/P"), "c")).otherwise(F.col("cls"))
    return static.entry_points_services(facts.class_facts(spark, sf).where("c % 3 = 0").select(named.alias("cls")))


_SPECS = ("com/shop/core/Item6#run0()V", "com/shop/internal/Order0Test#run1(*I)V", "com/shop/internal/Order0Test#run1()V", "no descriptor#x", "a#b#c()V", "#run()V", "com/X#()V", "com/X#y(()V")


def _specs(spark, sf):
    """The specifications, one for each of the first parts: a small configuration table."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("spec")) for i, s in enumerate(_SPECS)]))
    return facts.class_facts(spark, sf).where("c = 0").select(rows.alias("x")).select("x.*")


@query("F11", f"""{_WR}, {_BELOW}, sp(place, anc, n, re, spec) AS (VALUES (0, 'com/shop/core/Item6', 'run0', '\\(\\)V', '{_SPECS[0]}'), (1, 'com/shop/internal/Order0Test', 'run1', '\\(L[^;]+;I\\)V', '{_SPECS[1]}'),
  (2, 'com/shop/internal/Order0Test', 'run1', '\\(\\)V', '{_SPECS[2]}'))
SELECT mf.cls, name, "desc", arg_min(spec, place) AS kind FROM mf JOIN su ON su.ref = mf.cls JOIN sp ON sp.anc = su.ancestor AND sp.n = name AND regexp_full_match("desc", re)
WHERE NOT is_abstract AND NOT is_static GROUP BY ALL""")
def f11(spark, sf):
    return static.entry_points_boundary(graph.descendants(facts.type_links(spark, sf)), facts.method_facts(spark, sf), _specs(spark, sf))


@query("F12", f"""{_W}, s AS (SELECT k % 5 AS f, cls || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '#' || name WHEN 2 THEN '##()V' WHEN 3 THEN '#()V' ELSE '#' || name || "desc" END AS spec FROM mf)
SELECT spec, CASE f WHEN 0 THEN 'needs exactly one #' WHEN 1 THEN 'no descriptor' WHEN 2 THEN 'needs exactly one #' WHEN 3 THEN 'no name' END AS fault FROM s""")
def f12(spark, sf):
    f = F.col("k") % 5
    end = F.when(f == 0, F.lit("")).when(f == 1, F.concat(F.lit("#"), "name")).when(f == 2, F.lit("##()V")).when(f == 3, F.lit("#()V")).otherwise(F.concat(F.lit("#"), "name", "desc"))
    return facts.method_facts(spark, sf).select(F.concat("cls", end).alias("spec")).select("spec", static.boundary_fault(F.col("spec")).alias("fault"))


@query("F14", f"""{_WR}, {_BELOW}, pl AS (SELECT cs.*, kind IN ('virtual', 'interface') AS v, owner = 'java/lang/Object' AND name = 'getClass' AS g, owner IN (SELECT cls FROM cf) AS known FROM cs)
SELECT src, owner AS dst_cls, name AS dst_name, "desc" AS dst_desc, CASE WHEN kind IN ('static', 'special', 'lambda', 'instanceof') THEN 'exact' WHEN kind = 'opaque' OR g OR NOT known THEN 'unresolved' ELSE 'cha' END AS resolution,
  CASE WHEN kind = 'instanceof' OR (v AND g) THEN 'noop' ELSE 'blocking' END AS semantics FROM pl
UNION SELECT src, mf.cls, pl.name, pl."desc", 'cha', 'blocking' FROM pl JOIN su ON su.ancestor = owner JOIN mf ON mf.cls = su.ref AND mf.name = pl.name AND mf."desc" = pl."desc" WHERE v AND NOT g AND known""")
def f14(spark, sf):
    below = graph.descendants(facts.type_links(spark, sf))
    return static.resolve_edges(facts.call_sites(spark, sf), facts.class_facts(spark, sf), facts.method_facts(spark, sf), below)


_GLOBS = ("com.**.core.Item*#run*", "**.Order*", "com.*.web.*#main", "com.shop.**#*", "com.*#run0", "org.**#x")


@query("F15", f"""{_W}, x AS (SELECT replace(cls, '/', '.') AS cls, name FROM mf)
SELECT count(*) FILTER (regexp_full_match(cls, 'com\\.(.*\\.)?core\\.Item[^.]*') AND starts_with(name, 'run')) AS g0, count(*) FILTER (regexp_full_match(cls, '(.*\\.)?Order[^.]*')) AS g1,
  count(*) FILTER (regexp_full_match(cls, 'com\\.[^.]*\\.web\\.[^.]*') AND name = 'main') AS g2, count(*) FILTER (starts_with(cls, 'com.shop.')) AS g3, count(*) FILTER (regexp_full_match(cls, 'com\\.[^.]*') AND name = 'run0') AS g4,
  count(*) FILTER (starts_with(cls, 'org.')) AS g5 FROM x""")
def f15(spark, sf):
    return facts.method_facts(spark, sf).agg(*[F.count_if(static.matches(p, F.col("cls"), F.col("name"))).alias(f"g{i}") for i, p in enumerate(_GLOBS)])


_TIMED = f"""{_TESTS}, {_ENTRIES}, be AS (SELECT cls, name, "desc", min(kind) FILTER (NOT propagated) AS own, min(kind) FILTER (propagated) AS handed FROM en GROUP BY ALL),
ti AS (SELECT k, coalesce('entry:' || coalesce(own, handed), CASE WHEN starts_with(name, 'run') AND regexp_matches(mf.cls, '/core/Item[^/]*$') THEN 'include:{_GLOBS[0]}' END) AS reason
  FROM mf JOIN tc ON tc.cls = mf.cls AND NOT is_test LEFT JOIN be ON be.cls = mf.cls AND be.name = mf.name AND be."desc" = mf."desc"
  WHERE {_PROBEABLE.replace('name', 'mf.name')} AND {_OBSERVABLE.replace('name', 'mf.name')} AND NOT regexp_matches(mf.cls, '^com/[^/]*/web/'))""".replace("starts_with(name,", "starts_with(mf.name,")


def _timed(spark, sf):
    tests = static.test_classes(facts.class_facts(spark, sf), facts.method_facts(spark, sf)).select("cls", "is_test")
    return static.select_timed(facts.method_facts(spark, sf).join(tests, "cls"), _entries(spark, sf), [_GLOBS[0]], ["com.*.web.**"])


@query("F16", f"{_W}, {_TIMED} SELECT k, reason FROM ti WHERE reason IS NOT NULL")
def f16(spark, sf):
    return _timed(spark, sf).select("k", "reason")


_SERVICES = "SELECT cls FROM cf WHERE c % 3 = 0"


def assembled(spark, sf, most=1 << 40):
    services = facts.class_facts(spark, sf).where("c % 3 = 0").select("cls")
    return assembly.assemble(
        facts.class_facts(spark, sf), facts.method_facts(spark, sf), facts.call_sites(spark, sf), facts.type_links(spark, sf), services, _specs(spark, sf), assembly.Timing([_GLOBS[0]], ["com.*.web.**"], most)
    )


def _sub(name):
    """An earlier oracle as a table of its own."""
    return f"({SQL[name]})"


@query(
    "F21",
    f"""{_W}, p AS (SELECT cls, count(*) AS probes, sha256(string_agg(name || "desc" || chr(10), '' ORDER BY name, "desc")) AS schema_hash FROM {_sub('F1')} GROUP BY cls),
o AS (SELECT a.cls, count(*) FILTER (observable) AS observable, count(*) FILTER (short_circuitable) AS short_circuitable FROM {_sub('F1')} a JOIN {_sub('F4')} USING (k) JOIN {_sub('F5')} USING (k) GROUP BY a.cls),
e AS (SELECT cls, count(*) AS entry_points FROM (SELECT cls, name, "desc", kind FROM {_sub('F8')} UNION SELECT cls, name, "desc", kind FROM {_sub('F9')} UNION SELECT cls, '<init>', '()V', 'ServiceLoader' FROM ({_SERVICES}) UNION SELECT cls, name, "desc", kind FROM {_sub('F11')}) GROUP BY cls),
g AS (SELECT cls, count(*) AS calls, count(*) FILTER (resolution = 'unresolved') AS unresolved FROM {_sub('F14')} JOIN mf ON src = k GROUP BY cls)
SELECT cf.cls, coalesce(probes, 0) AS probes, schema_hash, is_public_api, is_test, coalesce(observable, 0) AS observable, coalesce(short_circuitable, 0) AS short_circuitable, coalesce(entry_points, 0) AS entry_points, coalesce(calls, 0) AS calls, coalesce(unresolved, 0) AS unresolved
FROM cf JOIN {_sub('F6')} USING (cls) JOIN {_sub('F7')} USING (cls) LEFT JOIN p USING (cls) LEFT JOIN o USING (cls) LEFT JOIN e USING (cls) LEFT JOIN g USING (cls)""",
)
def f21(spark, sf):
    """The whole inventory by class."""
    x = assembled(spark, sf)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    methods = x.methods.groupBy("cls").agg(F.count_if("observable").alias("observable"), F.count_if("short_circuitable").alias("short_circuitable"))
    points = x.entry_points.groupBy("cls").agg(F.count("*").alias("entry_points"))
    calls = x.edges.groupBy(F.col("src_cls").alias("cls")).agg(F.count("*").alias("calls"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"))
    joined = x.classes.join(methods, "cls", "left").join(points, "cls", "left").join(calls, "cls", "left")
    return joined.select("cls", F.col("probe_count").alias("probes"), "schema_hash", "is_public_api", "is_test", *[zero(c) for c in ("observable", "short_circuitable", "entry_points", "calls", "unresolved")])


@query(
    "A11_tables",
    f"""{_W}, e AS (SELECT cls, name, "desc", kind FROM {_sub('F8')} UNION SELECT cls, name, "desc", kind FROM {_sub('F9')} UNION SELECT cls, '<init>', '()V', 'ServiceLoader' FROM ({_SERVICES}) UNION SELECT cls, name, "desc", kind FROM {_sub('F11')})
SELECT 'classes' AS name, count(*) AS n, count(DISTINCT cls) AS classes FROM cf UNION ALL SELECT 'methods', count(*), count(DISTINCT cls) FROM {_sub('F1')} UNION ALL SELECT 'entry_points', count(*), count(DISTINCT cls) FROM e
UNION ALL SELECT 'edges', count(*), count(DISTINCT cls) FROM {_sub('F14')} JOIN mf ON src = k""",
)
def a11_tables(spark, sf):
    """The assembled inventory written as a document and read again, by table."""
    folder = f"{graph.scratch(spark)}/inventory-{uuid.uuid4().hex}"
    assembly.documents(assembled(spark, sf), "b", "shop").write.parquet(folder)
    read = documents.parse_inventories(spark.read.parquet(folder))
    tables = {
        "classes": documents.inventory_classes(read), "methods": documents.inventory_methods(read), "entry_points": documents.inventory_entry_points(read),
        "edges": documents.inventory_edges(read).withColumn("cls", F.substring_index("src", "#", 1)),
    }
    out = None
    for name, table in tables.items():
        one = table.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("cls").alias("classes"))
        out = one if out is None else out.unionByName(one)
    return out


@query("F17", f"{_W}, {_TIMED}, r AS (SELECT reason, count(*) AS methods, sum(count(*)) OVER () <= 250 AS within FROM ti WHERE reason IS NOT NULL GROUP BY reason) SELECT * FROM r ORDER BY methods DESC, reason LIMIT 5")
def f17(spark, sf):
    within, reasons = static.budget(_timed(spark, sf))
    return reasons.withColumn("within", F.lit(within))


@query("F18", f"""{_W}, x AS (SELECT {', '.join(f"'{p}' AS p{i}" for i, p in enumerate(_GLOBS))}, bool_or(cls LIKE 'org/%') AS g5, bool_or(cls NOT LIKE 'com/%/%' AND name = 'run0') AS g4 FROM mf)
SELECT p4 AS pattern FROM x WHERE NOT g4 UNION ALL SELECT p5 FROM x WHERE NOT g5""")
def f18(spark, sf):
    return static.unmatched(list(_GLOBS), facts.method_facts(spark, sf))


# Calls of four neighbours each way, so that there are many small components.
_LINKS = """lk AS (SELECT k AS src, CASE WHEN k % 10 < 5 THEN k // 10 * 10 + (k + 1) % 5 WHEN k % 10 < 8 THEN k // 10 * 10 + (k * 3) % 5 ELSE k + 7 END AS dst FROM pk WHERE size_ % 6 <> 0),
lx AS (SELECT src, dst FROM lk WHERE dst IN (SELECT k FROM pk) AND src <> dst)"""
_COMPONENTS = f"""{_LINKS}, rc AS (SELECT src, dst FROM lx UNION SELECT rc.src, lx.dst FROM rc JOIN lx ON lx.src = rc.dst),
co AS (SELECT k AS ref, least(k, coalesce(min(f.dst), k)) AS component FROM pk LEFT JOIN (SELECT a.src, a.dst FROM rc a JOIN rc b ON a.src = b.dst AND a.dst = b.src) f ON f.src = k GROUP BY k)"""


def _links(spark, sf):
    to = "CASE WHEN k % 10 < 5 THEN k div 10 * 10 + (k + 1) % 5 WHEN k % 10 < 8 THEN k div 10 * 10 + (k * 3) % 5 ELSE k + 7 END"
    nodes = facts.method_facts(spark, sf).select(F.col("k").alias("ref"))
    part = facts._parts(spark, sf).where("size_ % 6 <> 0").selectExpr("k AS src", f"{to} AS dst")
    return nodes, part.join(nodes, part["dst"] == nodes["ref"], "left_semi").where("src <> dst")


@query("F19", f"{_WR}, {_COMPONENTS} SELECT ref, component, dense_rank() OVER (ORDER BY component) - 1 AS scc_id FROM co")
def f19(spark, sf):
    nodes, links = _links(spark, sf)
    found = graph.kept(static.components(nodes, links))
    # Ids are the ranks of the smallest members, from 0.
    ranked = graph.placed(found.where("ref = component").select("component", F.lit(0).alias("all")), ["all"], ["component"])
    return found.join(ranked.select("component", (F.col("place") - 1).alias("scc_id")), "component").select("ref", "component", "scc_id")


@query("F20", f"""{_WR}, {_TESTS}, {_COMPONENTS}, kn AS (SELECT mf.k AS ref, is_test, mf.k % 6 = 0 AS is_entry, component, bool_or(is_test) OVER (PARTITION BY component) AS has_test
  FROM mf JOIN tc USING (cls) JOIN co ON co.ref = mf.k),
ib AS (SELECT dst, bool_or(s.is_test) AS from_test, bool_or(NOT s.is_test AND s.component <> t.component) AS outside FROM (SELECT DISTINCT * FROM lx) JOIN kn s ON s.ref = src JOIN kn t ON t.ref = dst GROUP BY dst)
SELECT ref, CASE WHEN is_test THEN true WHEN is_entry THEN false WHEN from_test IS NULL THEN NULL WHEN outside THEN false WHEN from_test OR has_test THEN true END AS test_only FROM kn LEFT JOIN ib ON dst = ref""")
def f20(spark, sf):
    nodes, links = _links(spark, sf)
    tests = static.test_classes(facts.class_facts(spark, sf), facts.method_facts(spark, sf)).select("cls", "is_test")
    methods = facts.method_facts(spark, sf).join(tests, "cls").select(F.col("k").alias("ref"), "is_test", (F.col("k") % 6 == 0).alias("is_entry"))
    return static.test_only(methods, links, static.components(nodes, links))


@query("F22", f"""{_W} SELECT k FROM mf WHERE name || "desc" IN {str((static.TRACE_ENTRIES[2], 'run0()V'))}""")
def f22(spark, sf):
    return facts.method_facts(spark, sf).where(static.trace_entry(F.col("name"), F.col("desc"), [" run0()V ", ""])).select("k")


@query("B23", f"{_W} SELECT cls FROM cf WHERE NOT (contains(cls, '$$Lambda') OR regexp_matches(cls, '\\$Proxy[0-9]+$'))")
def b23(spark, sf):
    return facts.class_facts(spark, sf).where(~static.generated(F.col("cls"))).select("cls")


_INCLUDE, _EXCLUDE = ["com/shop/", "org/jacoco/agent/", "datadog/"], ["com/shop/web/"]


@query("B24", f"""{_W}, n AS (SELECT c, CASE c % 6 WHEN 0 THEN 'java/x/' WHEN 1 THEN 'org/jacoco/agent/' WHEN 2 THEN 'org/jacoco/' WHEN 3 THEN 'datadog/' ELSE '' END || cls AS cls FROM cf)
SELECT c, c % 6 IN (1, 3) OR (c % 6 IN (4, 5) AND cls NOT LIKE 'com/shop/web/%') AS in_scope FROM n""")
def b24(spark, sf):
    c = F.col("c") % 6
    at = F.when(c == 0, "java/x/").when(c == 1, "org/jacoco/agent/").when(c == 2, "org/jacoco/").when(c == 3, "datadog/").otherwise("")
    named = facts.class_facts(spark, sf).select("c", F.concat(at, "cls").alias("cls"))
    return named.select("c", static.in_scope(F.col("cls"), _INCLUDE, _EXCLUDE).alias("in_scope"))


@query("B25", f"{_W} SELECT cls, starts_with(cls, 'com/shop/core/') OR starts_with(cls, 'com/shop/web/Item') AS in_both FROM cf")
def b25(spark, sf):
    both = static.scope_overlap(["com/shop/", "org/x/"], ["com/shop/core/", "com/shop/web/Item", "net/"])
    return facts.class_facts(spark, sf).select("cls", static._longest(F.col("cls"), both).isNotNull().alias("in_both"))
