"""Reachability, phases, facts and verdicts over the evidence store, and the reports made of them, each with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import admission, facts, graph, inventory, ledger, phases, rules, verdict
from ..sources import derived as d
from ..sources import store
from .registry import query

# ---- G1-G6: what the call graph says

_TRIAGE = f"""{d.METHODS}, {store.GRAPH}, te AS (SELECT p_partkey AS ref FROM me WHERE is_test),
ic AS (SELECT DISTINCT cg.src, cg.dst FROM cg JOIN sk a ON a.ref = cg.src JOIN sk b ON b.ref = cg.dst AND a.component = b.component),
tr AS (SELECT cg.*, CASE WHEN resolution = 'unresolved' THEN 'unresolved' WHEN src IN (SELECT ref FROM te) THEN 'from_test' WHEN (src, dst) IN (SELECT (src, dst) FROM ic) THEN 'intra_component'
  WHEN semantics IN ('noop', 'no-op') THEN 'noop' ELSE 'forward' END AS category FROM cg),
ro AS (SELECT DISTINCT ref FROM ep WHERE kind <> 'test' AND ref NOT IN (SELECT ref FROM te)),
fw AS (SELECT src, dst FROM tr WHERE category = 'forward' UNION SELECT a.p_partkey, b.p_partkey FROM me a JOIN me b ON a.cls = b.cls AND b.name = '<clinit>' AND a.p_partkey <> b.p_partkey),
re AS (SELECT ref FROM ro UNION SELECT dst FROM fw JOIN re ON src = re.ref)"""
_STATIC = """nd AS (SELECT src AS ref FROM cg UNION SELECT dst FROM cg),
sr AS (SELECT p_partkey AS ref, CASE WHEN name = '<clinit>' OR p_partkey IN (SELECT ref FROM re) THEN true WHEN p_partkey IN (SELECT dst FROM tr) THEN NULL WHEN p_partkey IN (SELECT ref FROM nd) THEN false END AS static_reachable FROM me)"""


def _methods(spark, sf):
    return d.methods(spark, sf).withColumn("ref", F.col("p_partkey"))


def _triaged(spark, sf, calls=store.thinned_call_edges):
    return graph.triage(calls(spark, sf), _methods(spark, sf).where("is_test").select("ref"), store.components(spark, sf))


def _reached(spark, sf, calls=store.thinned_call_edges):
    """What production roots reach over forward calls, and the initialisers of reached classes."""
    starts = graph.initialisers(_methods(spark, sf).select("ref", "cls", "name"))
    roots = inventory.roots(d.entry_points(spark, sf), d.methods(spark, sf)).where("kept")
    return graph.reachable(roots, _triaged(spark, sf, calls).where("category = 'forward'").select("src", "dst").unionByName(starts))


def _static(spark, sf, calls=store.thinned_call_edges):
    return graph.static_reachable(_methods(spark, sf).select("ref", "name"), _triaged(spark, sf, calls), _reached(spark, sf, calls)).select("ref", "static_reachable")


@query("G1", f"WITH RECURSIVE {_TRIAGE} SELECT DISTINCT ref, ref IN (SELECT ref FROM ro) AS kept FROM ep")
def g1(spark, sf):
    """Entry points, those that are tests marked as dropped."""
    return inventory.roots(d.entry_points(spark, sf), d.methods(spark, sf))


@query("G2", f"WITH RECURSIVE {_TRIAGE} SELECT * FROM tr")
def g2(spark, sf):
    return _triaged(spark, sf)


@query("G3", f"WITH RECURSIVE {_TRIAGE} SELECT ref FROM re")
def g3(spark, sf):
    return _reached(spark, sf)


@query(
    "G4",
    f"""WITH RECURSIVE {_TRIAGE} SELECT dst AS ref, bool_and(category IN ('from_test', 'intra_component')) AS only_test,
  count(*) FILTER (category = 'noop') > 0 AND count(*) FILTER (category = 'forward') = 0 AS only_noop FROM tr WHERE category <> 'unresolved' AND dst NOT IN (SELECT ref FROM re) GROUP BY dst""",
)
def g4(spark, sf):
    return graph.inbound_kinds(_triaged(spark, sf), _reached(spark, sf))


@query("G5", f"WITH RECURSIVE {_TRIAGE}, {_STATIC} SELECT * FROM sr")
def g5(spark, sf):
    return _static(spark, sf)


_KINDS = "ki AS (SELECT artifact AS build, cls, arg_min(kind, ref) AS kind FROM ep JOIN me ON ref = p_partkey GROUP BY ALL)"


def _kinds(spark, sf):
    named = _methods(spark, sf).select("ref", F.col("artifact").alias("build"), "cls")
    return named.join(d.entry_points(spark, sf), "ref").groupBy("build", "cls").agg(F.min_by("kind", "ref").alias("kind"))


@query("G6", f"WITH {d.METHODS}, {store.GRAPH}, {_KINDS} SELECT DISTINCT artifact AS build, me.cls, coalesce(kind, 'none') AS kind FROM me LEFT JOIN ki ON build = artifact AND ki.cls = me.cls")
def g6(spark, sf):
    classes = _methods(spark, sf).select(F.col("artifact").alias("build"), "cls").distinct()
    return classes.join(_kinds(spark, sf), ["build", "cls"], "left").withColumn("kind", F.coalesce("kind", F.lit("none")))


# ---- H: intervals with part days from orders, and calendars

_IV = """iv AS (SELECT o_orderpriority || '/' || (o_custkey % 40) AS build, o_orderdate::TIMESTAMP + to_hours(CAST(o_orderkey % 7 AS INTEGER)) AS start,
  o_orderdate::TIMESTAMP + to_hours(CAST(o_orderkey % 7 + o_custkey % 3 * 11 AS INTEGER)) AS stop FROM orders)"""
_TEXT = "yyyy-MM-dd HH:mm:ss"


def _intervals(spark, sf):
    """Some hours of a day for every order, a third of them empty."""
    o = d.read(spark, sf, "orders")
    at = lambda hours: F.expr(f"CAST(o_orderdate AS timestamp_ntz) + make_dt_interval(0, CAST({hours} AS INT))")
    build = F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 40)
    return o.select(build.alias("build"), at("o_orderkey % 7").alias("start"), at("o_orderkey % 7 + o_custkey % 3 * 11").alias("stop"))


def _texts(df, *columns):
    return df.withColumns({c: F.date_format(c, _TEXT) for c in columns})


_SQL_TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_MERGED = f"""{_IV}, dd AS (SELECT build, start, max(stop) AS stop FROM iv WHERE start < stop GROUP BY ALL),
x AS (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY build ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS new FROM dd),
y AS (SELECT *, sum(new) OVER (PARTITION BY build ORDER BY start) AS island FROM x),
mi AS (SELECT build, min(start) AS start, max(stop) AS stop FROM y GROUP BY build, island),
sp AS (SELECT build, min(start) AS lo, max(stop) AS hi FROM mi GROUP BY build)"""


@query("H1", f"WITH {_MERGED} SELECT build, {_SQL_TEXT.format('start')}, {_SQL_TEXT.format('stop')} FROM mi")
def h1(spark, sf):
    return _texts(phases.merge_intervals(_intervals(spark, sf)), "start", "stop")


@query("H5", f"WITH {_MERGED} SELECT build, strftime(lo, '%Y-%m-%d %H:%M:%S') AS start, strftime(hi, '%Y-%m-%d %H:%M:%S') AS stop, date_diff('second', lo, hi) // 86400 AS window_days FROM sp")
def h5(spark, sf):
    return _texts(phases.span(_intervals(spark, sf)), "start", "stop")


_CALENDAR = phases.Calendar(
    ("month-end", "quarter-end", "year-end", "night-shift", "audit"),
    (("month-end", "last-days-of-month", 2), ("quarter-end", "last-days-of-quarter", 5), ("year-end", "last-days-of-year", 9)),
    (("night-shift", "1996-03-04T03:30:00", "1996-03-04T09:45:00", "night"), ("night-shift", "1999-12-31T22:00:00", "2000-01-01T02:00:00", "turn"), ("audit", "1980-01-01", "1980-02-01", "old")),
    0.25,
)
_MONTHS = f"""{_MERGED}, ru(phase, every, days) AS (VALUES ('month-end', 1, 2), ('quarter-end', 3, 5), ('year-end', 12, 9)),
oc AS (SELECT DISTINCT phase, CAST(last_day(m) - days + 1 AS TIMESTAMP) AS p_start, CAST(last_day(m) + 1 AS TIMESTAMP) AS p_stop, strftime(m, '%Y-%m') AS label
  FROM ru, unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2003-12-01', INTERVAL 1 MONTH)) g(m) WHERE month(m) % every = 0
  UNION ALL VALUES ('night-shift', TIMESTAMP '1996-03-04 03:30:00', TIMESTAMP '1996-03-04 09:45:00', 'night'), ('night-shift', TIMESTAMP '1999-12-31 22:00:00', TIMESTAMP '2000-01-01 02:00:00', 'turn'),
    ('audit', TIMESTAMP '1980-01-01', TIMESTAMP '1980-02-01', 'old')),
ca AS (SELECT build, phase, p_start, p_stop, label FROM sp JOIN oc ON p_start < hi AND p_stop > lo),
co AS (SELECT ca.*, CAST(sum(epoch(least(stop, p_stop)) - epoch(greatest(start, p_start))) AS BIGINT) AS covered FROM ca JOIN mi ON mi.build = ca.build AND start < p_stop AND stop > p_start GROUP BY ALL)"""


def _occurrences(spark, sf):
    return phases.expand(phases.span(_intervals(spark, sf)).drop("window_days"), _CALENDAR)


@query("H3", f"WITH {_MONTHS} SELECT build, phase, {_SQL_TEXT.format('p_start')}, {_SQL_TEXT.format('p_stop')}, label FROM ca")
def h3(spark, sf):
    return _texts(_occurrences(spark, sf), "p_start", "p_stop")


@query("H2", f"WITH {_MONTHS} SELECT build, phase, {_SQL_TEXT.format('p_start')}, {_SQL_TEXT.format('p_stop')}, label, covered FROM co")
def h2(spark, sf):
    return _texts(phases.overlap_seconds(phases.merge_intervals(_intervals(spark, sf)), _occurrences(spark, sf)), "p_start", "p_stop")


@query(
    "H4",
    f"""WITH {_MONTHS}, fr AS (SELECT ca.build, ca.phase, coalesce(covered, 0) / (epoch(ca.p_stop) - epoch(ca.p_start)) AS f FROM ca LEFT JOIN co USING (build, phase, p_start)),
b AS (SELECT build, phase, max(f) AS best, count(*) AS n FROM fr GROUP BY ALL),
w AS (SELECT build, phase, coalesce(n, 0) AS occurrences, coalesce(best, 0) AS best FROM (SELECT DISTINCT build FROM iv) q CROSS JOIN (VALUES ('month-end'), ('quarter-end'), ('year-end'), ('night-shift'), ('audit')) p(phase) LEFT JOIN b USING (build, phase))
SELECT build, phase, round(best, 4) AS fraction, occurrences, occurrences > 0 AND best >= 0.25 AS is_covered, CASE WHEN occurrences = 0 THEN 'no occurrence' WHEN best >= 0.25 THEN 'covered' ELSE 'too little observed' END AS state FROM w""",
)
def h4(spark, sf):
    own = _intervals(spark, sf)
    return phases.phase_coverage(own, phases.merge_intervals(own), _CALENDAR).drop("place", "label")


@query(
    "A6",
    """WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY ALL)
SELECT 'peak ' || p AS phase, 'file' AS origin, strftime(lo, '%Y-%m-%d') AS what, CAST(y AS VARCHAR) AS label FROM y
UNION ALL SELECT 'close ' || r_name, 'file', ['last-days-of-month', 'last-days-of-quarter', 'last-days-of-year'][r_regionkey % 3 + 1], CAST(greatest(r_regionkey, 1) AS VARCHAR) FROM region
UNION ALL SELECT * FROM (VALUES ('month-end', 'default', 'last-days-of-month', '2'), ('quarter-end', 'default', 'last-days-of-quarter', '3'), ('year-end-close', 'default', 'last-days-of-year', '5'),
  ('peak-season', 'default', 'required', ''), ('dr-drill', 'default', 'required', ''))""",
)
def a6(spark, sf):
    """A calendar document made of the tables, written, read and checked; and what stands in for a file that isn't there."""
    folder = f"{graph.scratch(spark)}/calendar-{uuid.uuid4().hex}"
    years = d.read(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    one = years.select(F.struct(
        F.concat(F.lit("peak "), "o_orderpriority").alias("phase"), F.date_format("lo", "yyyy-MM-dd").alias("start"), F.date_format("hi", "yyyy-MM-dd").alias("end"), F.col("y").cast("string").alias("label"),
    ).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("occurrences"))  # years and priorities are few
    kinds = F.array(*map(F.lit, phases.RULES))
    rule = F.struct(F.concat(F.lit("close "), "r_name").alias("phase"), F.get(kinds, (F.col("r_regionkey") % 3).cast("int")).alias("rule"), F.greatest(F.col("r_regionkey"), F.lit(1)).alias("days"))
    recurring = d.read(spark, sf, "region").agg(F.sort_array(F.collect_list(rule)).alias("recurring"))
    one.join(recurring).select(F.to_json(F.struct("occurrences", "recurring")).alias("value")).write.text(folder)
    out = []
    for origin, path in (("file", folder), ("default", f"{folder}-missing")):
        found = phases.read_calendar(spark, path)
        out += [(p, origin, r, str(n)) for p, r, n in found.recurring] + [(p, origin, start, label) for p, start, _, label in found.occurrences]
        if origin == "default":
            out += [(p, origin, "required", "") for p in found.required if p not in {r[0] for r in found.recurring}]
    return spark.createDataFrame(out, "phase string, origin string, what string, label string")


# ---- G7-G11, J5, J7, K: facts, verdicts and their reports

MIN_DAYS, CAP = 400, 3
USER_RULES = ["p.Brand?1.ECONOMY#*  # retired line", "", "# a comment", "*#m1?  # short names", "*.SMALL#m[2-4]*(*7)V"]
YEARS = range(1995, 2002)
CALENDAR = phases.DEFAULT._replace(occurrences=tuple(
    x for y in YEARS for x in (("peak-season", f"{y}-11-20", f"{y}-12-05", str(y)), ("dr-drill", f"{y}-05-10", f"{y}-05-12", str(y)))
))


def _generated(spark, sf):
    """Rules derived from generated classes and members."""
    m = _methods(spark, sf)
    member = F.struct("name", (F.col("ref") % 20 == 3).alias("generated"))
    marks = F.when(F.col("artifact") == "Brand#8", F.array(F.lit("javax.annotation.Generated"))).otherwise(F.array(F.lit("x.Other")))
    return rules.derived_rules(m.groupBy("cls", "artifact").agg(F.collect_list(member).alias("members")).withColumn("annotations", marks))


def _disabled(spark, sf):
    return ledger.feedback_stats(store.feedback(spark, sf)).where("status = 'DISABLED'").select("rule_key")


def _facts(spark, sf, calls=store.thinned_call_edges):
    evidence = facts.Evidence(store.windows(spark, sf), store.coverage_bits(spark, sf), store.mask_records(spark, sf), store.mask_bits(spark, sf), store.loads(spark, sf), store.edges(spark, sf))
    suppressed = rules.suppress(_methods(spark, sf), USER_RULES, _generated(spark, sf))
    return facts.method_facts(
        store.inventory(spark, sf), evidence, CALENDAR, _static(spark, sf, calls), suppressed, _kinds(spark, sf), _disabled(spark, sf), store.proposals(spark, sf), MIN_DAYS
    )


def _verdicts(spark, sf, calls=store.thinned_call_edges):
    opened = store.proposals(spark, sf).where(F.col("first_proposed") == F.to_date(F.lit(store.TODAY))).groupBy("artifact").agg(F.count("*").alias("opened"))
    return verdict.evaluate_capped(_facts(spark, sf, calls), opened, CAP)


_OCCURRENCES = " UNION ALL ".join(
    f"SELECT '{p}', DATE '{a}', DATE '{b}'" for p, a, b, _ in CALENDAR.occurrences
)
_FACTS = f"""{store.STORE}, {_TRIAGE.removeprefix(d.METHODS + ", ")}, {_STATIC}, {_KINDS}, {store.LEDGER}, {store.FEEDBACK},
pb AS (SELECT build, cls, idx, min(end_day) AS first_seen, max(end_day) AS last_seen FROM sc JOIN lw USING (build, instance, day) GROUP BY ALL),
mb AS (SELECT DISTINCT build, cls, idx, true AS bit FROM sm SEMI JOIN lw USING (build, instance, day)), mr AS (SELECT DISTINCT build, cls, true AS reported FROM mo SEMI JOIN lw USING (build, instance, day)),
ld AS (SELECT DISTINCT build, cls, true AS loaded FROM sl SEMI JOIN lw USING (build, instance, day)), ev AS (SELECT * FROM se SEMI JOIN lw USING (build, instance, day)),
ed AS (SELECT build, caller_cls, caller_idx, callee_cls, callee_idx, sum(observations)::BIGINT AS n, min(rate) AS lo, max(rate) AS hi FROM ev GROUP BY ALL),
ei AS (SELECT build, callee_cls AS cls, callee_idx AS idx, count(*) AS inbound_edges, sum(n)::BIGINT AS inbound_observations, CASE WHEN min(lo) = max(hi) THEN min(lo) END AS own_rate FROM ed GROUP BY ALL),
eo AS (SELECT build, caller_cls AS cls, caller_idx AS idx, count(*) AS outbound_edges FROM ed GROUP BY ALL), er AS (SELECT build, CASE WHEN min(rate) = max(rate) THEN min(rate) END AS build_rate FROM ev GROUP BY build),
wb AS (SELECT build, count(*) FILTER (good) AS usable_windows, count(*) FILTER (NOT good) AS excluded_windows FROM (SELECT build, coalesce(environment = 'production', false) AND NOT tainted AND NOT degraded AS good FROM sw) GROUP BY build),
dw AS (SELECT build, day, end_day FROM lw WHERE death), sn AS (SELECT build, min(day) AS lo, max(end_day) AS hi, max(end_day) - min(day) AS window_days FROM dw GROUP BY build),
dy AS (SELECT DISTINCT build, CAST(x AS DATE) AS dd FROM dw, unnest(generate_series(day::TIMESTAMP, end_day::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY)) u(x)),
ph(phase, a, b) AS (SELECT p, CAST(last_day(m) - n + 1 AS DATE), CAST(last_day(m) + 1 AS DATE) FROM (VALUES ('month-end', 1, 2), ('quarter-end', 3, 3), ('year-end-close', 12, 5)) v(p, every, n),
  unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2003-12-01', INTERVAL 1 MONTH)) g(m) WHERE month(m) % every = 0 UNION ALL {_OCCURRENCES}),
pc AS (SELECT sn.build, phase, a, b, count(dd) / (b - a) AS f FROM sn JOIN ph ON a < hi AND b > lo LEFT JOIN dy ON dy.build = sn.build AND dd >= a AND dd < b GROUP BY sn.build, phase, a, b),
pp AS (SELECT build, string_agg(phase, ', ' ORDER BY place) FILTER (good) AS covered, string_agg(phase, ', ' ORDER BY place) FILTER (NOT good) AS missing FROM (
  SELECT w.build, w.phase, place, coalesce(max(f) >= 0.9, false) AS good FROM (SELECT build, phase, place FROM wb CROSS JOIN (VALUES ('month-end', 1), ('quarter-end', 2), ('year-end-close', 3), ('peak-season', 4), ('dr-drill', 5)) q(phase, place)) w
  LEFT JOIN pc USING (build, phase) GROUP BY ALL) GROUP BY build),
su AS (SELECT p_partkey AS ref, CASE WHEN cls = 'p.Brand#1.ECONOMY' THEN 'p.Brand?1.ECONOMY#* (user): retired line' WHEN regexp_full_match(name, 'm1.') THEN '*#m1? (user): short names'
  WHEN ends_with(cls, '.SMALL') AND regexp_full_match(name, 'm[2-4].*') AND "desc" LIKE '(%7)V' THEN '*.SMALL#m[2-4]*(*7)V (user)' WHEN artifact = 'Brand#8' THEN cls || '#* (derived)'
  WHEN (cls, name) IN (SELECT (cls, name) FROM me WHERE p_partkey % 20 = 3) THEN cls || '#' || name || ' (derived)' END AS suppression FROM me),
fa AS (SELECT im.*, first_seen IS NOT NULL AS observed, first_seen, last_seen, CASE WHEN reported THEN coalesce(bit, false) END AS installed, coalesce(reported, false) AS mask_reported, coalesce(loaded, false) AS class_loaded,
  static_reachable, suppression, suppression IS NOT NULL AS suppressed, coalesce(kind, 'none') AS entry_kind, coalesce(inbound_edges, 0) AS inbound_edges, coalesce(outbound_edges, 0) AS outbound_edges,
  coalesce(inbound_observations, 0) AS inbound_observations, coalesce(own_rate, build_rate) AS sample_rate, er.build IS NOT NULL AS edges_reported, coalesce(usable_windows, 0) AS usable_windows, coalesce(excluded_windows, 0) AS excluded_windows,
  coalesce(window_days, 0) AS window_days, CASE WHEN wb.build IS NULL THEN '' ELSE coalesce(covered, '') END AS phases_covered, CASE WHEN wb.build IS NULL THEN 'month-end, quarter-end, year-end-close, peak-season, dr-drill' ELSE coalesce(missing, '') END AS phases_missing,
  pv.first_proposed, coalesce(pv.active, false) AS proposed, CASE WHEN NOT pv.active THEN 'older' END AS revoked_reason
  FROM im LEFT JOIN pb USING (build, cls, idx) LEFT JOIN mb USING (build, cls, idx) LEFT JOIN mr USING (build, cls) LEFT JOIN ld USING (build, cls) LEFT JOIN sr USING (ref) LEFT JOIN su USING (ref) LEFT JOIN ki USING (build, cls)
  LEFT JOIN ei USING (build, cls, idx) LEFT JOIN eo USING (build, cls, idx) LEFT JOIN er ON er.build = im.build LEFT JOIN wb ON wb.build = im.build LEFT JOIN sn ON sn.build = im.build LEFT JOIN pp ON pp.build = im.build LEFT JOIN pv ON pv.ref = im.ref),
fb AS (SELECT *, CASE WHEN eligibility = 'OBSERVABLE' AND installed IS NOT DISTINCT FROM false THEN 'NO_PROBE_INSTALLED' ELSE eligibility END AS effective FROM fa),
fc AS (SELECT *, CASE WHEN 'entrypoint:' || entry_kind IN (SELECT rule_key FROM dk) THEN 'entrypoint:' || entry_kind WHEN 'eligibility:' || effective IN (SELECT rule_key FROM dk) THEN 'eligibility:' || effective END AS disabled_key FROM fb),
ba AS (SELECT *, [CASE WHEN suppressed THEN 'suppressed' END, CASE WHEN name = '<clinit>' THEN 'clinit' END, CASE WHEN is_public_api THEN 'public-api' END,
  CASE WHEN eligibility = 'NOT_DYNAMICALLY_OBSERVABLE' THEN 'not-dynamically-observable' END, CASE WHEN eligibility = 'DE_INSTRUMENTED' THEN 'de-instrumented' END, CASE WHEN effective = 'NO_PROBE_INSTALLED' THEN 'no-probe-installed' END,
  CASE WHEN short_circuitable THEN 'short-circuitable' END, CASE WHEN NOT class_loaded THEN 'class-never-loaded' END, CASE WHEN static_reachable THEN 'static-reachable' END, CASE WHEN static_reachable IS NULL THEN 'static-unresolved' END,
  CASE WHEN inbound_edges > 0 THEN 'runtime-edge-observed' END, CASE WHEN usable_windows = 0 THEN 'no-usable-window' END, CASE WHEN phases_missing <> '' THEN 'phases-missing' END, CASE WHEN window_days < {MIN_DAYS} THEN 'window-too-short' END,
  CASE WHEN disabled_key IS NOT NULL THEN 'rule-class-disabled' END] AS found FROM fc),
bb AS (SELECT *, list_filter(found, lambda x: x IS NOT NULL) AS found2, CASE WHEN observed OR inbound_edges > 0 THEN 'LIVE' WHEN suppressed THEN 'UNKNOWN' WHEN eligibility = 'NOT_DYNAMICALLY_OBSERVABLE' THEN eligibility
  WHEN len(list_filter(found, lambda x: x IS NOT NULL)) > 0 THEN 'UNKNOWN' ELSE 'DEAD_CANDIDATE' END AS first_status FROM ba),
rk AS (SELECT ref, row_number() OVER (PARTITION BY artifact ORDER BY cls, name, "desc") AS place FROM bb WHERE first_status = 'DEAD_CANDIDATE' AND NOT proposed),
bc AS (SELECT bb.*, place IS NOT NULL AND place > {CAP} - coalesce(opened, 0) AS limited FROM bb LEFT JOIN rk USING (ref) LEFT JOIN op USING (artifact)),
ve AS (SELECT *, CASE WHEN limited THEN list_append(found2, 'rate-limited') ELSE found2 END AS blockers, CASE WHEN limited THEN 'UNKNOWN' ELSE first_status END AS status FROM bc)"""
_V = f"WITH RECURSIVE {_FACTS}"
_REASONS = f"""array_to_string([CASE WHEN suppressed THEN 'suppressed: ' || suppression ELSE 'not-suppressed' END, CASE WHEN name = '<clinit>' THEN 'clinit' END, CASE WHEN is_public_api THEN 'public-api-surface' ELSE 'not-public-api' END,
  CASE eligibility WHEN 'OBSERVABLE' THEN 'dynamically-observable' WHEN 'DE_INSTRUMENTED' THEN 'de-instrumented' ELSE 'not-dynamically-observable' END,
  CASE WHEN effective = 'NO_PROBE_INSTALLED' THEN 'no-probe-installed: index ' || idx WHEN eligibility = 'OBSERVABLE' AND installed THEN 'probe-installed' END, CASE WHEN short_circuitable THEN 'short-circuitable' ELSE 'not-short-circuitable' END,
  CASE WHEN observed THEN 'runtime-observed: last seen ' || last_seen ELSE 'runtime-unobserved' END, CASE WHEN class_loaded THEN 'class-loaded' ELSE 'class-never-loaded' END,
  CASE WHEN static_reachable THEN 'static-reachable' WHEN NOT static_reachable THEN 'static-unreachable' ELSE 'static-unresolved' END,
  CASE WHEN inbound_edges > 0 THEN 'runtime-edge-observed: ' || inbound_edges || ' edges, ' || inbound_observations || ' observations at ' || CASE WHEN sample_rate IS NULL THEN 'no declared rate' ELSE '1 in ' || sample_rate END WHEN edges_reported THEN 'runtime-edge-absent' END,
  CASE WHEN usable_windows = 0 THEN 'no-usable-window' ELSE 'usable-windows: ' || usable_windows END, CASE WHEN excluded_windows > 0 THEN 'windows-excluded: ' || excluded_windows END,
  CASE WHEN phases_missing <> '' THEN 'phases-missing: ' || phases_missing ELSE 'phases-complete: ' || phases_covered END, CASE WHEN window_days < {MIN_DAYS} THEN 'window-too-short: ' || window_days || ' of {MIN_DAYS} days' END,
  CASE WHEN disabled_key IS NOT NULL THEN 'rule-class-disabled: ' || disabled_key END, CASE WHEN limited THEN 'rate-limited: {CAP} new proposals a day' END, CASE WHEN status = 'DEAD_CANDIDATE' THEN 'DEAD_CANDIDATE' END], ' | ')"""


@query("G7", f"{_V} SELECT ref, eligibility, installed, effective FROM fb")
def g7(spark, sf):
    return _facts(spark, sf).select("ref", "eligibility", "installed", verdict.effective_eligibility(F.col("eligibility"), F.col("installed")).alias("effective"))


_PLAIN = (
    "ref", "build", "cls", "name", "desc", "is_public_api", "short_circuitable", "eligibility", "observed", "first_seen", "last_seen", "installed", "mask_reported", "class_loaded", "static_reachable",
    "suppression", "entry_kind", "inbound_edges", "outbound_edges", "inbound_observations", "sample_rate", "edges_reported", "usable_windows", "excluded_windows", "window_days", "disabled_key", "first_proposed", "revoked_reason",
)


@query("G8", f"""{_V} SELECT {', '.join(f'"{c}"' for c in _PLAIN)}, idx::BIGINT AS idx, phases_covered, phases_missing FROM fc""")
def g8(spark, sf):
    lists = [F.array_join(c, ", ").alias(c) for c in ("phases_covered", "phases_missing")]
    return _facts(spark, sf).select(*_PLAIN, F.col("idx").cast("long").alias("idx"), *lists)


@query("G9", f"{_V} SELECT ref, status, array_to_string(blockers, ',') AS blockers, {_REASONS} AS reasons FROM ve")
def g9(spark, sf):
    return _verdicts(spark, sf).select("ref", "status", F.array_join("blockers", ",").alias("blockers"), F.array_join("reasons", " | ").alias("reasons"))


@query(
    "G10",
    f"""{_V} SELECT ref, [x FOR x IN string_split({_REASONS}, ' | ') IF string_split(x, ':')[1] IN ('suppressed', 'clinit', 'public-api-surface', 'not-dynamically-observable', 'de-instrumented', 'no-probe-installed', 'short-circuitable',
  'class-never-loaded', 'static-reachable', 'static-unresolved', 'no-usable-window', 'phases-missing', 'window-too-short', 'rule-class-disabled', 'rate-limited', 'runtime-observed', 'runtime-edge-observed')][1] AS blocking FROM ve""",
)
def g10(spark, sf):
    return _verdicts(spark, sf).select("ref", verdict.first_blocking(F.col("reasons")).alias("blocking"))


_ORDERED = 'row_number() OVER (PARTITION BY artifact ORDER BY cls, name, "desc") AS place'


@query("G11", f"""{_V} SELECT artifact, cls, name, "desc", status, {_ORDERED} FROM ve""")
def g11(spark, sf):
    return graph.placed(_verdicts(spark, sf).select("artifact", "cls", "name", "desc", "status"), ["artifact"], ["cls", "name", "desc"])


@query("J5", f"{_V} SELECT ref, unnest(['entrypoint:' || entry_kind, 'eligibility:' || effective]) AS rule_key FROM fc")
def j5(spark, sf):
    return _facts(spark, sf).select("ref", F.explode("rule_keys").alias("rule_key"))


@query("J7", f"{_V} SELECT ref, disabled_key FROM fc")
def j7(spark, sf):
    return _facts(spark, sf).select("ref", "disabled_key")


@query("K1", f"{_V} SELECT ref, status FROM ve WHERE cls = 'p.Brand#2.ECONOMY'")
def k1(spark, sf):
    return verdict.by_class(_verdicts(spark, sf), "p.Brand#2.ECONOMY").select("ref", "status")


@query("K2", f"{_V} SELECT ref, status FROM ve WHERE starts_with(cls, 'p.Brand#2.')")
def k2(spark, sf):
    return verdict.by_package(_verdicts(spark, sf), "p.Brand#2").select("ref", "status")


@query("K3", f"{_V} SELECT ref, status FROM ve WHERE split_part(cls, '.', 3) = 'ECONOMY'")
def k3(spark, sf):
    at = F.concat(F.lit("src/"), "artifact", F.lit("/"), F.split_part("cls", F.lit("."), F.lit(3)), F.lit(".java"))
    return verdict.by_file(_verdicts(spark, sf), d.methods(spark, sf).select("cls", at.alias("source_file")).distinct(), "ECONOMY.java").select("ref", "status")


@query("K4", f"""{_V}, c AS (SELECT artifact, cls, name, "desc", window_days, usable_windows, first_proposed, {_ORDERED} FROM ve WHERE status = 'DEAD_CANDIDATE'),
n AS (SELECT artifact, count(*) FILTER (effective = 'NO_PROBE_INSTALLED') AS never_instrumented FROM ve GROUP BY ALL) SELECT c.*, never_instrumented FROM c JOIN n USING (artifact) WHERE place <= 20""")
def k4(spark, sf):
    return verdict.candidates(_verdicts(spark, sf), 20)


@query(
    "K5",
    f"""{_V}, s AS (SELECT artifact, count(*) FILTER (status = 'LIVE') AS live, count(*) FILTER (status = 'UNKNOWN') AS unknown, count(*) FILTER (status = 'NOT_DYNAMICALLY_OBSERVABLE') AS not_observable,
  count(*) FILTER (status = 'DEAD_CANDIDATE') AS candidates, count(*) FILTER (effective = 'NO_PROBE_INSTALLED') AS never_instrumented, count(*) FILTER (inbound_edges > 0) AS entered, count(*) FILTER (outbound_edges > 0) AS left,
  count(DISTINCT cls) FILTER (mask_reported) AS classes_with_mask, max(window_days) AS window_days, max(usable_windows) AS usable_windows, max(excluded_windows) AS excluded_windows, max(phases_covered) AS phases_covered,
  max(phases_missing) AS phases_missing, bool_or(edges_reported) AS edges_reported FROM ve GROUP BY artifact)
SELECT s.*, coalesce(np, 0) AS non_production, coalesce(dg, 0) AS degraded, coalesce(tt, 0) AS test_tainted, CASE WHEN w.build IS NULL THEN 'no window was stored' WHEN usable_windows = 0 THEN 'no window is evidence of death' WHEN np > 0 THEN 'some windows are not of production' ELSE 'all windows are of production' END AS note
FROM s LEFT JOIN (SELECT build, count(*) FILTER (environment IS DISTINCT FROM 'production') AS np, count(*) FILTER (degraded) AS dg, count(*) FILTER (tainted) AS tt FROM sw GROUP BY build) w ON w.build = artifact""",
)
def k5(spark, sf):
    return verdict.run_summary(_verdicts(spark, sf), store.windows(spark, sf))


_GAPS = """g AS (SELECT artifact, cls, count(*) FILTER (effective = 'NO_PROBE_INSTALLED') AS never_instrumented, count(*) FILTER (effective = 'NOT_DYNAMICALLY_OBSERVABLE') AS not_observable, count(*) FILTER (effective = 'DE_INSTRUMENTED') AS de_instrumented,
  count(*) FILTER (effective = 'OBSERVABLE') AS observable, bool_or(mask_reported) AS mask_reported, coalesce(string_agg(name || "desc", ' ' ORDER BY name, "desc") FILTER (effective = 'NO_PROBE_INSTALLED'), '') AS methods FROM ve GROUP BY ALL)"""


@query(
    "K6",
    f"""{_V}, {_GAPS} SELECT *, CASE WHEN NOT mask_reported THEN 'no mask was reported' WHEN never_instrumented = 0 THEN 'all observable methods have probes' WHEN observable = 0 THEN 'no probe of the class is installed' ELSE 'some probes are missing' END AS diagnosis,
  row_number() OVER (PARTITION BY artifact ORDER BY never_instrumented DESC, cls) AS place FROM g""",
)
def k6(spark, sf):
    return verdict.instrumentation_gaps(_verdicts(spark, sf))


@query(
    "K9",
    f"""{_V.replace(store.GRAPH, store.WHOLE_GRAPH)}, r AS (SELECT ed.*, caller.status, caller.name || caller."desc" AS caller, row_number() OVER (PARTITION BY ed.build, ed.callee_cls, ed.callee_idx ORDER BY n DESC, caller_cls, caller_idx) AS place FROM ed
  JOIN im me2 ON me2.build = ed.build AND me2.cls = ed.callee_cls AND me2.idx = ed.callee_idx LEFT JOIN ve caller ON caller.build = ed.build AND caller.cls = ed.caller_cls AND caller.idx = ed.caller_idx),
g AS (SELECT build, callee_cls, callee_idx, count(*) AS callers, sum(n)::BIGINT AS observations, coalesce(bool_or(status = 'LIVE'), false) AS any_live, string_agg(coalesce(caller, '?') || '=' || coalesce(status, 'not in the inventory'), ' ' ORDER BY n DESC, caller_cls, caller_idx) FILTER (place <= 2) AS shown FROM r GROUP BY ALL)
SELECT g.*, callers > 2 AS cut, target.status, CASE WHEN any_live THEN 'live callers enter it: a change reaches them' ELSE 'no live caller was seen, which proves nothing' END AS guidance FROM g JOIN ve target ON target.build = g.build AND target.cls = callee_cls AND target.idx = callee_idx""",
)
def k9(spark, sf):
    return verdict.blast_radius(_verdicts(spark, sf, store.call_edges), facts.edges_of_evidence(store.edges(spark, sf), store.windows(spark, sf)), 2)


@query(
    "K13",
    f"""{_V}, w AS (SELECT build, instance, day AS start, end_day AS stop, CAST(end_day - day AS INTEGER) AS days, CASE WHEN environment IS DISTINCT FROM 'production' THEN 'not of production: ' || coalesce(environment, 'unclassified') WHEN tainted THEN 'test code was running'
  WHEN degraded THEN 'degraded: shows life only' ELSE '' END AS why FROM sw)
SELECT w.*, why = '' AS usable, coalesce(window_days, 0) AS window_days, coalesce(covered, '') AS phases_covered, coalesce(missing, '') AS phases_missing FROM w LEFT JOIN sn USING (build) LEFT JOIN pp USING (build)""",
)
def k13(spark, sf):
    w = store.windows(spark, sf)
    return verdict.windows_listed(w, facts.by_build(w, admission.evidence_only(store.edges(spark, sf), w), CALENDAR))


@query(
    "K10",
    f"""{_V}, x AS (SELECT build, caller_cls, caller_idx, callee_cls, callee_idx, sum(observations)::BIGINT AS observations, count(*) AS windows, min(rate) AS lo, max(rate) AS hi FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY build ORDER BY observations DESC, caller_cls, caller_idx, callee_cls, callee_idx) AS place, CASE WHEN lo = hi THEN lo END AS uniform_rate FROM x)
SELECT r.build, place, caller_cls, a.name || a."desc" AS caller, callee_cls, b.name || b."desc" AS callee, observations, windows, uniform_rate, observations * uniform_rate AS estimated_calls FROM r
LEFT JOIN im a ON a.build = r.build AND a.cls = caller_cls AND a.idx = caller_idx LEFT JOIN im b ON b.build = r.build AND b.cls = callee_cls AND b.idx = callee_idx WHERE place <= 10""",
)
def k10(spark, sf):
    return verdict.hot_paths(facts.edges_of_evidence(store.edges(spark, sf), store.windows(spark, sf)), store.inventory(spark, sf), 10)
