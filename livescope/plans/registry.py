"""Every registered query with its DuckDB oracle, by operator number."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.buckets import bucket_high, bucket_index, bucket_low
from ..functions.names import denied_name, test_markers
from ..functions.redaction import denied_number, denied_text, mask_path
from ..operators import admission, coverage, edges, graph, inventory, ledger, phases, profile, traces, verdict
from ..sources import derived as d
from ..sources import sinks, windows
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
M = profile.METHOD


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_BUCKET = "least(CASE WHEN nanos < 32 THEN greatest(nanos, 0) ELSE (length(bin(nanos)) - 4) * 16 + ((nanos >> (length(bin(nanos)) - 5)) & 15) END, 1023)"
_LOW = "CASE WHEN {0} < 32 THEN {0} ELSE (16 + {0} % 16) << ({0} // 16 - 1) END"
_HIST = f"{d.CALL_EVENTS}, hi AS (SELECT build, cls, idx, CAST({_BUCKET} AS BIGINT) AS bucket, count(*) AS n FROM ce WHERE timed GROUP BY ALL)"
_PCT = f"""{_HIST}, ru AS (
  SELECT *, sum(n) OVER (PARTITION BY build, cls, idx ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY build, cls, idx) AS total,
    CAST({_LOW.format('(bucket + 1)')} AS BIGINT) - 1 AS high FROM hi),
pc AS (SELECT build, cls, idx, min(high) FILTER (upto >= greatest(ceil(50.0 / 100 * total), 1)) AS p50, min(high) FILTER (upto >= greatest(ceil(90.0 / 100 * total), 1)) AS p90,
  min(high) FILTER (upto >= greatest(ceil(99.0 / 100 * total), 1)) AS p99 FROM ru GROUP BY ALL)"""


# ---- D: timing profiles


@query("D1", f"WITH {d.CALL_EVENTS} SELECT event_id, CAST({_BUCKET} AS INTEGER) AS bucket FROM ce")
def d1(spark, sf):
    return d.call_events(spark, sf).select("event_id", bucket_index(F.col("nanos")).alias("bucket"))


@query("D2", f"WITH {_HIST} SELECT DISTINCT bucket, CAST({_LOW.format('bucket')} AS BIGINT) AS low, CAST({_LOW.format('(bucket + 1)')} AS BIGINT) AS high FROM hi")
def d2(spark, sf):
    b = d.call_events(spark, sf).where("timed").select(bucket_index(F.col("nanos")).cast("long").alias("bucket")).distinct()
    return b.select("bucket", bucket_low(F.col("bucket")).alias("low"), bucket_high(F.col("bucket")).alias("high"))


@query("D3", f"WITH {_HIST} SELECT * FROM hi")
def d3(spark, sf):
    return profile.histograms(d.call_events(spark, sf), *M).withColumn("bucket", F.col("bucket").cast("long"))


@query("D4", f"WITH {_PCT} SELECT build, cls, idx, p50 FROM pc")
def d4(spark, sf):
    return profile.percentiles(profile.histograms(d.call_events(spark, sf), *M), *M).select(*M, "p50")


@query("D5", f"WITH {_PCT} SELECT * FROM pc")
def d5(spark, sf):
    return profile.percentiles(profile.histograms(d.call_events(spark, sf), *M), *M)


_TOTALS = "count(*) AS calls, count(*) FILTER (err) AS errors, count(*) FILTER (timed) AS timed_calls"


@query("D6", f"WITH {d.CALL_EVENTS} SELECT build, cls, idx, {_TOTALS} FROM ce GROUP BY ALL")
def d6(spark, sf):
    return profile.roll_up(d.call_events(spark, sf), *M)


_NAMES = "array_to_string(list_sort(list_distinct(list(err_name))), '+') AS names"


@query("D7", f"WITH {d.CALL_EVENTS} SELECT build, cls, idx, count(*) AS errors, count(err_name) AS attributed, count(*) - count(err_name) AS unattributed, {_NAMES} FROM ce WHERE err GROUP BY ALL")
def d7(spark, sf):
    return profile.error_report(d.call_events(spark, sf), *M)


@query("D8", f"WITH {d.CALL_EVENTS} SELECT * FROM (SELECT build, err_name, count(*) AS n, row_number() OVER (PARTITION BY build ORDER BY count(*) DESC, err_name) AS place FROM ce WHERE err GROUP BY build, err_name) WHERE place <= 3")
def d8(spark, sf):
    return profile.top_error_classes(d.call_events(spark, sf), 3)


@query("D9", f"WITH {d.CALL_EVENTS} SELECT build, instance, date_trunc('minute', ts) AS minute, cls, idx, {_TOTALS} FROM ce GROUP BY ALL")
def d9(spark, sf):
    e = d.call_events(spark, sf).withColumn("minute", F.window("ts", "60 seconds").start)
    return profile.roll_up(e, "build", "instance", "minute", "cls", "idx")


@query(
    "D10",
    f"""WITH {d.CALL_EVENTS}, f AS (SELECT build, instance, day, err_name, min(event_id) AS first_id, count(*) AS n FROM ce WHERE err GROUP BY ALL)
SELECT build, instance, day, row_number() OVER (PARTITION BY build, instance, day ORDER BY first_id) AS error_id, err_name, n FROM f""",
)
def d10(spark, sf):
    return profile.assign_error_ids(d.call_events(spark, sf), "build", "instance", "day")


@query("D11", f"WITH {d.CALL_EVENTS} SELECT build, day, {_TOTALS}, round(count(*) FILTER (timed) / count(*), 4) AS fraction FROM ce GROUP BY ALL")
def d11(spark, sf):
    return profile.timed_fraction(d.call_events(spark, sf), "build", "day")


@query("D12", f"WITH {d.CALL_EVENTS} SELECT build, day, cls, {_TOTALS}, round(count(*) / 86400, 4) AS per_second, round(count(*) FILTER (err) / count(*), 4) AS error_rate FROM ce GROUP BY ALL")
def d12(spark, sf):
    return profile.method_rates(d.call_events(spark, sf), "build", "day", "cls")


@query(
    "K7",
    f"""WITH {_PCT}, t AS (SELECT build, cls, idx, {_TOTALS} FROM ce GROUP BY ALL ORDER BY calls DESC, build, cls, idx LIMIT 20),
e AS (SELECT build, cls, idx, {_NAMES} FROM ce WHERE err GROUP BY ALL)
SELECT t.*, p50, p90, p99, names FROM t LEFT JOIN pc USING (build, cls, idx) LEFT JOIN e USING (build, cls, idx)""",
)
def k7(spark, sf):
    return profile.hot_methods(d.call_events(spark, sf), 20)


@query("K12", f"WITH {d.CALL_EVENTS} SELECT build, err_name, count(*) AS n FROM ce WHERE err GROUP BY ALL")
def k12(spark, sf):
    return profile.error_classes(d.call_events(spark, sf), "build")


# ---- B, H6: admission


@query("B6", f"WITH {d.WINDOWS} SELECT build, instance, day, lower(environment) AS label, coalesce(environment IN ('production', 'prod'), false) AS production FROM wi")
def b6(spark, sf):
    label, production = admission.classify_environment([F.lit(" "), F.col("environment")])
    return d.windows(spark, sf).select("build", "instance", "day", label.alias("label"), production.alias("production"))


@query(
    "B7",
    f"""WITH {d.WINDOWS} SELECT build, instance, day,
  coalesce(environment = 'production', false) AND (CASE day(day) % 3 WHEN 0 THEN false WHEN 1 THEN true END) IS DISTINCT FROM false AS evidence FROM wi""",
)
def b7(spark, sf):
    _, production = admission.classify_environment([F.col("environment")])
    said = F.when(F.dayofmonth("day") % 3 == 0, False).when(F.dayofmonth("day") % 3 == 1, True)
    return d.windows(spark, sf).select("build", "instance", "day", admission.evidence_flag(production, said).alias("evidence"))


_LIFE = "coalesce(environment = 'production', false)"


@query("B19", f"WITH {d.COVERAGE} SELECT build, count(*) AS bits, count(DISTINCT (instance, day, cls)) AS records, count(DISTINCT cls) AS classes FROM cb SEMI JOIN (SELECT * FROM wi WHERE NOT {_LIFE}) w USING (build, instance, day) GROUP BY build")
def b19(spark, sf):
    return admission.withheld(d.coverage_bits(spark, sf), d.windows(spark, sf))


@query("B20", f"WITH {d.WINDOWS} SELECT build, instance, day, {_LIFE} AS life, {_LIFE} AND NOT degraded AS death FROM wi")
def b20(spark, sf):
    return admission.usable(d.windows(spark, sf)).select("build", "instance", "day", "life", "death")


@query(
    "H6",
    f"""WITH {d.WINDOWS} SELECT build, coalesce(environment, 'unclassified') AS environment, count(*) FILTER ({_LIFE} AND NOT degraded) AS usable,
  count(*) FILTER ({_LIFE} AND degraded) AS excluded, count(*) FILTER (NOT {_LIFE}) AS withheld FROM wi GROUP BY ALL""",
)
def h6(spark, sf):
    return admission.evidence_split(d.windows(spark, sf))


# ---- C: coverage


@query("C2", f"WITH {d.COVERAGE}, o AS (SELECT build, cls, sum(1 << idx) AS octet FROM (SELECT DISTINCT build, cls, idx FROM cb) GROUP BY ALL) SELECT build, cls, lpad(to_hex(octet::BIGINT), 2, '0') AS octets FROM o")
def c2(spark, sf):
    return coverage.pack_bits(d.coverage_bits(spark, sf), ["build", "cls"])


@query("C1", f"WITH {d.COVERAGE} SELECT DISTINCT build, cls, CAST(idx AS INTEGER) AS idx FROM cb")
def c1(spark, sf):
    packed = coverage.pack_bits(d.coverage_bits(spark, sf), ["build", "cls"])
    return coverage.explode_bits(packed.select("build", "cls", F.unhex("octets").alias("probes")))


_SEEN = "CAST(min(day) + 1 AS DATE) AS first_seen, CAST(max(day) + 1 AS DATE) AS last_seen"


_GATED = f"{d.COVERAGE}, ev AS (SELECT cb.* FROM cb SEMI JOIN (SELECT * FROM wi WHERE {_LIFE}) w USING (build, instance, day))"


def _evidence(spark, sf, rows):
    """Only what windows with evidence bring: the gate before every merge."""
    return admission.evidence_only(rows, d.windows(spark, sf))


@query("C3", f"WITH {_GATED} SELECT build, cls, idx, {_SEEN}, count(*) AS windows FROM ev GROUP BY ALL")
def c3(spark, sf):
    return coverage.merge_bits(_evidence(spark, sf, d.coverage_bits(spark, sf)))


@query("C4", f"WITH {d.MASKS}, e AS (SELECT cb.* FROM cb SEMI JOIN (SELECT * FROM wi WHERE {_LIFE} AND NOT degraded) w USING (build, instance, day)) SELECT DISTINCT build, cls, idx FROM ib ANTI JOIN e USING (build, cls, idx)")
def c4(spark, sf):
    return coverage.death_evidence(d.install_bits(spark, sf), admission.evidence_only(d.coverage_bits(spark, sf), d.windows(spark, sf), "death"))


@query("C6", f"WITH {d.COVERAGE} SELECT build, cls, count(DISTINCT idx) AS set_bits FROM cb GROUP BY ALL")
def c6(spark, sf):
    return coverage.popcounts(d.coverage_bits(spark, sf))


@query(
    "C7",
    f"""WITH {d.COVERAGE}, f AS (SELECT instance, build, day, row_number() OVER (PARTITION BY build, cls, idx ORDER BY day, instance) AS r FROM cb)
SELECT build, instance, day, count(*) AS new_bits FROM f WHERE r = 1 GROUP BY ALL""",
)
def c7(spark, sf):
    return coverage.newly_set(d.coverage_bits(spark, sf))


@query("C9", f"WITH {_GATED} SELECT build, cls, min(day) AS first_day, max(day) AS last_day, count(DISTINCT idx) AS bits, count(DISTINCT day) AS days FROM ev GROUP BY ALL")
def c9(spark, sf):
    return coverage.seen_classes(_evidence(spark, sf, d.coverage_bits(spark, sf)))


@query("C10", f"WITH {d.MASKS} SELECT build, cls, count(*) AS windows, min(day) AS first_day, max(day) AS last_day FROM (SELECT DISTINCT build, cls, instance, day FROM ib) GROUP BY ALL")
def c10(spark, sf):
    return coverage.merge_masks(d.install_bits(spark, sf))[1]


@query(
    "C11",
    f"""WITH {d.MASKS}, k AS (SELECT DISTINCT build, cls, idx FROM cb), r AS (SELECT DISTINCT build, cls FROM ib), b AS (SELECT DISTINCT build, cls, idx, true AS bit FROM ib)
SELECT k.*, CASE WHEN r.cls IS NOT NULL THEN bit IS NOT NULL END AS installed FROM k LEFT JOIN r USING (build, cls) LEFT JOIN b USING (build, cls, idx)""",
)
def c11(spark, sf):
    keys = d.coverage_bits(spark, sf).select("build", "cls", "idx").distinct()
    return coverage.installed_state(keys, d.install_bits(spark, sf))


@query("C12", f"WITH {d.MASKS} SELECT build, count(DISTINCT cls) AS classes, count(DISTINCT (cls, idx)) AS indices FROM ib GROUP BY ALL")
def c12(spark, sf):
    return coverage.mask_totals(d.install_bits(spark, sf))


@query(
    "C13",
    f"""WITH {d.MASKS} SELECT build, cls, count(*) AS bits FROM cb WHERE cls <> 'app.view'
  AND NOT EXISTS (SELECT 1 FROM ib WHERE ib.build = cb.build AND ib.instance = cb.instance AND ib.day = cb.day AND ib.cls = cb.cls AND ib.idx = cb.idx) GROUP BY ALL""",
)
def c13(spark, sf):
    return coverage.inconsistent(d.coverage_bits(spark, sf), d.install_bits(spark, sf))


@query("C14", f"WITH {_GATED} SELECT build, cls, {_SEEN}, count(*) AS load_windows FROM (SELECT DISTINCT build, instance, day, cls FROM ev) GROUP BY ALL")
def c14(spark, sf):
    return coverage.loaded_classes(_evidence(spark, sf, d.call_events(spark, sf)))


@query(
    "C15",
    f"""WITH {d.COVERAGE}, f AS (SELECT build, instance, cls, day, row_number() OVER (PARTITION BY build, instance, cls, idx ORDER BY day) = 1 AS new FROM cb)
SELECT build, instance, cls, day, bool_or(new) AS changed FROM f GROUP BY ALL""",
)
def c15(spark, sf):
    return coverage.changed_since(d.coverage_bits(spark, sf))


@query(
    "C16",
    f"""WITH {d.MASKS}, k AS (SELECT DISTINCT build, cls, idx FROM cb SEMI JOIN (SELECT * FROM wi WHERE {_LIFE}) w USING (build, instance, day)), b AS (SELECT DISTINCT build, cls, idx FROM ib)
SELECT b.build, b.cls, bool_and(k.idx IS NOT NULL) AS fully_covered FROM b LEFT JOIN k USING (build, cls, idx) GROUP BY ALL""",
)
def c16(spark, sf):
    return coverage.fully_covered(d.install_bits(spark, sf), _evidence(spark, sf, d.coverage_bits(spark, sf)))


@query("C17", f"WITH {d.COVERAGE} SELECT DISTINCT build, cls FROM cb")
def c17(spark, sf):
    return d.coverage_bits(spark, sf).select("build", "cls").distinct()


@query(
    "M1",
    f"""WITH {d.COVERAGE}, a AS (SELECT DISTINCT build, cls, idx FROM cb), b AS (SELECT * FROM a WHERE (idx + length(cls)) % 6 <> 0)
SELECT a.build, count(*) AS compared, count(*) FILTER (b.idx IS NULL) AS disagreements FROM a LEFT JOIN b USING (build, cls, idx) GROUP BY ALL""",
)
def m1(spark, sf):
    a = d.coverage_bits(spark, sf).select("build", "cls", "idx").distinct()
    b = a.where((F.col("idx") + F.length("cls")) % 6 != 0).withColumn("hit", F.lit(True))
    return a.join(b, ["build", "cls", "idx"], "left").groupBy("build").agg(F.count("*").alias("compared"), F.count_if(F.col("hit").isNull()).alias("disagreements"))


# ---- E: sampled edges

_AGG = f"""{d.EDGES}, ea AS (
  SELECT build, caller_cls, caller_idx, callee_cls, callee_idx, CAST(sum(observations) AS BIGINT) AS observations, count(*) AS windows, min(day) AS first_day, max(day) AS last_day,
    min(rate) AS min_rate, max(rate) AS max_rate FROM we GROUP BY ALL)"""


@query("E1", f"WITH {_AGG} SELECT * FROM ea")
def e1(spark, sf):
    return edges.edge_agg(d.window_edges(spark, sf))


@query("E2", f"WITH {d.EDGES} SELECT build, rate, count(DISTINCT day) AS windows FROM we GROUP BY ALL")
def e2(spark, sf):
    return edges.sample_rates(d.window_edges(spark, sf))


@query("E3", f"WITH {_AGG} SELECT * FROM ea WHERE callee_cls = 'p7'")
def e3(spark, sf):
    return edges.callers_of(edges.edge_agg(d.window_edges(spark, sf)), "p7")


@query("E4", f"WITH {_AGG} SELECT * FROM ea WHERE caller_cls = 's3'")
def e4(spark, sf):
    return edges.callees_of(edges.edge_agg(d.window_edges(spark, sf)), "s3")


_HOT = "row_number() OVER (PARTITION BY build ORDER BY observations DESC, caller_cls, caller_idx, callee_cls, callee_idx) AS place"


@query("E5", f"WITH {_AGG} SELECT * FROM (SELECT *, {_HOT} FROM ea) WHERE place <= 10")
def e5(spark, sf):
    return edges.hot_edges(edges.edge_agg(d.window_edges(spark, sf)), 10)


@query("E6", f"WITH {_AGG} SELECT DISTINCT build, caller_cls AS cls, caller_idx AS idx, 'outbound' AS side FROM ea UNION SELECT DISTINCT build, callee_cls, callee_idx, 'inbound' FROM ea")
def e6(spark, sf):
    return edges.endpoints(edges.edge_agg(d.window_edges(spark, sf)))


@query(
    "E7",
    f"""WITH {_AGG} SELECT build, callee_cls, callee_idx, count(*) AS edges, CAST(sum(observations) AS BIGINT) AS observations, min(nullif(min_rate, 0)) AS min_rate, max(max_rate) AS max_rate,
  min(first_day) AS first_day, max(last_day) AS last_day FROM ea GROUP BY ALL""",
)
def e7(spark, sf):
    return edges.evidence(edges.edge_agg(d.window_edges(spark, sf)))


_UNIFORM = "CASE WHEN min_rate > 0 AND min_rate = max_rate THEN min_rate END"


@query("E8", f"WITH {_AGG} SELECT *, {_UNIFORM} AS uniform_rate, observations * ({_UNIFORM}) AS estimated_calls FROM ea")
def e8(spark, sf):
    return edges.estimate(edges.edge_agg(d.window_edges(spark, sf)))


@query("E9", f"WITH {d.EDGES} SELECT * FROM we")
def e9(spark, sf):
    return d.window_edges(spark, sf)


@query(
    "E12",
    """WITH f AS (SELECT l_linestatus AS build, 'pod-' || (l_linenumber % 3) AS instance, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, 's' || (l_suppkey % 20) AS caller_cls, l_suppkey AS caller_idx, 'p' || (l_partkey % 50) AS callee_cls,
  l_partkey AS callee_idx, CAST(sum(l_quantity) AS BIGINT) AS observations FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY build, instance, day ORDER BY caller_cls, caller_idx, callee_cls, callee_idx) AS place FROM f)
SELECT build, instance, day, count(*) FILTER (place <= 24) AS kept_edges, CAST(coalesce(sum(observations) FILTER (place > 24), 0) AS BIGINT) AS refused FROM p GROUP BY ALL""",
)
def e12(spark, sf):
    return edges.cap_distinct(d.instance_edges(spark, sf), 24)


@query(
    "K20",
    f"""WITH {_AGG} SELECT build, caller_cls, callee_cls, CAST(sum(observations) AS BIGINT) AS observations, count(*) AS edges, min(min_rate) <> max(max_rate) AS mixed,
  count(*) FILTER (caller_cls = callee_cls) AS inside FROM ea GROUP BY ALL""",
)
def k20(spark, sf):
    return edges.class_edges(edges.edge_agg(d.window_edges(spark, sf)))


# ---- F, I: inventory


@query("F2", f'WITH {d.METHODS} SELECT cls, name, "desc", row_number() OVER (PARTITION BY cls ORDER BY name, "desc") - 1 AS idx FROM me')
def f2(spark, sf):
    return inventory.assign_probe_index(d.methods(spark, sf)).select("cls", "name", "desc", F.col("idx").cast("long").alias("idx"))


@query("F3", f"""WITH {d.METHODS} SELECT cls, sha256(string_agg(name || "desc" || chr(10), '' ORDER BY name, "desc")) AS schema_hash, count(*) AS probe_count FROM me GROUP BY cls""")
def f3(spark, sf):
    return inventory.schema_hash(d.methods(spark, sf))


_RULES = [("p.Brand#1*", "*", "*"), ("*", "m1?", "*"), ("*.ECONOMY", "m[2-4]*", "*"), ("*", "*", "()[L*;"), ("*", "m*7", "(*7)V")]


@query(
    "I2",
    f"""WITH {d.METHODS} SELECT cls, name, "desc", CASE WHEN starts_with(cls, 'p.Brand#1') THEN 0 WHEN regexp_full_match(name, 'm1.') THEN 1
  WHEN ends_with(cls, '.ECONOMY') AND regexp_full_match(name, 'm[2-4].*') THEN 2 WHEN name LIKE 'm%7' AND "desc" LIKE '(%7)V' THEN 4 END AS rule_no FROM me""",
)
def i2(spark, sf):
    return inventory.match_rules(d.methods(spark, sf), _RULES).select("cls", "name", "desc", "rule_no")


@query("K14", f"SELECT coalesce(rule_no, -1) AS rule_no, count(*) AS methods FROM ({SQL['I2']}) GROUP BY ALL")
def k14(spark, sf):
    return inventory.match_rules(d.methods(spark, sf), _RULES).groupBy(F.coalesce("rule_no", F.lit(-1)).alias("rule_no")).agg(F.count("*").alias("methods"))


# ---- J: ledger


def _feedback(spark, sf):
    o = d.read(spark, sf, "orders").withColumn("rule_key", F.concat(F.lit("entrypoint:"), "o_orderpriority"))
    kinds = F.array(F.lit("report"), F.when(F.col("o_orderstatus") == "F", "actioned").when(F.col("o_orderstatus") == "O", "not_useful"))
    return o.select("rule_key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


@query(
    "J6",
    """WITH s AS (SELECT 'entrypoint:' || o_orderpriority AS rule_key, count(*) AS reports, count(*) FILTER (o_orderstatus = 'F') AS actioned, count(*) FILTER (o_orderstatus = 'O') AS not_useful FROM orders GROUP BY ALL)
SELECT *, round(not_useful / nullif(actioned + not_useful, 0), 4) AS rate, CASE WHEN actioned + not_useful < 10 THEN 'ACTIVE' WHEN not_useful / (actioned + not_useful) >= 0.25 THEN 'DISABLED'
  WHEN not_useful / (actioned + not_useful) >= 0.1 THEN 'PROBATION' ELSE 'ACTIVE' END AS status FROM s""",
)
def j6(spark, sf):
    return ledger.feedback_stats(_feedback(spark, sf))


@query(
    "K16",
    f"""WITH j AS ({SQL['J6']}), f(rule_key, state) AS (VALUES ('entrypoint:1-URGENT', 'ACTIVE'), ('entrypoint:3-MEDIUM', NULL), ('entrypoint:retired', 'DISABLED'))
SELECT rule_key, coalesce(reports, 0) AS reports, coalesce(actioned, 0) AS actioned, coalesce(not_useful, 0) AS not_useful, rate, coalesce(state, status, 'ACTIVE') AS status FROM j FULL JOIN f USING (rule_key)""",
)
def k16(spark, sf):
    """With states that a person has forced: one that rates would disable, one taken back, one of a rule without reports."""
    rows = [("entrypoint:1-URGENT", "ACTIVE"), ("entrypoint:3-MEDIUM", None), ("entrypoint:retired", "DISABLED")]
    return ledger.feedback_stats(_feedback(spark, sf), spark.createDataFrame(rows, "rule_key string, state string"))


@query(
    "J2",
    f"""WITH {d.METHODS}, n AS (SELECT p_partkey FROM me WHERE NOT is_public_api), b AS (SELECT p_partkey FROM me WHERE p_partkey % 3 <> 0)
SELECT p_partkey, CASE WHEN n.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN 'confirmed' WHEN n.p_partkey IS NOT NULL THEN 'opened' ELSE 'revoked' END AS state FROM n FULL JOIN b USING (p_partkey)""",
)
def j2(spark, sf):
    m = d.methods(spark, sf)
    return ledger.reconcile(m.where("not is_public_api"), m.where("p_partkey % 3 <> 0"), ["p_partkey"])


@query("J8", f"SELECT state, count(*) AS n FROM ({SQL['J2']}) GROUP BY ALL")
def j8(spark, sf):
    return j2(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


# ---- K: reports over the inventory


@query(
    "K19",
    f"""WITH {d.METHODS} SELECT coalesce(artifact, '') AS artifact, coalesce(cls, '') AS cls, count(*) AS methods, count(*) FILTER (observable) AS observable FROM me GROUP BY ROLLUP (artifact, cls)""",
)
def k19(spark, sf):
    r = d.methods(spark, sf).rollup("artifact", "cls").agg(F.count("*").alias("methods"), F.count_if("observable").alias("observable"))
    return r.select(F.coalesce("artifact", F.lit("")).alias("artifact"), F.coalesce("cls", F.lit("")).alias("cls"), "methods", "observable")


# ---- L: traces

_FRAMES = """fr AS (SELECT conv_id AS trace, turn AS ordinal, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role AS frame, length(text) AS size_in,
  length(text) - turn % 3 AS size_out, CASE WHEN turn % 5 = 4 THEN 'E' END AS threw FROM conversations)"""


def _frames(spark, sf):
    return traces.frames(d.read(spark, sf, "conversations"))


@query("L2", f"WITH {_FRAMES} SELECT trace, ordinal, frame, size_out - size_in AS delta FROM fr WHERE size_out <> size_in")
def l2(spark, sf):
    return traces.size_deltas(_frames(spark, sf))


@query("L3", f"WITH {_FRAMES} SELECT *, threw IS NULL AND size_in = size_out AS is_pass FROM fr")
def l3(spark, sf):
    return traces.pass_through(_frames(spark, sf))


@query("L8", f"WITH {_FRAMES} SELECT frame, coalesce(threw, 'none') AS threw, count(*) AS frames FROM fr GROUP BY ALL")
def l8(spark, sf):
    return traces.outcomes(_frames(spark, sf))


_URL = "regexp_replace(url, '^https?://[^/]*', '')"


@query(
    "L10",
    f"""SELECT page_id, array_to_string([CASE WHEN regexp_full_match(s, '[0-9]+') THEN '#' WHEN regexp_full_match(s, '[0-9a-fA-F-]{{16,}}') THEN '{{id}}' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END
  FOR s IN string_split(string_split({_URL}, '?')[1], '/')], '/') AS path FROM pages""",
)
def l10(spark, sf):
    return d.read(spark, sf, "pages").select("page_id", mask_path(F.regexp_replace("url", "^https?://[^/]*", "")).alias("path"))


@query(
    "L12",
    r"""SELECT doc_id, regexp_matches(text, '(?s)^[^@]+@.*\.') OR regexp_matches(text, '[0-9]{12,}') OR regexp_matches(text, '(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)')
  OR regexp_matches(text, '(^|[^A-Za-z0-9])[A-Z]{5}[0-9]{4}[A-Z]([^A-Za-z0-9]|$)') AS denied FROM documents""",
)
def l12(spark, sf):
    return d.read(spark, sf, "documents").select("doc_id", denied_text(F.col("text")).alias("denied"))


@query("L13", f"WITH {d.CALL_EVENTS} SELECT event_id, length(CAST(abs(nanos * 40) AS VARCHAR)) >= 12 OR (length(CAST(abs(nanos * 40) AS VARCHAR)) = 10 AND CAST(abs(nanos * 40) AS VARCHAR)[1] IN ('6', '7', '8', '9')) AS denied FROM ce")
def l13(spark, sf):
    return d.call_events(spark, sf).select("event_id", denied_number(F.col("nanos") * 40).alias("denied"))


# ---- B10, B24, L11, L7, L9, L17, H5, C5 and others over the given tables


@query(
    "L11",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'getPassword' WHEN 1 THEN 'is_' WHEN 2 THEN p_name WHEN 3 THEN 'userEmail' || p_partkey ELSE 'total' END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE regexp_matches(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), 'pin|key|tel|lat|lon|geo|name|race|salt|hash|pan|sin|nin|bic') END AS denied FROM n""",
)
def l11(spark, sf):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "getPassword").when(k == 1, "is_").when(k == 2, F.col("p_name")).when(k == 3, F.concat(F.lit("userEmail"), "p_partkey")).otherwise("total")
    return d.read(spark, sf, "part").select("p_partkey", denied_name(name).alias("denied"))


@query("C5", f"WITH {d.COVERAGE}, k AS (SELECT DISTINCT build, cls, i AS idx FROM cb, range(12) r(i)), b AS (SELECT DISTINCT build, cls, idx, true AS hit FROM cb) SELECT k.build, k.cls, CAST(k.idx AS INTEGER) AS idx, coalesce(hit, false) AS is_set FROM k LEFT JOIN b USING (build, cls, idx)")
def c5(spark, sf):
    bits = d.coverage_bits(spark, sf).select("build", "cls", "idx").distinct()
    keys = bits.select("build", "cls").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return keys.join(bits.withColumn("hit", F.lit(True)), ["build", "cls", "idx"], "left").select("build", "cls", "idx", F.coalesce("hit", F.lit(False)).alias("is_set"))


@query(
    "E14",
    f"""WITH {d.EDGES}, t AS (SELECT build, day, sum(observations)::BIGINT AS entries FROM we GROUP BY ALL), r AS (SELECT *, entries // 20 AS want FROM t)
SELECT build, day, entries, CASE WHEN entries > 0 THEN least(greatest(CASE WHEN want < 1 THEN 0 ELSE 1 << (length(bin(want)) - 1) END, 1), 65536) END AS rate FROM r""",
)
def e14(spark, sf):
    t = d.window_edges(spark, sf).groupBy("build", "day").agg(F.sum("observations").alias("entries"))
    return t.withColumn("rate", F.when(F.col("entries") > 0, edges.recommended_rate(F.col("entries"))))


@query("K11", f"WITH {d.WINDOWS} SELECT build, count(*) AS windows, count(*) FILTER (degraded) AS degraded, count(DISTINCT instance) AS instances FROM wi GROUP BY ALL")
def k11(spark, sf):
    return d.windows(spark, sf).groupBy("build").agg(F.count("*").alias("windows"), F.count_if("degraded").alias("degraded"), F.count_distinct("instance").alias("instances"))


@query("K8", f"WITH {_AGG} SELECT build, callee_cls, callee_idx, count(*) AS callers, CAST(sum(observations) AS BIGINT) AS observations, bool_or(min_rate <> max_rate) AS mixed FROM ea GROUP BY ALL")
def k8(spark, sf):
    return edges.edge_agg(d.window_edges(spark, sf)).groupBy("build", *edges.CALLEE).agg(
        F.count("*").alias("callers"), F.sum("observations").alias("observations"), F.bool_or(F.col("min_rate") != F.col("max_rate")).alias("mixed")
    )


@query("K21", f"WITH {_AGG} SELECT build, count(*) AS edges, count(*) FILTER (callee_idx NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)) AS outside FROM ea GROUP BY ALL")
def k21(spark, sf):
    known = d.read(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("callee_idx"), F.lit(True).alias("known"))
    agg = edges.edge_agg(d.window_edges(spark, sf)).join(known, "callee_idx", "left")
    return agg.groupBy("build").agg(F.count("*").alias("edges"), F.count_if(F.col("known").isNull()).alias("outside"))


@query("F1", f"WITH {d.METHODS} SELECT p_partkey FROM me WHERE NOT (p_partkey % 23 = 0 OR name = 'm7')")
def f1(spark, sf):
    return d.methods(spark, sf).where(~((F.col("p_partkey") % 23 == 0) | (F.col("name") == "m7"))).select("p_partkey")


@query("F6", f"WITH {d.METHODS} SELECT p_partkey, is_public_api AND NOT (lower(cls) LIKE '%.economy.%') AS public FROM me")
def f6(spark, sf):
    return d.methods(spark, sf).select("p_partkey", inventory.public_api(F.col("cls"), F.col("is_public_api")).alias("public"))


@query(
    "F13",
    """SELECT DISTINCT ancestor, ref FROM (
  SELECT 'r' || n_regionkey AS ancestor, 'n' || n_nationkey AS ref FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'root', 'r' || r_regionkey FROM region UNION ALL SELECT 'root', 'n' || n_nationkey FROM nation UNION ALL SELECT 'root', 'c' || c_custkey FROM customer)""",
)
def f13(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    links = (
        d.read(spark, sf, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("ref"))
        .union(d.read(spark, sf, "nation").select(name("r", "n_regionkey"), name("n", "n_nationkey")))
        .union(d.read(spark, sf, "region").select(F.lit("root"), name("r", "r_regionkey")))
    )
    return graph.descendants(links)


# ---- A1, A2, B1, B12, B21, B22: documents


def _decoded(spark, sf):
    return windows.decode_windows(d.window_documents(spark, sf))


@query("B1", f"WITH {d.DOCUMENTS} SELECT build, instance, day, reject_reason FROM dr")
def b1(spark, sf):
    return _decoded(spark, sf).select("build", "instance", "day", "reject_reason")


_BITS = f"WITH {d.DOCUMENTS} SELECT cb.build, cb.instance, cb.cls, cb.idx, count(*) AS windows FROM cb JOIN dr USING (build, instance, day) WHERE reject_reason IS NULL GROUP BY ALL"


def _bits(records):
    return coverage.explode_bits(records.select("build", "instance", "cls", "probes")).groupBy("build", "instance", "cls", "idx").agg(F.count("*").alias("windows"))


@query("B12", _BITS)
def b12(spark, sf):
    return _bits(windows.accepted_coverage(_decoded(spark, sf)))


def _folder(spark, name):
    return f"{graph.scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("A9", f"WITH {_AGG} SELECT build, callee_cls, callee_idx, count(*) AS callers, CAST(sum(observations) AS BIGINT) AS observations FROM ea GROUP BY ALL")
def a9(spark, sf):
    """Callers of every method from edges that are stored by callee; the read needs no shuffle."""
    return sinks.callers(sinks.write_edges(d.window_edges(spark, sf), "edges")[1], spark)


@query("A9_out", f"WITH {_AGG} SELECT build, caller_cls, caller_idx, count(*) AS callees, CAST(sum(observations) AS BIGINT) AS observations FROM ea WHERE caller_cls = 's3' GROUP BY ALL")
def a9_out(spark, sf):
    return sinks.callees(sinks.write_edges(d.window_edges(spark, sf), "edges")[0], spark, "s3")


@query("A9_bits", f"WITH {d.COVERAGE} SELECT build, count(*) AS bits FROM cb GROUP BY ALL")
def a9_bits(spark, sf):
    """Coverage by build, each build's classes dealt to several files."""
    path = _folder(spark, "tables")
    d.coverage_bits(spark, sf).repartition("build", "cls").sortWithinPartitions("build", "cls", "idx").write.partitionBy("build").parquet(path)
    return spark.read.parquet(path).groupBy("build").agg(F.count("*").alias("bits"))
