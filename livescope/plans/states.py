"""Registered queries of ledger state, defaults, verdict listings, traces and conformance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import conformance, edges, graph, inventory, ledger, rules, traces
from ..sources import derived as d
from ..sources import facts
from .registry import _FRAMES, _frames, query

_NOW = dt.date(2024, 6, 1)
_LEDGER = f"""{d.METHODS}, ca AS (SELECT p_partkey AS k FROM me WHERE NOT is_public_api),
pv AS (SELECT p_partkey + CASE WHEN p_partkey % 50 = 0 THEN 10000000 ELSE 0 END AS k, p_partkey % 4 <> 0 AS active, DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS first_proposed FROM me WHERE p_partkey % 3 <> 0),
nx AS (SELECT k, ca.k IS NOT NULL AS active, CASE WHEN pv.k IS NULL THEN DATE '2024-06-01' ELSE first_proposed END AS first_proposed,
  CASE WHEN ca.k IS NULL THEN CASE WHEN pv.active THEN DATE '2024-06-01' ELSE DATE '2024-05-01' END END AS revoked_at,
  CASE WHEN ca.k IS NULL THEN CASE WHEN NOT pv.active THEN 'older' WHEN k >= 10000000 THEN 'method no longer present in the inventory' ELSE 'no longer a candidate: public-api-surface' END END AS reason
  FROM (SELECT p_partkey AS k FROM me WHERE NOT is_public_api) ca FULL JOIN pv USING (k))"""


def _ledger(spark, sf):
    m = d.methods(spark, sf)
    k = F.col("p_partkey")
    now = m.select(k.alias("k"), F.when(F.col("is_public_api"), F.lit("public-api-surface")).alias("blocking"))
    before = m.where("p_partkey % 3 <> 0").select(
        (k + F.when(k % 50 == 0, 10000000).otherwise(0)).alias("k"), (k % 4 != 0).alias("active"), F.date_add(F.lit(dt.date(2024, 1, 1)), (k % 30).cast("int")).alias("first_proposed"),
        F.when(k % 4 == 0, F.lit(dt.date(2024, 5, 1))).alias("revoked_at"), F.when(k % 4 == 0, F.lit("older")).alias("reason"),
    )
    return ledger.reconciled(now.where("blocking is null"), before, now, ["k"], _NOW)


@query("J1", f"WITH {_LEDGER} SELECT * FROM nx")
def j1(spark, sf):
    return _ledger(spark, sf)


@query("J2", f"WITH {_LEDGER} SELECT k, reason FROM nx WHERE revoked_at = DATE '2024-06-01'")
def j2(spark, sf):
    return ledger.revoked(_ledger(spark, sf), _NOW).select("k", "reason")


_ACTIVE = f"{_LEDGER} SELECT k, first_proposed, row_number() OVER (ORDER BY first_proposed, k) AS place FROM nx WHERE active"


@query("J3", f"WITH {_ACTIVE}")
def j3(spark, sf):
    active = _ledger(spark, sf).where("active").select("k", "first_proposed", F.lit(0).alias("all"))
    return graph.placed(active, ["all"], ["first_proposed", "k"]).drop("all")


@query("K15", f"WITH {_ACTIVE} QUALIFY place <= 50")
def k15(spark, sf):
    """The oldest standing proposals."""
    return j3(spark, sf).where("place <= 50")


@query(
    "J4",
    f"""WITH {d.METHODS}, n AS (SELECT *, p_partkey % 9 = 0 AS known, length(artifact) % 3 AS opened FROM me WHERE NOT is_public_api),
r AS (SELECT p_partkey, row_number() OVER (PARTITION BY artifact ORDER BY cls, name, "desc") AS place FROM n WHERE NOT known)
SELECT n.p_partkey, known OR place <= 5 - opened AS allowed FROM n LEFT JOIN r USING (p_partkey)""",
)
def j4(spark, sf):
    m = d.methods(spark, sf).where("not is_public_api").withColumn("known", F.col("p_partkey") % 9 == 0)
    opened = m.select("artifact", (F.length("artifact") % 3).alias("opened")).distinct()
    return ledger.cap_new(m, opened, 5).select("p_partkey", "allowed")


@query(
    "I3",
    f"""WITH {facts.FACTS}, m AS (SELECT k, replace(cls, '/', '.') AS cls, CASE k % 11 WHEN 0 THEN 'values' WHEN 1 THEN 'valueOf' WHEN 2 THEN 'equals' WHEN 3 THEN 'hashCode' WHEN 4 THEN 'toString' WHEN 5 THEN 'canEqual' WHEN 6 THEN 'builder' WHEN 7 THEN 'toBuilder' ELSE name END AS name,
  CASE k % 11 WHEN 0 THEN '()[La/E;' WHEN 1 THEN '(Ljava/lang/String;)La/E;' WHEN 2 THEN '(Ljava/lang/Object;)Z' WHEN 3 THEN '()I' WHEN 4 THEN '()Ljava/lang/String;' WHEN 5 THEN '(Ljava/lang/Object;)Z' WHEN 6 THEN '()La/B;' WHEN 7 THEN '()V' ELSE "desc" END AS "desc", k % 11 AS r FROM mf)
SELECT k, CASE WHEN r <= 6 THEN r WHEN r = 10 THEN 8 END AS rule_no FROM m""",
)
def i3(spark, sf):
    names = ["values", "valueOf", "equals", "hashCode", "toString", "canEqual", "builder", "toBuilder"]
    descs = ["()[La/E;", "(Ljava/lang/String;)La/E;", "(Ljava/lang/Object;)Z", "()I", "()Ljava/lang/String;", "(Ljava/lang/Object;)Z", "()La/B;", "()V"]
    r = (F.col("k") % 11).cast("int")
    pick = lambda own, values: F.coalesce(F.get(F.array(*map(F.lit, values)), r), F.col(own))
    cls = F.translate("cls", "/", ".")
    m = facts.method_facts(spark, sf).select("k", F.when(r == 10, F.concat(cls, F.lit("$MyBuilder"))).otherwise(cls).alias("cls"), pick("name", names).alias("name"), pick("desc", descs).alias("desc"))
    return inventory.match_rules(m, rules.default_rules()).select("k", "rule_no")


@query("E13", """SELECT o_orderkey, o_orderkey % 2 = 0 AND coalesce(sampled, 0) = 0 AND coalesce(calls, 0) > 0 AS starved FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity > 45) AS sampled, sum(l_linenumber) AS calls FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey""")
def e13(spark, sf):
    seen = d.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") > 45).alias("sampled"), F.sum("l_linenumber").alias("calls"))
    w = d.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("armed")).join(seen, "o_orderkey", "left")
    return w.select("o_orderkey", edges.starved(F.col("armed"), F.col("sampled"), F.col("calls")).alias("starved"))




@query("L7", f"WITH {_FRAMES} SELECT frame, CAST(sum(CASE WHEN ordinal % 4 = 1 THEN 1 ELSE ordinal % 4 + 1 END) AS BIGINT) AS invocations FROM fr GROUP BY ALL")
def l7(spark, sf):
    repeated = F.when(F.col("ordinal") % 4 != 1, F.col("ordinal") % 4 + 1)
    return traces.invocations(_frames(spark, sf).withColumn("repeated", repeated.cast("long")))


@query("L9", f"WITH {_FRAMES}, v AS (SELECT *, CASE WHEN threw IS NOT NULL THEN 'pool-' || (size_in % 5) END AS via FROM fr) SELECT coalesce(via, 'own') AS via, count(*) AS frames, count(DISTINCT trace) AS traces, count(DISTINCT trace) FILTER (via IS NOT NULL) AS joined FROM v GROUP BY ALL")
def l9(spark, sf):
    via = F.when(F.col("threw").isNotNull(), F.concat(F.lit("pool-"), F.col("size_in") % 5))
    return traces.via_counts(_frames(spark, sf).withColumn("via", via))


@query("L17", f"""WITH {_FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY ordinal) AS place, CAST(floor(log2(ordinal + 1)) AS INTEGER) AS depth FROM fr)
SELECT trace, count(*) FILTER (place <= 20000 AND depth < 2) AS kept, bool_or(place > 20000) AS frames_capped, bool_or(depth >= 2) AS depth_capped FROM p GROUP BY trace""")
def l17(spark, sf):
    depth = F.floor(F.log2(F.col("ordinal") + 1)).cast("int")
    return traces.capped(_frames(spark, sf).withColumn("depth", depth), deepest=2)


@query("L15", """WITH o AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'app.Order' WHEN 1 THEN 'app.OrderLine' ELSE 'app.Item' END AS type, CASE p_partkey % 3 WHEN 0 THEN 'getTotal' WHEN 1 THEN 'getPassword' ELSE 'size' END AS member FROM part)
SELECT type, count(*) FILTER (type <> 'app.OrderLine' AND member <> 'size' AND member <> 'getPassword') AS shown, count(*) FILTER (type <> 'app.OrderLine' AND member = 'getPassword') AS refused FROM o GROUP BY type""")
def l15(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "app.Order").when(k % 4 == 1, "app.OrderLine").otherwise("app.Item")
    member = F.when(k % 3 == 0, "getTotal").when(k % 3 == 1, "getPassword").otherwise("size")
    allowed = [("app.Order", "getTotal"), ("app.Order", "getPassword"), ("app.Item", "getTotal"), ("app.Item", "getPassword")]
    return traces.projected(d.read(spark, sf, "part").select(kind.alias("type"), member.alias("member")), allowed)


@query("L18", """WITH l AS (SELECT user_id % 10 AS instance, arg_max(event_id, ts) AS dropped, max(ts) AS at FROM events GROUP BY ALL) SELECT instance, dropped, dropped > 500 AS alert FROM l""")
def l18(spark, sf):
    e = d.read(spark, sf, "events").select((F.col("user_id") % 10).alias("instance"), F.col("ts").alias("started_at"), F.col("event_id").alias("dropped"))
    return traces.health(e, {"dropped": 500}).select("instance", "dropped", "alert")


@query("M2", f"""WITH {d.COVERAGE}, tr AS (SELECT 'app.' || t AS cls, i AS idx, CASE (i + length(t)) % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'rare' WHEN 2 THEN 'never_loaded' WHEN 3 THEN 'loaded_not_invoked' ELSE 'not_indexed' END AS expect
  FROM (SELECT DISTINCT event_type AS t FROM events UNION SELECT 'ghost'), range(0, 10) r(i)), h AS (SELECT DISTINCT cls, idx FROM cb),
x AS (SELECT tr.*, h.idx IS NOT NULL AS hit, tr.cls IN (SELECT cls FROM cb) AS seen, tr.cls IN (SELECT cls FROM cb) AND tr.idx < 9 AS known FROM tr LEFT JOIN h USING (cls, idx))
SELECT cls, CAST(idx AS INTEGER) AS idx, expect, CASE expect WHEN 'dead' THEN known AND NOT hit WHEN 'rare' THEN hit WHEN 'never_loaded' THEN NOT seen WHEN 'loaded_not_invoked' THEN seen AND NOT hit ELSE NOT known END AS ok FROM x""")
def m2(spark, sf):
    bits = d.coverage_bits(spark, sf)
    kinds = d.read(spark, sf, "events").select("event_type").distinct()
    named = kinds.select(F.explode(F.array("event_type", F.lit("ghost"))).alias("t")).distinct()
    idx = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("idx")
    n = (F.col("idx") + F.length("t")) % 5
    expect = F.when(n == 0, "dead").when(n == 1, "rare").when(n == 2, "never_loaded").when(n == 3, "loaded_not_invoked").otherwise("not_indexed")
    truth = named.select("t", idx).select(F.concat(F.lit("app."), "t").alias("cls"), "idx", expect.alias("expect"))
    known = bits.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("idx"))
    return conformance.check_truth(truth, bits, bits, known)


@query("M3", """WITH s AS (SELECT o_orderpriority AS build, CASE o_custkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'no-methods' WHEN 2 THEN 'no-methods' ELSE 'broken' END AS reason, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL),
e AS (SELECT o_orderpriority AS build, count(*) AS n_empty FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL)
SELECT build, reason, n, CASE WHEN reason = 'broken' THEN 'unexpected reason' ELSE 'more than classes without probes' END AS fault FROM s LEFT JOIN e USING (build) WHERE reason = 'broken' OR n > coalesce(n_empty, 0)""")
def m3(spark, sf):
    o = d.read(spark, sf, "orders")
    k = F.col("o_custkey") % 4
    skipped = o.select(F.col("o_orderpriority").alias("build"), F.when(k == 0, "interface").when(k < 3, "no-methods").otherwise("broken").alias("reason"), F.lit(1).cast("long").alias("n"))
    allowed = o.limit(1).select(F.explode(F.array(F.lit("interface"), F.lit("no-methods"))).alias("reason"))
    empty = o.where("o_custkey % 3 = 0").groupBy(F.col("o_orderpriority").alias("build")).agg(F.count("*").alias("n_empty"))
    return conformance.unexpected_skips(skipped, allowed, empty)


@query("M4", """WITH l AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'ERROR export failed tracer: x' WHEN event_id % 5 = 0 THEN 'noise' ELSE 'span a tracer: ' || event_type || ' ok' END AS line FROM events)
SELECT CASE WHEN contains(line, 'ERROR') THEN '#errors' ELSE regexp_extract(line, 'tracer: ([^ ]+)', 1) END AS tracer, count(*) AS spans FROM l WHERE line <> 'noise' GROUP BY ALL""")
def m4(spark, sf):
    k = F.col("event_id")
    line = F.when(k % 13 == 0, "ERROR export failed tracer: x").when(k % 5 == 0, "noise").otherwise(F.concat(F.lit("span a tracer: "), "event_type", F.lit(" ok")))
    return conformance.span_counts(d.read(spark, sf, "events").select(line.alias("line")))


@query("M5", """SELECT event_type AS who, count(*) FILTER (event_id % 3 <> 0) AS loads, count(*) FILTER (event_id % 3 <> 0 AND event_id % 4 = 0) AS first, count(*) FILTER (event_id % 3 <> 0 AND event_id % 2 = 0) AS second FROM events GROUP BY ALL""")
def m5(spark, sf):
    k = F.col("event_id")
    marks = F.array_compact(F.array(F.when(k % 4 == 0, "first"), F.when(k % 2 == 0, "second")))
    e = d.read(spark, sf, "events").select(F.col("event_type").alias("who"), F.col("ts").alias("at"), F.when(k % 3 != 0, "load").otherwise("call").alias("kind"), marks.alias("marks"))
    return conformance.marker_counts(e, ["first", "second"])


@query("M6", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT unnest(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS name FROM l WHERE NOT starts_with(ltrim(line, ' '), '//')),
n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT DISTINCT lang FROM documents UNION SELECT unnest(['the', 'and', 'of', 'der']))
SELECT n.name, count(w.name) AS refs FROM n LEFT JOIN w USING (name) WHERE n.name IS NOT NULL GROUP BY n.name""")
def m6(spark, sf):
    docs, part = d.read(spark, sf, "documents"), d.read(spark, sf, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).union(docs.select("lang")).union(docs.limit(1).select(F.explode(F.array(*map(F.lit, ("the", "and", "of", "der"))))))
    return conformance.source_refs(docs, names.where("name is not null"))


@query("M7", """WITH c AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'dead.' WHEN 1 THEN 'rare.' ELSE 'warm.' END || p_partkey AS name, p_size AS n FROM part)
SELECT name, n, CASE WHEN starts_with(name, 'dead.') THEN 'must be absent' ELSE 'too small' END AS fault FROM c WHERE starts_with(name, 'dead.') OR (starts_with(name, 'rare.') AND n < 10)""")
def m7(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "dead.").when(k % 3 == 1, "rare.").otherwise("warm."), k)
    return conformance.counter_faults(d.read(spark, sf, "part").select(name.alias("name"), F.col("p_size").alias("n")), F.col("name"), F.col("n"), 10)
