"""Registered queries of trace documents, branch arms and admission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission, traces
from ..sources import derived as d
from ..sources import traces as source
from .registry import query

# Each turn of a conversation is a frame that calls `length(text) % 7` leaves, every third of which
# calls one more, and then the next turn. Conversations of an id divisible by 10 lose their ends.
_TURN = """t AS (SELECT conv_id AS c, turn, role, coalesce(length(text), 0) % 7 AS k, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE conv_id % 10 <> 0),
o AS (SELECT *, CAST(coalesce(sum(1 + k + (k + 2) // 3) OVER w, 0) AS BIGINT) AS pos, row_number() OVER (PARTITION BY c ORDER BY turn) - 1 AS depth
  FROM t WINDOW w AS (PARTITION BY c ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, lag(pos) OVER (PARTITION BY c ORDER BY turn) AS up FROM o),
l AS (SELECT c, pos AS up, pos + 1 + x + (x + 2) // 3 AS pos, depth + 1 AS depth, x, k FROM p, range(0, 6) r(x) WHERE x < k)"""


def _bodies(spark, sf) -> DataFrame:
    c = d.read(spark, sf, "conversations").select("conv_id", "turn", "role", (F.coalesce(F.length("text"), F.lit(0)) % 7).alias("k"))
    leaf = F.expr("""transform(if(k > 0, sequence(0, k - 1), array()), x -> if(x % 3 = 0, '{"frame":"leaf","extra":1,"calls":[{"frame":"io"}]}', '{"frame":"leaf"}'))""")
    turns = c.withColumn("opening", F.concat(F.lit('{"frame":"'), "role", F.lit('","calls":['), F.array_join(leaf, ",")))
    # One conversation is a bounded number of turns.
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "opening", "k"))).alias("ts"))
    joined = F.expr("""concat('{"root":', array_join(transform(ts, (t, i) -> concat(t.opening, if(t.k > 0 and i + 1 < size(ts), ',', ''))), ''), repeat(']}', size(ts)), '}')""")
    body = F.when(F.col("conv_id") % 10 == 0, F.expr("substring(b, 1, length(b) - 3)")).otherwise(F.col("b"))
    return whole.withColumn("b", joined).select(F.col("conv_id").alias("trace"), body.alias("body"))


@query("A7", f"""WITH {_TURN}, n AS (SELECT c, 1 + k + (k + 2) // 3 AS n, depth + CASE WHEN k > 0 THEN 3 ELSE 1 END AS levels FROM p)
SELECT CAST(c AS VARCHAR) AS trace, CAST(NULL AS VARCHAR) AS fault, CAST(sum(n) AS BIGINT) AS frames, CAST(max(levels) AS INTEGER) AS levels FROM n GROUP BY c
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'unreadable', CAST(0 AS BIGINT), CAST(NULL AS INTEGER) FROM conversations WHERE conv_id % 10 = 0""")
def a7(spark, sf):
    return source.documents_read(source.flatten_frames(_bodies(spark, sf)))


@query("L1", f"""WITH {_TURN} SELECT CAST(c AS VARCHAR) AS trace, pos AS ordinal, up AS parent, CAST(depth AS INTEGER) AS depth, role AS frame FROM p
UNION ALL SELECT CAST(c AS VARCHAR), pos, up, CAST(depth AS INTEGER), 'leaf' FROM l UNION ALL SELECT CAST(c AS VARCHAR), pos + 1, pos, CAST(depth + 1 AS INTEGER), 'io' FROM l WHERE x % 3 = 0""")
def l1(spark, sf):
    return source.flatten_frames(_bodies(spark, sf)).where("fault is null").select("trace", "ordinal", "parent", "depth", "frame")


@query("L5", f"""WITH {_TURN}, f AS (SELECT c, up, min(pos) AS pos, x % 3 = 0 AS deep, count(*) AS n FROM l GROUP BY ALL)
SELECT CAST(c AS VARCHAR) AS trace, pos AS ordinal, up AS parent, role AS frame, CAST(1 AS BIGINT) AS repeated FROM p
UNION ALL SELECT CAST(c AS VARCHAR), pos, up, 'leaf', n FROM f UNION ALL SELECT CAST(c AS VARCHAR), pos + 1, pos, 'io', 1 FROM f WHERE deep""")
def l5(spark, sf):
    return traces.fold_siblings(source.flatten_frames(_bodies(spark, sf)))


_OPS = traces.JUMPS_ONE + traces.JUMPS_TWO + ("TABLESWITCH",)


@query("L6", f"""WITH b AS (SELECT user_id AS trace, event_id % 3 AS ordinal, event_id AS seq, event_id % 17 AS site, ({list(_OPS)})[event_id % 17 + 1] AS op, event_id % 5 - 2 AS lhs, event_id % 4 - 1 AS rhs FROM events),
r AS (SELECT *, CASE WHEN op LIKE 'IF\\_%' ESCAPE '\\' THEN rhs ELSE 0 END AS o FROM b),
a AS (SELECT trace, ordinal, seq, site, CASE WHEN op = 'TABLESWITCH' THEN 'case' WHEN CASE WHEN op IN ('IFEQ', 'IFNULL', 'IF_ICMPEQ', 'IF_ACMPEQ') THEN lhs = o
  WHEN op IN ('IFNE', 'IFNONNULL', 'IF_ICMPNE', 'IF_ACMPNE') THEN lhs <> o WHEN op LIKE '%LT' THEN lhs < o WHEN op LIKE '%GE' THEN lhs >= o WHEN op LIKE '%GT' THEN lhs > o ELSE lhs <= o END THEN 'then' ELSE 'else' END AS arm FROM r),
g AS (SELECT trace, ordinal, site, arm, count(*) AS n, min(seq) AS s FROM a GROUP BY ALL)
SELECT trace, ordinal, site, arm, n, CAST(row_number() OVER (PARTITION BY trace, ordinal ORDER BY s) AS INTEGER) AS place FROM g""")
def l6(spark, sf):
    e, i = d.read(spark, sf, "events"), F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, _OPS)), (i % 17 + 1).cast("int"))
    return traces.group_arms(e.select(
        F.col("user_id").alias("trace"), (i % 3).alias("ordinal"), i.alias("seq"), (i % 17).alias("site"), op.alias("op"), (i % 5 - 2).alias("lhs"), (i % 4 - 1).alias("rhs")
    ))


# A window from an order's day to sixty days before its line is shipped: some end before they start.
@query("B3", """SELECT l_suppkey % 10 AS instance, count_if(l_shipdate::DATE - o_orderdate::DATE >= 60) AS sane, count_if(l_shipdate::DATE - o_orderdate::DATE < 60) AS refused
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def b3(spark, sf):
    lines = d.read(spark, sf, "lineitem").join(d.read(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    ok = admission.sane(F.to_date("o_orderdate"), F.date_sub(F.to_date("l_shipdate"), 60))
    return lines.groupBy((F.col("l_suppkey") % 10).alias("instance")).agg(F.count_if(ok).alias("sane"), F.count_if(~ok).alias("refused"))


@query("B4", """SELECT CASE event_id % 9 WHEN 0 THEN 'missing_agent_health' WHEN 1 THEN 'bad_field' WHEN 2 THEN 'bad_field' WHEN 3 THEN 'bad_field' WHEN 4 THEN 'bad_field' ELSE 'accepted' END AS reason,
  count(*) AS windows, CAST(sum(CASE event_id % 9 WHEN 5 THEN 1 WHEN 6 THEN user_id WHEN 7 THEN 0 WHEN 8 THEN 0 END) AS BIGINT) AS masks_missing FROM events GROUP BY ALL""")
def b4(spark, sf):
    says = F.expr("""CASE event_id % 9 WHEN 0 THEN '[]' WHEN 1 THEN '{"edgesDropped":-1}' WHEN 2 THEN '{"edgesRecorded":true}' WHEN 3 THEN '{"classesSkipped":[]}' WHEN 4 THEN '{"stripMaskMissing":"1"}'
      WHEN 5 THEN '{"stripMaskMissing":true,"edgesDropped":null}' WHEN 6 THEN concat('{"stripMaskMissing":', user_id, '}') WHEN 7 THEN '{"edgesDropped":7,"classesSkipped":{"a":1}}' ELSE '{}' END""")
    doc = F.try_parse_json(F.concat(F.lit('{"agentHealth":'), says, F.lit("}")))
    docs = d.read(spark, sf, "events").select(doc.alias("doc"))
    reason, missing = admission.check_health(F.col("doc"))
    return docs.select(F.coalesce(reason, F.lit("accepted")).alias("reason"), missing.alias("missing")).groupBy("reason").agg(
        F.count("*").alias("windows"), F.sum("missing").alias("masks_missing")
    )
