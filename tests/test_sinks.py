from pyspark.sql import functions as F

from livescope.operators import edges
from livescope.sources import sinks


def test_reads_by_either_end_need_no_shuffle(spark):
    rows = [("b", None, f"A{n % 5}", n % 7, f"B{n % 3}", n % 4, 64, n) for n in range(200)]
    found = spark.createDataFrame(rows, "build string, day date, caller_cls string, caller_idx int, callee_cls string, callee_idx int, rate long, observations long")
    by_caller, by_callee = sinks.write_edges(found, "edges", 4)
    agg = edges.edge_agg(found)
    for read, table, want in (
        (sinks.callers, by_callee, agg.groupBy("build", "callee_cls", "callee_idx").agg(F.count("*"), F.sum("observations"))),
        (sinks.callees, by_caller, agg.groupBy("build", "caller_cls", "caller_idx").agg(F.count("*"), F.sum("observations"))),
    ):
        got = read(table, spark)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = sinks.callers(by_callee, spark, "B1")
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString()
    assert {r.callee_cls for r in one.collect()} == {"B1"}


def test_a_class_larger_than_a_task_is_dealt_and_read_whole(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS", 20, raising=False)
    rows = [("b", None, "A", n, f"B{n % 3}", n % 40, 64, 1) for n in range(400)]
    found = spark.createDataFrame(rows, "build string, day date, caller_cls string, caller_idx int, callee_cls string, callee_idx int, rate long, observations long")
    by_caller, by_callee = sinks.write_edges(found, "edges")
    files = spark.table(by_caller).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 5 and max(r["count"] for r in files) < 200
    assert sinks.callees(by_caller, spark, "A").count() == 400 and sinks.callers(by_callee, spark).agg(F.sum("callers")).first()[0] == 400
