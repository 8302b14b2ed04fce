"""Verdicts: one clause at a time, facts from evidence, and that the derived store brings every case."""

import datetime as dt

import duckdb
import os
import pytest

import __spark_entry__ as entry
from livescope.operators import facts, phases, rules, verdict
from livescope.sources import store

TABLES = "/root/testdata/sf0.01"
PASSING = {
    "ref": 1, "artifact": "a", "cls": "A", "name": "m", "desc": "()V", "idx": 3, "suppressed": False, "suppression": None, "is_public_api": False, "eligibility": "OBSERVABLE", "installed": True, "short_circuitable": False,
    "observed": False, "last_seen": None, "class_loaded": True, "static_reachable": False, "inbound_edges": 0, "inbound_observations": 0, "sample_rate": None, "edges_reported": True, "usable_windows": 4, "excluded_windows": 0,
    "phases_covered": ["month-end"], "phases_missing": [], "window_days": 4, "min_window_days": 4, "disabled_key": None, "rate_limit": None, "proposed": False,
}
SCHEMA = (
    "ref long, artifact string, cls string, name string, desc string, idx int, suppressed boolean, suppression string, is_public_api boolean, eligibility string, installed boolean, short_circuitable boolean, observed boolean, last_seen date,"
    " class_loaded boolean, static_reachable boolean, inbound_edges long, inbound_observations long, sample_rate long, edges_reported boolean, usable_windows long, excluded_windows long, phases_covered array<string>,"
    " phases_missing array<string>, window_days int, min_window_days int, disabled_key string, rate_limit string, proposed boolean"
)
FLIPS = [
    ({}, "DEAD_CANDIDATE", None), ({"installed": None}, "DEAD_CANDIDATE", None), ({"edges_reported": False}, "DEAD_CANDIDATE", None), ({"excluded_windows": 9}, "DEAD_CANDIDATE", None),
    ({"suppressed": True, "suppression": "x (user)"}, "UNKNOWN", "suppressed: x (user)"), ({"name": "<clinit>"}, "UNKNOWN", "clinit"), ({"is_public_api": True}, "UNKNOWN", "public-api-surface"),
    ({"eligibility": "NOT_DYNAMICALLY_OBSERVABLE"}, "NOT_DYNAMICALLY_OBSERVABLE", "not-dynamically-observable"), ({"eligibility": "DE_INSTRUMENTED"}, "UNKNOWN", "de-instrumented"),
    ({"installed": False}, "UNKNOWN", "no-probe-installed: index 3"), ({"short_circuitable": True}, "UNKNOWN", "short-circuitable"), ({"class_loaded": False}, "UNKNOWN", "class-never-loaded"),
    ({"static_reachable": True}, "UNKNOWN", "static-reachable"), ({"static_reachable": None}, "UNKNOWN", "static-unresolved"), ({"usable_windows": 0}, "UNKNOWN", "no-usable-window"),
    ({"phases_missing": ["q", "y"]}, "UNKNOWN", "phases-missing: q, y"), ({"window_days": 3}, "UNKNOWN", "window-too-short: 3 of 4 days"), ({"disabled_key": "entrypoint:x"}, "UNKNOWN", "rule-class-disabled: entrypoint:x"),
    ({"rate_limit": "3 a day"}, "UNKNOWN", "rate-limited: 3 a day"), ({"observed": True, "last_seen": dt.date(2024, 1, 5)}, "LIVE", "runtime-observed: last seen 2024-01-05"),
    ({"inbound_edges": 2, "inbound_observations": 9, "sample_rate": 64}, "LIVE", "runtime-edge-observed: 2 edges, 9 observations at 1 in 64"),
    ({"inbound_edges": 1, "inbound_observations": 1}, "LIVE", "runtime-edge-observed: 1 edges, 1 observations at no declared rate"),
    ({"observed": True, "last_seen": dt.date(2024, 1, 5), "suppressed": True, "suppression": "x (user)"}, "LIVE", "suppressed: x (user)"),
    ({"suppressed": True, "suppression": "x", "eligibility": "NOT_DYNAMICALLY_OBSERVABLE"}, "UNKNOWN", "suppressed: x"),
]


def test_each_clause_alone_stops_a_nomination(spark):
    rows = [tuple((PASSING | {"ref": n} | flip)[k.split()[0]] for k in SCHEMA.split(", ")) for n, (flip, _, _) in enumerate(FLIPS)]
    told = verdict.evaluate(spark.createDataFrame(rows, SCHEMA))
    got = {r.ref: r for r in told.withColumn("blocking", verdict.first_blocking(told["reasons"])).collect()}
    for n, (flip, status, blocking) in enumerate(FLIPS):
        assert (got[n].status, got[n].blocking) == (status, blocking), flip
        assert (got[n].reasons[-1] == "DEAD_CANDIDATE") == (status == "DEAD_CANDIDATE")
    heads = {r.blocking.split(":")[0] for r in got.values() if r.blocking}
    assert heads == set(verdict.BLOCKING_HEADS) == set(verdict.EXPLANATIONS)


def test_only_so_many_new_proposals_a_day(spark):
    rows = [tuple((PASSING | {"ref": n, "artifact": "ab"[n % 2], "name": f"m{n:02}", "proposed": n == 4, "rate_limit": None})[k.split()[0]] for k in SCHEMA.split(", ")) for n in range(10)]
    opened = spark.createDataFrame([("b", 2)], "artifact string, opened long")
    got = {r.ref: r.status for r in verdict.evaluate_capped(spark.createDataFrame(rows, SCHEMA).drop("rate_limit"), opened, 3).collect()}
    assert {n for n, s in got.items() if s == "DEAD_CANDIDATE"} == {0, 2, 4, 6, 1}


def _store(spark, days, degraded=False, probes=((0, 1), (1, 1)), masks=(0, 1, 2, 3)):
    """Days of one instance that set some probes of class A and call probe 1."""
    w = [("b", "i", d, d + dt.timedelta(days=1), "production", degraded, False) for d in days]
    key = "build string, instance string, day date"
    return facts.Evidence(
        spark.createDataFrame(w, f"{key}, end_day date, environment string, degraded boolean, tainted boolean"),
        spark.createDataFrame([("b", "i", d, "A", p) for d in days for p, _ in probes], f"{key}, cls string, idx int"),
        spark.createDataFrame([("b", "i", d, "A") for d in days], f"{key}, cls string"),
        spark.createDataFrame([("b", "i", d, "A", p) for d in days for p in masks], f"{key}, cls string, idx int"),
        spark.createDataFrame([("b", "i", d, "A") for d in days], f"{key}, cls string"),
        spark.createDataFrame([("b", "i", d, "A", 0, "A", 1, 1024, 5) for d in days], f"{key}, caller_cls string, caller_idx int, callee_cls string, callee_idx int, rate long, observations long"),
    )


def _run(spark, evidence, calendar):
    methods = [(n, "b", "a", c, f"m{n}", "()V", i, False, False, e) for n, c, i, e in ((0, "A", 0, "OBSERVABLE"), (1, "A", 1, "OBSERVABLE"), (2, "A", 2, "OBSERVABLE"), (3, "A", 3, "NOT_DYNAMICALLY_OBSERVABLE"), (4, "Z", 0, "OBSERVABLE"))]
    inventory = spark.createDataFrame(methods, "ref long, build string, artifact string, cls string, name string, desc string, idx int, is_public_api boolean, short_circuitable boolean, eligibility string")
    static = spark.createDataFrame([(n, False) for n in range(5)], "ref long, static_reachable boolean")
    nothing = {n: spark.createDataFrame([], s) for n, s in (("suppressed", "ref long, suppression string"), ("kinds", "build string, cls string, kind string"), ("disabled", "rule_key string"), ("proposals", "ref long, active boolean, first_proposed date, reason string"))}
    found = facts.method_facts(inventory, evidence, calendar, static, **nothing)
    return {r.ref: r for r in verdict.evaluate(found).collect()}


DAYS = [dt.date(2024, 1, 29) + dt.timedelta(days=n) for n in range(4)]
MONTH_END = phases.Calendar(("month-end",), (("month-end", "last-days-of-month", 2),))


def test_facts_from_evidence(spark):
    got = _run(spark, _store(spark, DAYS), MONTH_END)
    assert {n: r.status for n, r in got.items()} == {0: "LIVE", 1: "LIVE", 2: "DEAD_CANDIDATE", 3: "NOT_DYNAMICALLY_OBSERVABLE", 4: "UNKNOWN"}
    assert got[0].last_seen == dt.date(2024, 2, 2) and got[0].first_seen == dt.date(2024, 1, 30) and got[0].outbound_edges == 1 and got[0].inbound_edges == 0
    assert (got[1].inbound_edges, got[1].inbound_observations, got[1].sample_rate) == (1, 20, 1024)
    assert got[2].window_days == 4 and got[2].phases_covered == ["month-end"] and got[2].usable_windows == 4
    assert got[4].installed is None and not got[4].class_loaded and not got[4].mask_reported


def test_a_phase_that_was_missed(spark):
    got = _run(spark, _store(spark, DAYS), phases.Calendar(("year-end-close",), (("year-end-close", "last-days-of-year", 5),)))
    assert all(r.status != "DEAD_CANDIDATE" and r.phases_missing == ["year-end-close"] for r in got.values())


def test_degraded_windows_show_life_only(spark):
    got = _run(spark, _store(spark, DAYS, degraded=True), MONTH_END)
    assert got[0].status == "LIVE" and got[2].status == "UNKNOWN" and (got[2].usable_windows, got[2].excluded_windows) == (0, 4)


def test_no_probe_no_candidate(spark):
    got = _run(spark, _store(spark, DAYS, probes=(), masks=()), MONTH_END)
    assert got[2].installed is False and got[2].status == "UNKNOWN" and "no-probe-installed" in got[2].blockers


def test_first_rule_of_three_layers(spark):
    methods = spark.createDataFrame([("A", "x", "()V"), ("A", "hashCode", "()I"), ("G", "x", "()V"), ("H", "y", "()V"), ("H", "z", "()V")], "cls string, name string, desc string")
    derived = spark.createDataFrame([("G", "*"), ("H", "y"), ("A", "x")], "cls string, method_glob string")
    got = {(r.cls, r.name): r.suppression for r in rules.suppress(methods, ["A#x # mine", "", "# no"], derived).collect()}
    assert got == {("A", "x"): "A#x (user): mine", ("A", "hashCode"): "*#hashCode()I (default)", ("G", "x"): "G#* (derived)", ("H", "y"): "H#y (derived)", ("H", "z"): None}
    assert {r.suppression for r in rules.suppress(methods, [], derived.where("false"), defaults=False).collect()} == {None}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the given tables")
def test_the_store_brings_every_case():
    con, sql = duckdb.connect(), entry.oracle_sql()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    assert len(con.sql(f"SELECT DISTINCT status FROM ({sql['G9']})").fetchall()) == 4
    heads = {r[0] for r in con.sql(f"SELECT DISTINCT string_split(unnest(string_split(reasons, ' | ')), ':')[1] FROM ({sql['G9']})").fetchall()}
    assert set(verdict.BLOCKING_HEADS) <= heads
    assert {r[0] for r in con.sql(f"SELECT DISTINCT static_reachable FROM ({sql['G5']})").fetchall()} == {True, False, None}
    empty = [name for name, text in sql.items() if not name.startswith("op") and not con.sql(f"SELECT 1 FROM ({text}) LIMIT 1").fetchall()]
    assert not empty  # a query that agrees on nothing says nothing


def test_every_part_has_its_calls(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    calls = {}
    for r in store.call_edges(spark, str(tmp_path)).collect():
        calls.setdefault(r.src, []).append(r.dst)
    assert {k: len(v) for k, v in calls.items()} == {k: 3 if k % 8 == 1 else 2 for k in range(40)}
    assert sorted(calls[22]) == [23, 26] and {r.src for r in store.thinned_call_edges(spark, str(tmp_path)).collect()} == set(range(40)) - {5, 22, 39}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the given tables")
def test_blast_radius_over_the_calls_of_every_part(spark):
    shown = {(r.callee_cls, r.callee_idx): r.shown for r in entry.queries()["K9"](spark, TABLES).collect()}
    assert shown["p.Brand#24.LARGE", 6] == "m239(1739)V=DEAD_CANDIDATE"  # 1739 calls others and nothing calls it: UNKNOWN where the graph leaves out its calls
