"""Inventory operators against independent versions."""

import random

from pyspark.sql import functions as F

from livescope.operators import documents, ledger, static


def _components(nodes, edges):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_and_test_only_match_brute_force(spark):
    rng = random.Random(7)
    nodes = list(range(40))
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(48)} | {(n, (n + 1) % 4) for n in range(4)})
    frame = spark.createDataFrame(edges, "src long, dst long")
    want = _components(nodes, edges)
    members = static.components(spark.createDataFrame([(n,) for n in nodes], "ref long"), frame)
    assert {r.ref: r.component for r in members.collect()} == want
    tests, entries = {n for n in nodes if n % 5 == 0}, {n for n in nodes if n % 7 == 1}

    def rule(n):
        into = [a for a, b in edges if b == n]
        if n in tests:
            return True
        if n in entries:
            return False
        if not into:
            return None
        if any(a not in tests and want[a] != want[n] for a in into):
            return False
        return True if any(a in tests for a in into) or any(want[t] == want[n] for t in tests) else None

    methods = spark.createDataFrame([(n, n in tests, n in entries) for n in nodes], "ref long, is_test boolean, is_entry boolean")
    assert {r.ref: r.test_only for r in static.test_only(methods, frame, members).collect()} == {n: rule(n) for n in nodes}


def test_patterns_and_scopes(spark):
    rows = spark.createDataFrame([("com/a/Order", "run"), ("com/Order", "x"), ("com/a/b/Order", "run"), ("org/jacoco/agent/X", "y"), ("java/util/List", "z")], "cls string, name string")
    hit = lambda p: [r.h for r in rows.select(static.matches(p, F.col("cls"), F.col("name")).alias("h")).collect()]
    assert hit("com.*.Order#run") == [True, False, False, False, False] and hit("com.**.Order#*") == [True, True, True, False, False] and hit("com.**") == [True, True, True, False, False]
    scope = lambda inc, exc: [r.h for r in rows.select(static.in_scope(F.col("cls"), inc, exc).alias("h")).collect()]
    assert scope(["com/", "org/", "java/"], ["com/a/b/"]) == [True, True, False, False, False] and scope(["org/jacoco/"], []) == [False, False, False, True, False]
    assert static.scope_overlap(["com/", "org/x/"], ["com/a/", "org/"]) == ["com/a/", "org/x/"]


def test_errors_keep_what_is_not_named(spark):
    rows = spark.createDataFrame([({"1": 3, "2": 4, "9": 2}, None), (None, {"old": 5}), ({}, {"old": 5}), (None, None)], "by_id map<string,bigint>, legacy map<string,bigint>")
    table = F.create_map(F.lit("1"), F.lit("E"), F.lit("2"), F.lit("E"))
    got = [(dict(r.r.named), r.r.unresolved, r.r.source) for r in rows.select(documents.resolve_errors(F.col("by_id"), table, F.col("legacy")).alias("r")).collect()]
    assert got == [({"E": 7}, 2, "errors_by_class"), ({"old": 5}, 0, "legacy_names"), ({}, 0, "unavailable"), ({}, 0, "unavailable")]


def test_a_cap_counts_what_was_opened_today(spark):
    rows = [("a", f"c{i}", "m", "()V", i == 0) for i in range(8)]
    candidates = spark.createDataFrame(rows, "artifact string, cls string, name string, desc string, known boolean")
    opened = spark.createDataFrame([("a", 2)], "artifact string, opened int")
    assert {r.cls for r in ledger.cap_new(candidates, opened, 5).collect() if r.allowed} == {"c0", "c1", "c2", "c3"}
