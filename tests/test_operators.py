"""Golden rows and laws of the operators."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from livescope.functions.buckets import bucket_high, bucket_index, bucket_low
from livescope.functions.redaction import denied_number, denied_text, mask_path
from livescope.operators import admission, coverage, edges, graph, inventory, ledger, phases, profile, traces


def test_buckets_hold_their_values(spark):
    values = [-5, 0, 1, 15, 16, 31, 32, 33, 63, 64, 100, 1000, 10**6, 10**9, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", bucket_index(F.col("v")))
    for r in rows.select("v", "b", bucket_low(F.col("b")).alias("low"), bucket_high(F.col("b")).alias("high")).collect():
        assert r.b == 1023 or r.low <= max(r.v, 0) < r.high
    bounds = spark.range(1023).select(bucket_high(F.col("id")).alias("h"), bucket_low(F.col("id") + 1).alias("l")).where("id < 900").collect()
    assert all(r.h == r.l for r in bounds)


def test_percentiles_of_a_known_histogram(spark):
    h = spark.createDataFrame([("m", 2, 14), ("m", 3, 881), ("m", 4, 306)], "k string, bucket int, n long")
    assert tuple(profile.percentiles(h, "k").first())[1:] == (3, 4, 4)
    assert profile.percentiles(h.where("false"), "k").count() == 0


def test_error_ids_follow_first_sight_and_overflow(spark, monkeypatch):
    monkeypatch.setattr(profile, "ERROR_IDS", 2)
    events = spark.createDataFrame([(i, "w", f"E{i % 4}", True) for i in range(12)], "event_id long, w string, err_name string, err boolean")
    got = sorted((r.error_id, r.err_name, r.n) for r in profile.assign_error_ids(events, "w").collect())
    assert got == [(1, "E0", 3), (2, "E1", 3), (3, "<overflow>", 6)]


@pytest.fixture(scope="module")
def bits(spark):
    day = dt.date(2024, 1, 1)
    rows = [("b", f"pod-{i % 2}", day + dt.timedelta(days=i % 3), "c", i * 5 % 12) for i in range(20)]
    return spark.createDataFrame(rows, "build string, instance string, day date, cls string, idx int")


def test_bits_pack_and_unpack(bits):
    packed = coverage.pack_bits(bits, ["build", "cls"], least_bytes=3)
    assert len(packed.first().octets) == 6
    back = coverage.explode_bits(packed.select("build", "cls", F.unhex("octets").alias("probes")))
    assert {r.idx for r in back.collect()} == {r.idx for r in bits.select("idx").distinct().collect()}
    empty = packed.select("build", "cls", F.lit("").cast("binary").alias("probes"))
    assert coverage.explode_bits(empty).count() == 0


def test_merges_ignore_order_and_replay(bits):
    once = sorted(map(tuple, coverage.merge_bits(bits).drop("windows").collect()))
    assert sorted(map(tuple, coverage.merge_bits(bits.union(bits).orderBy(F.rand(1))).drop("windows").collect())) == once


def test_edges_double_on_replay(spark):
    e = spark.createDataFrame([("b", dt.date(2024, 1, 1), "a", 1, "c", 2, 1024, 7), ("b", dt.date(2024, 1, 2), "a", 1, "c", 2, 64, 5)],
                              "build string, day date, caller_cls string, caller_idx long, callee_cls string, callee_idx long, rate long, observations long")
    agg = edges.edge_agg(e).first()
    assert (agg.observations, agg.windows, agg.min_rate, agg.max_rate) == (12, 2, 64, 1024)
    assert edges.edge_agg(e.union(e)).first().observations == 24
    assert edges.estimate(edges.edge_agg(e)).first().estimated_calls is None
    assert edges.estimate(edges.edge_agg(e.where("rate = 64"))).first().estimated_calls == 320


def test_no_mask_is_not_an_empty_mask(bits):
    state = coverage.installed_state(bits.select("build", "cls", "idx").distinct(), bits.where("idx < 5"))
    assert {r.installed for r in state.collect()} == {True, False}
    silent = coverage.installed_state(bits.select("build", "cls", "idx").distinct(), bits.where("false"))
    assert {r.installed for r in silent.collect()} == {None}


def test_the_first_schema_hash_wins(spark):
    rows = spark.createDataFrame([("b", "c", "x", 1), ("b", "c", "y", 2), ("b", "c", "x", 3)], "build string, cls string, schema_hash string, at int")
    got = {r["at"]: r.accepted for r in coverage.guard_schema(rows, [F.col("at")]).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_environments(spark):
    assert admission.parse_environments(" Prod, ,staging ") == ["prod", "staging"]
    rows = spark.createDataFrame([(None, " PROD "), ("", None), ("qa", "prod")], "a string, b string")
    label, ok = admission.classify_environment([F.col("a"), F.col("b")])
    assert sorted(map(str, rows.select(label.alias("l"), ok.alias("o")).collect())) == sorted(
        ["Row(l='prod', o=True)", "Row(l=None, o=False)", "Row(l='qa', o=False)"]
    )
    said = spark.createDataFrame([(True,), (False,), (None,)], "s boolean").select(admission.evidence_flag(F.lit(True), F.col("s")).alias("e"))
    assert [r.e for r in said.collect()] == [True, False, True]


def test_reachability_stays_tri_state(spark):
    edge = "src long, dst long, resolution string, semantics string"
    calls = spark.createDataFrame([(1, 2, "exact", "blocking"), (2, 1, "cha", "blocking"), (3, 4, "exact", "blocking"), (1, 5, "unresolved", "blocking"), (1, 6, "exact", "no-op"), (9, 7, "exact", "blocking")], edge)
    tests = spark.createDataFrame([(9,)], "ref long")
    triaged = graph.triage(calls, tests)
    found = graph.reachable(spark.createDataFrame([(1,)], "ref long"), triaged.where("category = 'forward'"))
    refs = spark.range(1, 9).select(F.col("id").alias("ref"))
    got = {r.ref: r.static_reachable for r in graph.static_reachable(refs.withColumn("name", F.lit("x")), triaged, found).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None, 5: None, 6: None, 7: None, 8: None}  # 8 is not in the graph


def test_reached_classes_run_their_initialisers(spark):
    methods = spark.createDataFrame([(1, "A", "x"), (2, "A", "<clinit>"), (3, "B", "y"), (4, "C", "<clinit>")], "ref long, cls string, name string")
    calls = spark.createDataFrame([(2, 3)], "src long, dst long")
    found = graph.reachable(spark.createDataFrame([(1,)], "ref long"), calls.union(graph.initialisers(methods)))
    assert {r.ref for r in found.collect()} == {1, 2, 3}


def test_calls_of_initialisers_grow_with_methods_only(spark):
    methods = spark.range(400).selectExpr("id AS ref", "if(id < 390, 'A', 'B') AS cls", "if(id % 4 = 1, '<clinit>', 'm') AS name")
    calls = graph.initialisers(methods)
    assert calls.count() <= 2 * 400  # one for each pair were 38,000
    for root in (0, 5, 1):
        found = graph.reachable(spark.createDataFrame([(root,)], "ref long"), calls)
        assert {r.ref for r in found.collect()} == {root} | set(range(1, 390, 4))


def test_components_of_library_and_test_code_do_not_keep_themselves_alive(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5), (5, 4), (6, 7)], "src long, dst long").withColumns({"resolution": F.lit("exact"), "semantics": F.lit("blocking")})
    own = spark.createDataFrame([("c", 2), ("c", 3), ("d", 4), ("d", 5), ("e", 6), ("f", 7)], "component string, ref long")
    triaged = graph.triage(calls, spark.createDataFrame([], "ref long"), own)
    assert {(r.src, r.dst) for r in triaged.where("category = 'intra_component'").collect()} == {(2, 3), (3, 2), (4, 5), (5, 4)}
    found = graph.reachable(spark.createDataFrame([(1,)], "ref long"), triaged.where("category = 'forward'"))
    assert {r.ref for r in found.collect()} == {1, 2}
    assert {(r.ref, r.only_test, r.only_noop) for r in graph.inbound_kinds(triaged, found).collect()} == {(3, True, False), (4, True, False), (5, True, False), (7, False, False)}
    refs = spark.createDataFrame([(n, "<clinit>" if n == 8 else "x") for n in range(1, 10)], "ref long, name string")
    got = {r.ref: r.static_reachable for r in graph.static_reachable(refs, triaged, found).collect()}
    assert got == {1: True, 2: True, 3: None, 4: None, 5: None, 6: False, 7: None, 8: True, 9: None}


def test_closures_of_long_chains(spark):
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.reachable(spark.createDataFrame([(7,)], "ref long"), chain).count() == 34


def test_caps_rank_the_first_classes_only(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("b", "i", w, f"c{rng.randrange(30):02}", rng.randrange(9), f"d{rng.randrange(3)}", rng.randrange(5), rng.randrange(9)) for w in range(3) for _ in range(900)]
    rows += [("b", "i", 9, "c0", 1, "d", n, 1) for n in range(5)]
    columns = ("build", "instance", "day", *edges.CALLER, *edges.CALLEE)
    got = edges.cap_distinct(spark.createDataFrame(rows, "build string, instance string, day int, caller_cls string, caller_idx int, callee_cls string, callee_idx int, observations long"), 24)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString() and len(columns) == 7
    want = set()
    for w in (0, 1, 2, 9):
        own = sorted({r[:7] for r in rows if r[2] == w})
        want.add(("b", "i", w, min(24, len(own)), sum(r[7] for r in rows if r[2] == w and r[:7] not in own[:24])))
    assert set(map(tuple, got.collect())) == want


def test_places_go_on_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randrange(10**6)) for _ in range(3000)]
    got = graph.placed(spark.createDataFrame(rows, "g string, n long").repartition(6), ["g"], ["n"]).collect()
    for g in "ab":
        assert [(r.n, r.place) for r in sorted(got, key=lambda r: r.place) if r.g == g] == [(n, i + 1) for i, n in enumerate(sorted(n for x, n in rows if x == g))]


def test_descendants_with_a_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, ref long")
    assert sorted(map(tuple, graph.descendants(links).collect())) == sorted((a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b)


def test_intervals_join_when_they_touch(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("b", day(1), day(3)), ("b", day(2), day(4)), ("b", day(4), day(5)), ("b", day(7), day(7)), ("b", day(9), day(10))]
    merged = phases.merge_intervals(spark.createDataFrame(rows, "build string, start date, stop date"))
    assert sorted(tuple(r)[1:] for r in merged.select("build", "start", "stop").collect()) == [(day(1), day(5)), (day(9), day(10))]


def _when(text):
    return dt.datetime.fromisoformat(text)


def test_calendars_expand_within_a_span(spark):
    one = spark.createDataFrame([(dt.date(2026, 1, 5), dt.date(2026, 3, 1))], "start date, stop date")
    found = {(r.p_start, r.p_stop) for r in phases.expand(one, phases.Calendar((), (("m", "last-days-of-month", 2),))).collect()}
    assert (_when("2026-01-30"), _when("2026-02-01")) in found and len(found) == 2
    year = spark.createDataFrame([("b", dt.date(2025, 11, 5), dt.date(2026, 4, 2))], "build string, start date, stop date")
    rules = phases.Calendar((), (("q", "last-days-of-quarter", 0), ("y", "last-days-of-year", 3)), (("d", "2026-04-01T23:00:00", "2026-04-09", "x"), ("d", "2026-04-02", "2026-04-03", "later")))
    got = sorted((r.build, r.phase, str(r.p_start), str(r.p_stop)) for r in phases.expand(year, rules).collect())
    assert got == [
        ("b", "d", "2026-04-01 23:00:00", "2026-04-09 00:00:00"), ("b", "q", "2025-12-31 00:00:00", "2026-01-01 00:00:00"),
        ("b", "q", "2026-03-31 00:00:00", "2026-04-01 00:00:00"), ("b", "y", "2025-12-29 00:00:00", "2026-01-01 00:00:00"),
    ]
    with pytest.raises(ValueError):
        phases.expand(year, phases.Calendar((), (("x", "last-days-of-week", 1),)))
    assert phases.expand(year, phases.Calendar(())).count() == 0


def test_overlap_counts_seconds_over_months(spark):
    merged = spark.createDataFrame(
        [("a", _when("2024-01-01T01:00"), _when("2024-01-01T03:30")), ("a", _when("2024-01-31T22:00"), _when("2024-02-01T05:00")), ("b", _when("2023-11-01"), _when("2024-06-01"))],
        "build string, start timestamp_ntz, stop timestamp_ntz",
    )
    asked = spark.createDataFrame(
        [(b, p, _when(x), _when(y)) for b in "abc" for p, x, y in (("early", "2024-01-01T02:00", "2024-01-01T04:00"), ("turn", "2024-01-31T23:00", "2024-02-01T23:00"), ("long", "2023-12-15", "2024-03-15"))],
        "build string, phase string, p_start timestamp_ntz, p_stop timestamp_ntz",
    )
    got = {(r.build, r.phase): r.covered for r in phases.overlap_seconds(merged, asked).collect()}
    assert got == {("a", "early"): 5400, ("a", "turn"): 6 * 3600, ("a", "long"): 9.5 * 3600, ("b", "early"): 7200, ("b", "turn"): 86400, ("b", "long"): 91 * 86400}


def test_phases_half_seen_or_never(spark):
    days = phases.Calendar(("m", "audit"), (), (("m", "2024-01-01", "2024-01-11", "ten days"), ("m", "2024-01-20", "2024-01-21", "other")))
    merged = spark.createDataFrame([("a", _when("2024-01-01"), _when("2024-01-10T00:00:00")), ("b", _when("2024-01-01"), _when("2024-01-09T23:59:59"))], "build string, start timestamp_ntz, stop timestamp_ntz")
    builds = spark.createDataFrame([("a",), ("b",), ("c",)], "build string")
    got = {(r.build, r.phase): (r.state, r.fraction, r.label) for r in phases.phase_coverage(builds, merged, days).collect()}
    assert got == {
        ("a", "m"): ("covered", 0.9, "ten days"), ("b", "m"): ("too little observed", 0.9, "ten days"), ("c", "m"): ("no occurrence", 0.0, None), **{(b, "audit"): ("no occurrence", 0.0, None) for b in "abc"}
    }
    lists = {r.build: (r.phases_covered, r.phases_missing) for r in phases.phase_lists(phases.phase_coverage(builds, merged, days)).collect()}
    assert lists["a"] == (["m"], ["audit"]) and lists["c"] == ([], ["m", "audit"])


def test_a_missing_calendar_is_the_default(spark, tmp_path):
    found = phases.read_calendar(spark, str(tmp_path / "none.json"))
    assert found.required == ("month-end", "quarter-end", "year-end-close", "peak-season", "dr-drill")
    assert [(r, n) for _, r, n in found.recurring] == [("last-days-of-month", 2), ("last-days-of-quarter", 3), ("last-days-of-year", 5)]
    (tmp_path / "c.json").write_text('{"minCoverageFraction": 0.5,\n "recurring": [{"phase": "x", "rule": "last-days-of-year"}], "occurrences": [{"phase": "y", "start": "2024-01-01T00:00:00", "end": "2024-01-02"}]}')
    own = phases.read_calendar(spark, str(tmp_path / "c.json"))
    assert own.least == 0.5 and own.recurring == (("x", "last-days-of-year", 1),) and own.occurrences[0][0] == "y" and own.required == phases.REQUIRED
    (tmp_path / "bad.json").write_text('{"recurring": [{"phase": "x", "rule": "weekly"}]}')
    with pytest.raises(ValueError):
        phases.read_calendar(spark, str(tmp_path / "bad.json"))


def test_schema_hash_orders_by_the_pair(spark):
    rows = spark.createDataFrame([("c", "pick$inner", "()V"), ("c", "pick", "(I)V")], "cls string, name string, desc string")
    assert inventory.schema_hash(rows).first().schema_hash == hashlib.sha256(b"pick(I)V\npick$inner()V\n").hexdigest()
    assert [r.idx for r in inventory.assign_probe_index(rows).orderBy("name").collect()] == [0, 1]


def test_globs_and_rules():
    assert re.match(inventory.glob_regex("()[L*;"), "()[Lcom.A;") and not re.match(inventory.glob_regex("a[!b]?"), "abx")
    assert inventory.parse_rule("com.acme.A#b   # a comment with # inside") == ("com.acme.A", "b", "*", "a comment with # inside")
    assert inventory.parse_rule("com.acme.A#b(I)V") == ("com.acme.A", "b", "(I)V", "") and inventory.parse_rule("  # only") is None


def test_feedback_needs_ten_judgements(spark):
    rows = [("a", "not_useful")] * 9 + [("b", "not_useful")] * 3 + [("b", "actioned")] * 7 + [("c", "not_useful")] + [("c", "actioned")] * 9
    got = {r.rule_key: r.status for r in ledger.feedback_stats(spark.createDataFrame(rows, "rule_key string, kind string")).collect()}
    assert got == {"a": "ACTIVE", "b": "DISABLED", "c": "PROBATION"}


def test_masks_and_refusals(spark):
    paths = spark.createDataFrame([("/search/101?trace=1&pax=jane",), ("/a/0123456789abcdef-ff/x12y",)], "p string")
    assert [r.m for r in paths.select(mask_path(F.col("p")).alias("m")).collect()] == ["/search/#", "/a/{id}/x#y"]
    texts = spark.createDataFrame([("me@host.org",), ("123456789012",), ("call 9123456789",), ("AAAAA9999A",), ("5123456789 ok",)], "t string")
    assert [r.d for r in texts.select(denied_text(F.col("t")).alias("d")).collect()] == [True, True, True, True, False]
    numbers = spark.createDataFrame([(-123456789012,), (6123456789,), (5123456789,)], "n long")
    assert [r.d for r in numbers.select(denied_number(F.col("n")).alias("d")).collect()] == [True, True, False]


def test_frames_collapse_to_kept_ancestors(spark):
    rng = random.Random(2)
    rows = [(t, o, None if o == 0 else (o - 1) // 2, "f", 5, 5 + (rng.random() < 0.4), None) for t in range(5) for o in range(12)]
    table = spark.createDataFrame(rows, "trace long, ordinal int, parent int, frame string, size_in int, size_out int, threw string")
    skip = {(t, o): o > 0 and a == b for t, o, _, _, a, b, _ in rows}
    want = []
    for t, o, p, *_ in rows:
        if not skip[t, o]:
            via = 0
            while p is not None and skip[t, p]:
                p, via = (p - 1) // 2, via + 1
            want.append((t, o, p, via))
    assert sorted(map(str, map(tuple, traces.collapse(table).collect()))) == sorted(map(str, want))
