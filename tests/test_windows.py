"""Documents from files, the order of their checks, counts beside a write, streams in batches."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from livescope.sources import windows
from livescope.streaming import ingest


def _document(**changes):
    doc = {
        "schemaVersion": 2, "buildSha": "b", "artifact": "a", "instanceId": "i", "windowStartMs": 0, "windowEndMs": 60_000,
        "agentHealth": {"environment": "production", "edgesSampleRate": 64}, "classesLoaded": ["app.A"],
        "coverage": [{"class": "app.A", "schemaHash": "h", "probes": "AQ==", "probesInstalled": "/w=="}],
        "errorClasses": {"1": "E", "2": "F"}, "tier2": [{"class": "app.A", "idx": 0, "calls": 3, "errors": 3, "errorsByClass": {"1": 1, "7": 1}, "buckets": [1, 2]}],
        "edges": [{"fromClass": "app.A", "fromIdx": 0, "toClass": "app.A", "toIdx": 1, "count": 5}],
    }
    return {k: v for k, v in (doc | changes).items() if v is not ...}


def test_files_of_every_kind(spark, tmp_path):
    whole = json.dumps(_document(), indent=2).encode()
    packed = gzip.compress(whole)
    bomb = gzip.compress(b" " * 3000 + whole)
    files = {
        "pretty.json": whole, "packed.json": packed, "two-members.gz": gzip.compress(whole[:50]) + gzip.compress(whole[50:]), "cut.json.gz": packed[:-9], "noise.gz": b"\x1f\x8b" + b"x" * 50, "bomb.gz": bomb,
        "large.json": whole + b" " * 3000, "latin.json": b'{"a":"\xe9"}', "empty.json": b"", "deep/list.json": b"[]", "text.txt": b"hello",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    decoded = windows.decode_windows(windows.read_windows(spark, str(tmp_path), largest=len(whole) + 2000))
    got = {r.source_file.split(f"{tmp_path}/")[1]: r.reject_reason for r in decoded.collect()}
    assert got == {
        "pretty.json": None, "packed.json": None, "two-members.gz": None, "cut.json.gz": "bad_gzip", "noise.gz": "bad_gzip", "bomb.gz": "payload_too_large", "large.json": "payload_too_large", "latin.json": "malformed_body",
        "deep/list.json": "malformed_body", "text.txt": "malformed_body",
    }


def test_a_bomb_is_not_unpacked():
    assert windows.unpacked(gzip.compress(b"0" * (65 << 20))) == (None, "payload_too_large")
    assert windows.unpacked(gzip.compress(b"0" * 10)) == ("0000000000", None)


HEALTH = {"environment": "production", "edgesSampleRate": 64}
RECORD = {"class": "app.A", "schemaHash": "h", "probes": "AQ=="}
CASES = [
    ({}, None), ({"artifact": " "}, None), ({"extra": {"a": [1]}}, None), ({"coverage": None, "edges": None, "tier2": None, "errorClasses": None, "classesLoaded": None}, None), ({"coverage": ..., "edges": ...}, None),
    ({"schemaVersion": True}, "bad_field"), ({"schemaVersion": 3}, "schema_version_mismatch"), ({"schemaVersion": ..., "buildSha": ""}, "missing_field"), ({"buildSha": "", "artifact": ...}, "bad_field"),
    ({"buildSha": ..., "artifact": ""}, "missing_field"), ({"buildSha": None}, "bad_field"), ({"windowStartMs": 1.5}, "bad_field"), ({"windowEndMs": -1}, "bad_field"), ({"windowEndMs": 0}, None), ({"agentHealth": []}, "missing_agent_health"),
    ({"agentHealth": HEALTH | {"edgesSampleRate": 48}}, "bad_field"), ({"agentHealth": HEALTH | {"testRunnerDetected": True}, "coverage": 5}, "test_runner_window"), ({"classesLoaded": "app.A"}, "bad_field"),
    ({"classesLoaded": ["app.A", ""]}, "bad_field"), ({"classesLoaded": ["app.A", "org.junit.X"], "coverage": 5}, "test_runner_window"), ({"coverage": {}}, "bad_field"), ({"coverage": [5]}, "bad_field"),
    ({"coverage": [RECORD | {"probes": "A"}, RECORD | {"class": ""}]}, "bad_probe_bitset"), ({"coverage": [RECORD | {"class": ""}, RECORD | {"probes": "A"}]}, "bad_field"), ({"coverage": [RECORD | {"frames": "x"}]}, "bad_field"),
    ({"coverage": [RECORD | {"probes": "A", "frames": ["org.junit.X"]}]}, None), ({"coverage": [RECORD | {"probesInstalled": None}]}, None), ({"coverage": [RECORD | {"probesInstalled": 5}]}, "bad_probe_bitset"),
    ({"coverage": [{"class": "app.A", "schemaHash": "h"}]}, None), ({"errorClasses": []}, "bad_field"), ({"errorClasses": {"0": "E"}}, "bad_error_class_id"), ({"errorClasses": {" 255 ": "E"}}, None), ({"errorClasses": {"1": 5}}, "bad_field"),
    ({"tier2": [{"class": "app.A", "idx": 0, "p90": 4}]}, "bad_field"), ({"tier2": [{"class": "app.A", "idx": 0, "peak": 4}]}, None), ({"tier2": [{"class": "app.A", "idx": True}]}, "bad_field"),
    ({"tier2": [{"class": "app.A", "idx": 0, "bucketScheme": None}]}, "unknown_bucket_scheme"), ({"tier2": [{"class": "app.A", "idx": 0, "buckets": {}}]}, None), ({"tier2": [{"class": "app.A", "idx": 0, "buckets": {"a": 1}}]}, "bad_field"),
    ({"tier2": [{"class": "app.A", "idx": 0, "errorsByClass": {"1": 2.5}}]}, "bad_field"), ({"tier2": [{"class": "app.A", "idx": 0, "errorTypes": [1]}]}, "bad_field"),
    ({"edges": [{"fromClass": "a", "fromIdx": 0, "toClass": "b", "toIdx": 1, "percentage": 1}]}, "bad_field"), ({"edges": [{"fromClass": "a", "fromIdx": 0, "toClass": "b", "toIdx": 1}]}, None), ({"edges": [{"fromClass": "a", "fromIdx": 0, "toClass": "b"}]}, "bad_field"),
    ({"edges": [], "agentHealth": {"environment": "production"}}, None), ({"agentHealth": {"environment": "production"}}, "bad_field"),
]


def test_first_fault_names_the_reject(spark):
    rows = spark.createDataFrame([(n, json.dumps(_document(**change))) for n, (change, _) in enumerate(CASES)], "n int, body string")
    got = {r.n: r.reject_reason for r in windows.decode_windows(rows).collect()}
    assert [(CASES[n][0], got[n]) for n in got if got[n] != CASES[n][1]] == []


def test_environments_and_strict_mode(spark):
    health = [{"environment": "Prod "}, {"environment": "qa"}, {}, {"environment": "prod", "livenessEvidence": False}, {"environment": "prod", "livenessEvidence": None}]
    rows = spark.createDataFrame([(n, json.dumps(_document(agentHealth=h, edges=[], jvmClassification={"env": "dev"}))) for n, h in enumerate(health)], "n int, body string")
    see = lambda **o: [(r.environment, r.production, r.reject_reason) for r in windows.decode_windows(rows, **o).orderBy("n").collect()]
    assert see() == [("prod", True, None), ("qa", False, None), ("dev", False, None), ("prod", False, None), ("prod", True, None)]
    assert [p for _, p, _ in see(allowed=["qa"])] == [True, True, False, False, True]
    assert [r for _, _, r in see(strict=True)] == [None, *["not_production_classified"] * 3, None]


def _written(tmp_path, n):
    for i in range(n):
        changes = [{}, {"buildSha": ""}, {"coverage": [RECORD | {"frames": ["org.junit.X"]}, RECORD | {"class": "app.B"}]}, {"agentHealth": {"environment": "ci", "edgesSampleRate": 1, "edgesDropped": 4, "stripMaskMissing": True}}][i % 4]
        (tmp_path / f"d{i}.json").write_bytes(json.dumps(_document(**({"instanceId": f"i{i}"} | changes))).encode())


def test_stream_in_batches_counts_and_writes_what_a_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _written(tmp_path / "in", 12)
    decoded = windows.decode_windows(windows.read_windows(spark, str(tmp_path / "in")))
    want = ingest.write_tables(decoded, str(tmp_path / "batch"), "epoch=0")
    assert want == decoded.agg(*windows.counters()).first().asDict()
    assert (want["received"], want["accepted"], want["rejected_bad_field"], want["records"], want["test_records"], want["not_evidence"], want["edges_dropped"], want["mask_missing"]) == (12, 9, 3, 9, 3, 3, 12, 3)
    assert len(want) > 40
    parts = ingest.append_windows(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), files=5)
    assert len(parts) == 3 and {k: sum(p[k] for p in parts) for k in want} == want
    assert ingest.append_windows(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")) == []
    for table in ("windows", "coverage", "loads", "edges", "profiles"):
        one, other = (spark.read.parquet(f"{tmp_path}/{side}/{table}") for side in ("batch", "out"))
        text = lambda df: sorted(df.select(F.to_json(F.struct(*sorted(set(df.columns) - {"epoch"}))).alias("x")).toPandas()["x"])
        assert text(one) == text(other), table


def test_endpoints_are_known_or_unverified(spark):
    ends = [("b", 1), ("b", 9), ("c", 9)]
    bodies = [(f"f{n}", json.dumps(_document(buildSha=b, edges=[{"fromClass": "app.A", "fromIdx": 0, "toClass": "app.A", "toIdx": i, "count": 1}]))) for n, (b, i) in enumerate(ends)]
    decoded = windows.decode_windows(spark.createDataFrame(bodies, "source_file string, body string"))
    known = spark.createDataFrame([("b", "app.A", 0), ("b", "app.A", 1)], "build string, cls string, idx int")
    got = {r.source_file: (r.reject_reason, r.edges_verified) for r in windows.check_endpoints(decoded, known).collect()}
    assert got == {"f0": (None, True), "f1": ("unknown_edge_endpoint", True), "f2": (None, False)}


@pytest.mark.parametrize("by_id,named,unresolved,source", [({"1": 2, "9": 1}, {"E": 2}, 1, "errors_by_class"), ({}, {}, 0, "unavailable"), (None, {"old": 4}, 0, "legacy_names")])
def test_errors_by_the_windows_own_table(spark, by_id, named, unresolved, source):
    tier2 = [{"class": "app.A", "idx": 0, "errors": 5, **({"errorsByClass": by_id} if by_id is not None else {}), "errorTypes": {"old": 4}}]
    got = windows.profiles(windows.decode_windows(spark.createDataFrame([(json.dumps(_document(tier2=tier2)),)], "body string"))).first()
    assert (got.named, got.unresolved, got.source, got.unattributed) == (named, unresolved, source, 5 - sum(named.values()))


def test_first_hash_and_seen_bits_over_batches(spark, tmp_path):
    """Three batches and a replay give what one batch gives."""
    def write(folder, n, schema_hash, probes, end):
        doc = _document(instanceId=f"i{n}", windowStartMs=n * 60_000, windowEndMs=end, coverage=[RECORD | {"schemaHash": schema_hash, "probes": probes}, RECORD | {"class": "app.B", "probes": "gA=="}])
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"w{n}.json").write_text(json.dumps(doc))

    windows_ = [("h", "AQ=="), ("h", "Aw=="), ("other", "/w=="), ("h", "AAE="), ("h", "gwE=")]
    see = lambda sink: sorted((r.cls, r.start_ms, r.accepted, r.new_bits) for r in spark.read.parquet(str(sink)).collect())
    for n, (h, bits) in enumerate(windows_):
        write("all", n, h, bits, n * 60_000 + 1)
    ingest.append_guarded(spark, str(tmp_path / "all"), str(tmp_path / "one"), str(tmp_path / "check-one"))
    for batch in ((0, 1), (2,), (3, 4), ()):
        for n in batch:
            write("slowly", n, *windows_[n], n * 60_000 + 1)
        ingest.append_guarded(spark, str(tmp_path / "slowly"), str(tmp_path / "three"), str(tmp_path / "check-three"))
    assert see(tmp_path / "one") == see(tmp_path / "three")
    assert [(ok, n) for c, _, ok, n in see(tmp_path / "one") if c == "app.A"] == [(True, 1), (True, 1), (False, 0), (True, 1), (True, 1)]
    assert [n for c, _, _, n in see(tmp_path / "one") if c == "app.B"] == [1, 0, 0, 0, 0]
