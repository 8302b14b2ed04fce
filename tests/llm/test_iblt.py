"""Sketches and likeness of edited texts."""

import random
import re

from pyspark.sql import functions as F

from livescope.llm import iblt


def _text(n, seed):
    rng = random.Random(seed)
    return "".join("".join(rng.choice("abcdefgh ij") for _ in range(69)) + "\n" for _ in range(n // 70))


def _cut(text):
    return set(re.findall(r"(?s).{64,256}?\n|.{1,256}", text))


def test_likeness_matches_brute_force_at_any_length(spark):
    lengths = [60_000, 300, 70_000, 70, 140_000, 500, 420, 60_000, 5_000]
    texts = {i: _text(n, i) for i, n in enumerate(lengths)}
    texts[20], texts[21], texts[22] = texts[2][:50_000] + _text(9_000, 77), texts[2], ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        after = texts[order[(at + 1) % len(order)]]
        m = len(texts[i]) // 3
        a = _cut(texts[i])
        for near, other in ((got[i].near_edited, texts[i][: len(texts[i]) - m] + after[:m]), (got[i].near_next, after)):
            b = _cut(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
    assert got[2].near_edited > 0.4 and got[21].near_next > 0.6 and got[21].fingerprint == got[2].fingerprint


def test_sketches_hold_every_digest_and_peel(spark):
    rng = random.Random(9)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(201)]
    sides = [(1, cells, first, part) for cells in (16, 64, 256) for first, part in ((True, keys[:150]), (False, keys[100:]))]
    table = spark.createDataFrame(sides, "key int, cells int, first boolean, held array<long>")
    cells = iblt.sketches(table, "key").collect()
    for size in (16, 64, 256):
        own = [c for c in cells if c.cells == size]
        assert sum(c.na for c in own) == 450 and sum(c.nb for c in own) == 303 and max(c.cell for c in own) < 3 * size
    found = iblt.peeled(iblt.subtract(iblt.sketches(table.where("cells = 256"), "key"), "key"), "key").collect()
    assert all(r.cell == -1 for r in found)
    assert {(r.k, r.n) for r in found} == {(k, 1) for k in keys[:100]} | {(k, -1) for k in keys[150:]}


def test_small_sketches_are_retried_larger(spark):
    rows = [(i, list(range(i * 1000, i * 1000 + n)), list(range(i * 1000 + n // 2, i * 1000 + 2 * n))) for i, n in enumerate((0, 4, 300, 40))]
    for r in iblt.compare(spark.createDataFrame(rows, "key long, a array<long>, b array<long>"), 16).collect():
        a, b = set(rows[r.key][1]), set(rows[r.key][2])
        assert set(r.only_a) == a - b and set(r.only_b) == b - a and abs(r.near - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
