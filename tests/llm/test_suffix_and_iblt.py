import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from livescope.llm import iblt, suffix_dedup

LAST = (1 << 63) - 1


def brute_removed(rows, window):
    first, texts = {}, [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        for i in range(len(raw) - window + 1):
            first[raw[i : i + window]] = min((d, i), first.get(raw[i : i + window], (d, i)))
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] != (d, i):
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(None if d == LAST else d), len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


@pytest.fixture(scope="module")
def repeats(spark, docs):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abc de\né") for _ in range(n))
    shared = [text(rng.choice((90, 95, 100, 130, 400))) for _ in range(6)]
    extra = [(200 + i, text(rng.randrange(150)) + rng.choice(shared) + text(rng.randrange(90)) + rng.choice(shared) * rng.randrange(3), "e") for i in range(60)]
    extra += [(300 + i, text(40) + "-" * 99 + text(40), "hot") for i in range(30)] + [(400, "=" * 1500, "run"), (401, "=" * 700 + "x", "run")]
    return docs.union(spark.createDataFrame(extra, docs.schema))


@pytest.mark.parametrize("sizes", [{}, {"hot": 4, "bucket": 8}])
def test_suffix_dedup_matches_brute_force(repeats, sizes):
    got = suffix_dedup.suffix_dedup(repeats, **sizes).collect()
    rows = [(r.doc_id, r.text) for r in repeats.collect()]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got) == brute_removed(rows, 100)


def test_suffix_dedup_of_blocks_and_nothing(repeats, monkeypatch):
    raw = b"".join((r.text or "").encode() for r in repeats.collect())
    whole = [x[2].sum() for x in suffix_dedup._cut(raw, 100)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    assert sum(x[2].sum() for x in suffix_dedup._cut(raw, 100)) == sum(whole) == len(raw) - 99
    assert suffix_dedup.suffix_dedup(repeats.where("false")).count() == 0


def test_bounded_prefixes_match_comparison():
    rng = np.random.default_rng(1)
    for least in (3, 8):
        s = np.concatenate([rng.integers(1, 3, 300), np.array([1, 2, 1] * 20), [0], rng.integers(1, 3, 50), [0]])
        order = suffix_dedup.suffix_order(s, least)
        assert sorted(order.tolist()) == list(range(len(s)))
        heads = [tuple(s[i : i + least].tolist()) for i in order]
        assert heads == sorted(heads)
        got = suffix_dedup.long_common_prefixes(s, order, least)
        for i in range(1, len(s)):
            if 0 not in heads[i] and len(heads[i]) == least and 0 not in heads[i - 1] and len(heads[i - 1]) == least:
                assert got[i] == (heads[i] == heads[i - 1])


def test_fingerprints_match_brute_force(docs):
    rows = sorted(((LAST if r.doc_id is None else r.doc_id, r.text or "") for r in docs.where("doc_id <> 8 or doc_id is null").collect()), reverse=True)
    got = {(LAST if r.doc_id is None else r.doc_id): r for r in iblt.fingerprints(docs.where("doc_id <> 8 or doc_id is null")).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
        if t == after:
            assert got[d].near_next == 1.0
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(6)
    rows = []
    for key, (common, a, b) in enumerate([(5, 2, 3), (0, 0, 0), (40, 0, 1), (10, 60, 80), (3, 400, 300)]):
        new = lambda n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        both = new(common)
        rows.append((key, both + new(a), new(b) + both))
    for r in iblt.compare(spark.createDataFrame(rows, "key long, a array<long>, b array<long>")).collect():
        a, b = set(rows[r.key][1]), set(rows[r.key][2])
        assert set(r.only_a) == a - b and set(r.only_b) == b - a
        assert r.near == (len(a & b) / len(a | b) if a | b else 1.0)


def test_paragraphs_hold_the_whole_text(docs):
    cut = docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", iblt.paragraphs(F.col("t")).alias("p"))
    for r in cut.unionByName(cut.select(F.repeat("t", 900).alias("t")).select("t", iblt.paragraphs(F.col("t")).alias("p"))).collect():
        assert "".join(r.p) == r.t and len(r.p) <= len(r.t) // 64 + 1


def test_fingerprints_of_one_and_none(docs):
    one = iblt.fingerprints(docs.where("doc_id = 9")).first()
    assert one.near_next == 1.0
    assert iblt.fingerprints(docs.where("false")).count() == 0
    assert iblt.fingerprints(docs).count() == docs.count()
