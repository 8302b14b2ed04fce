import hashlib
import re
from collections import defaultdict
from pathlib import Path

import xxhash
from pyspark.sql import functions as F

from livescope.llm import common, exact_dedup, simhash, substring_dedup
from livescope.llm.components import components

LAST = (1 << 63) - 1


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_exact_dedup_matches_grouping(docs):
    by = defaultdict(list)
    for d, t in rows_of(docs):
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    want = []
    for t, ids in by.items():
        keep = min((d for d in ids if d is not None), default=None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    for weak in (None, lambda c: F.length(c).cast("long")):  # the second makes most identifiers clash
        got = exact_dedup.exact_dedup(docs, **({"chunk_hash": weak} if weak else {})).drop("n_chunks")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_chunks_join_to_the_text(docs):
    cut = docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.array_join(exact_dedup.chunks_of(F.col("t")), "").alias("j"))
    assert all(r.t == r.j for r in cut.collect())


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_simhash(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance=2):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_matches_brute_force(spark, docs):
    extra = [(100 + i, " ".join(f"t{j}" for j in range(400)) + " x" * i, "e") for i in range(6)]
    table = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = rows_of(table)
    fp = {t: brute_simhash(t, 3) for _, t in rows}
    root = brute_components(set(fp.values()))
    first = defaultdict(lambda: LAST)
    for d, t in rows:
        first[root[fp[t]]] = min(first[root[fp[t]]], LAST if d is None else d)
    want = sorted((str(d), fp[t], first[root[fp[t]]]) for d, t in rows)
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_dedup(table).collect())
    assert got == want


def test_simhash_links_random_neighbours(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            b ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.add(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(got).collect()}
    want = brute_components(fps)
    same = defaultdict(set)
    for f in fps:
        same[want[f]].add(roots.get(f, f))
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_simhash_of_nothing(none):
    assert simhash.near_dedup(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000 + i, 6000) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(100)) and got[6000] == got[5049] == 5000


def brute_spans(rows, window):
    texts = [(LAST if d is None else d, t.encode().split()) for d, t in rows]
    first = {}
    for d, ws in texts:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, ws in texts:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((None if d == LAST else d, len(ws), sum(gone), kept.decode()))
    return sorted(out, key=str)


def test_substring_dedup_matches_brute_force(spark, docs):
    import random

    rng = random.Random(5)
    words = [f"v{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.choice((50, 51, 60, 90, 300))) for _ in range(5)]
    extra = [(200 + i, " ".join([text(rng.randrange(80)), rng.choice(shared), text(rng.randrange(60)), rng.choice(shared)]), "e") for i in range(60)]
    table = docs.union(spark.createDataFrame(extra, docs.schema))
    for cells in ({}, {"width_bits": 4}):  # so narrow that the sketch takes all windows to be repeated
        got = substring_dedup.substring_dedup(table, **cells)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str) == brute_spans(rows_of(table), 50)


def test_substring_dedup_of_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 64)
    found = list(substring_dedup._pieces_of(docs.select(F.coalesce("doc_id", F.lit(0)), F.lit(0), F.coalesce("text", F.lit(""))).toArrow().to_batches(), 50))
    assert sum(b.column("n").to_numpy().sum() for b in found) == sum(max(0, len(t.split()) - 49) for _, t in rows_of(docs))


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.substring_dedup(none).count() == 0


def test_similar_groups_find_edited_copies_and_leave_the_rest(spark, docs):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, edited = [], 0
    for i in range(150):
        words = [word() for _ in range(rng.randrange(150, 400))]
        rows.append((i, " ".join(words), "x"))
        if i % 2 == 0:  # an edit changes five shingles: about 0.9 alike
            for at in rng.sample(range(len(words)), max(1, len(words) // 100)):
                words[at] = word()
            rows.append((1000 + i, " ".join(words), "x"))
            edited += 1
    kept = {r.doc_id for r in simhash.first_of_groups(spark.createDataFrame(rows, docs.schema)).collect()}
    assert set(range(150)) <= kept and len([d for d in kept if d >= 1000]) <= 0.1 * edited
    assert simhash.first_of_groups(docs).columns == docs.columns and simhash.first_of_groups(docs.where("false")).count() == 0


def test_rows_that_are_set_apart_are_all_rows_once(spark):
    rows = spark.range(0, 200_000, 1, 4).withColumn("text", F.lit("x"))
    found = spark.range(0, 200_000, 50).select(F.col("id").alias("key"))
    asked, others = common.set_apart(rows, F.col("id"), found)
    a, b = ({r.id for r in x.select("id").collect()} for x in (asked, others))
    assert not a & b and len(a) + len(b) == 200_000
    assert set(range(0, 200_000, 50)) <= a and len(a) < 30_000
    asked, others = common.set_apart(rows, F.col("id"), found.where("key < 0"))
    assert not asked.count() and others.count() == 200_000


def test_a_stage_leaves_only_the_table_that_its_result_reads(spark, docs):
    folder = Path(common.run_dir(spark).removeprefix("file:"))
    for stage, left in ((exact_dedup.first_copies, {"later-copies", "marks"}), (simhash.first_of_groups, {"later-near-copies", "marks"}), (substring_dedup.without_repeats, {"span-lists", "marks"})):
        before = set(folder.iterdir())
        kept = stage(docs).count()
        assert {x.name[:-33] for x in set(folder.iterdir()) - before} == left
        assert 0 < kept <= docs.count()
