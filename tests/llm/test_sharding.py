"""Hash tree against a plain version of it; movement, slots and awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from livescope.llm import sharding
from livescope.llm.sharding import Shard


def _plain(key, tree):
    """Down the tree by least draw, in plain Python."""
    left, prefix = [s for s in tree if s.weight], ""
    for level in (lambda s: s.region, lambda s: s.rack, lambda s: str(s.shard)):
        weights = defaultdict(float)
        for s in sorted(left):
            weights[level(s)] += s.weight

        def draw(name):
            bits = int(hashlib.md5(f"{key}/{prefix}{name}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 0.5) / 2**52) / weights[name], name

        name = min(map(draw, weights))[1]
        left, prefix = [s for s in left if level(s) == name], f"{prefix}{name}/"
    return left[0].shard


UNEVEN = [
    Shard(0, "a", "r1", 1.0), Shard(1, "a", "r1", 3.0), Shard(2, "a", "r2", 2.0), Shard(3, "b", "r1", 0.5), Shard(4, "b", "r1", 2.5),
    Shard(5, "b", "r2", 1.0), Shard(6, "b", "r2", 0.0),
]


def _places(spark, tree, n=4000):
    return {r.id: r.at for r in spark.range(n).select("id", sharding.place(F.col("id").cast("string"), tree).alias("at")).collect()}


def test_places_match_plain_descent_and_follow_weights(spark):
    got = _places(spark, UNEVEN)
    assert all(got[i] == _plain(i, UNEVEN) for i in range(1500))
    count = Counter(got.values())
    assert 6 not in count
    for s in UNEVEN:
        assert abs(count[s.shard] - 400 * s.weight) < 5 * math.sqrt(400 * s.weight + 1) + 1


def test_a_changed_weight_moves_keys_only_through_its_subtrees(spark):
    heavier = [s._replace(weight=4.0) if s.shard == 2 else s for s in UNEVEN]  # in region a, rack r2
    before, after = _places(spark, UNEVEN), _places(spark, heavier)
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved
    region = {s.shard: s.region for s in UNEVEN}
    assert all(region[new] == "a" for _, new in moved)  # nothing enters or moves within region b
    assert all(region[old] == "b" or new == 2 for old, new in moved)  # within region a only rack r2 gains


def test_own_region_takes_keys_only_into_itself(spark):
    tree = sharding.TREE
    for _ in range(3):
        wider = sharding.with_own_region(tree)
        before, after = _places(spark, tree), _places(spark, wider)
        assert {after[i] for i in before if before[i] != after[i]} == {len(tree)}
        tree = wider


def test_rows_of_every_kind(spark, docs, none):
    got = sharding.sharded(docs, sharding.TREE, sharding.GROWN).collect()
    source = docs.collect()
    assert len(got) == len(source)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        assert r.shard == _plain((1 << 63) - 1 if r.doc_id is None else r.doc_id, sharding.TREE)
        assert r.grown_shard in (r.shard, 16)
        by_shard[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else 1 << 63))
    for rows in by_shard.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows))) and [i for _, i in rows] == sorted(i for _, i in rows)
    assert sharding.sharded(none, sharding.TREE).count() == 0
    assert {r.grown_shard for r in sharding.sharded(docs, sharding.TREE).collect()} == {None}


def test_an_id_with_many_rows_and_very_long_texts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x y").alias("text"), F.lit(1).alias("slot"), F.lit(2).alias("part"))
    long = spark.createDataFrame([(-7, "né " * 400_000, 0, 0)], rows.schema)
    got = sharding.sharded(rows.union(long), sharding.TREE).collect()
    assert {r["size"] for r in got if r.doc_id == -7} == {1_600_001}
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1


@pytest.mark.parametrize("bad", [[], [Shard(1, "a", "b", 0.0)], [Shard(1, "a", "b"), Shard(1, "a", "c")], [Shard(1, "a", "b", -1.0)], [Shard(1, "a/b", "c")]])
def test_trees_that_are_none(bad):
    with pytest.raises(ValueError):
        sharding.place(F.lit("x"), bad)
