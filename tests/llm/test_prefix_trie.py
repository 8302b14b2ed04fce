"""The trie against plain sets of prefixes, over one and many partitions; rebuilt conversations; awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from livescope.llm import prefix_trie as T

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _brute(sequences):
    """Nodes of {conv_id: [(what, words), ...]} by their prefixes."""
    members, words = defaultdict(list), {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            words[tuple(seq[:d])] = seq[d - 1][1] if d else 0
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, of in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(of) - 1) * words[path]
    out = []
    for path, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(sequences[c]) == len(path))))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in frame.collect()), key=str)


def _sequences(spark, sequences):
    rows = [(c, bytearray(b"".join(hashlib.md5(repr(t).encode()).digest() for t in seq)), [w for _, w in seq]) for c, seq in sequences.items()]
    return spark.createDataFrame(rows, "conv_id long, key binary, words array<long>")


@pytest.fixture
def spread(spark):
    """Every shuffle keeps all its partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def to(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 3), (3, 9), (4, 25)])
def test_matches_sets_of_prefixes(spark, spread, seed, partitions):
    rng = random.Random(seed)
    alphabet = [(f"t{n}", rng.randrange(0, 9)) for n in range(rng.choice([2, 3, 6]))]
    long = [rng.choice(alphabet) for _ in range(40)]
    sequences = {}
    for c in rng.sample(range(-500, 5000), 400):
        kind = rng.random()
        if kind < 0.3:
            sequences[c] = long[:17]  # a third of all, cut over several partitions
        elif kind < 0.5:
            sequences[c] = long[: rng.randrange(41)]
        else:
            sequences[c] = [rng.choice(alphabet) for _ in range(rng.randrange(7))]
    spread(partitions)
    assert _rows(T.prefix_trie(_sequences(spark, sequences))) == _brute(sequences)


@pytest.mark.parametrize("sequences", [
    {5: []}, {5: [], 3: []}, {7: [("a", 1)]}, {1: [("a", 1)], 2: [("a", 1)], 0: [("a", 1), ("b", 2)], 9: [("b", 3)]},
    {n: [("a", 2)] * 3 for n in range(60)}, {n: [("a", 2)] * n for n in range(40)},
])
@pytest.mark.parametrize("partitions", [1, 7])
def test_small_shapes(spark, spread, sequences, partitions):
    spread(partitions)
    assert _rows(T.prefix_trie(_sequences(spark, sequences))) == _brute(sequences)


def test_small_pieces_and_batches(spark, spread, monkeypatch):
    spread(5)
    sequences = {n: [("a", 2), ("b", 1)][: n % 3] + [(f"z{n % 11}", 1)] * (n % 5 == 0) for n in range(300)}
    monkeypatch.setattr(T, "PIECE", 4)
    monkeypatch.setattr(T, "BATCH", 3)
    assert _rows(T.prefix_trie(_sequences(spark, sequences))) == _brute(sequences)


def test_rebuilt_conversations_and_awkward_rows(spark, spread):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 120), 400, 401, 405, -3, -20, -25]:
        if c % 20 == 0 and c in (60, 400):
            continue  # blocks without a first conversation
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t if t or c % 7 else None, rng.choice(["user", None, "système"]), rng.choice(["a b c", "", None, " x\ty ", "a b c " * 2000]), 1, "k"))
    rows += [(None, 0, "user", "lost", 1, "k"), (3, 0, "user", "tie", 1, "k"), (3, 0, "user", "tie", 1, "k"), (3, 0, "user", "tie too", 1, "k")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, key string")
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((t is not None, t or 0, digest), (digest, len(re.findall(r"[^\x20\x09-\x0D]+", text)))))
    own = {c: [turn for _, turn in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c - 20 * int(c / 20))
        whole[c] = own.get(base, [])[:h] + t[h:]
    assert any(not t for t in whole.values())
    spread(6)
    assert _rows(T.prefix_trie(T.rebuilt(frame))) == _brute(whole)
    assert _rows(T.prefix_trie(T.rebuilt(frame.where("false")))) == []


def test_common_turns():
    a, b = bytes(range(160)), bytes(range(80)) + bytes(80)
    assert T.common_turns(a, a) == 10 and T.common_turns(a, b) == 5 and T.common_turns(a, b"") == 0 and T.common_turns(a, a[:48]) == 3
