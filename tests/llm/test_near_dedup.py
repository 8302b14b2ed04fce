"""The near-dedup stage against exact five-word-shingle Jaccard similarity."""

import random

import numpy as np

from livescope.llm import simhash
from livescope.llm.common import ship_package


def _jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def _crowd(template_words, own_words, n, pairs, seed=2, changes=1):
    """Unrelated texts with a common template, smallest ids first; then near copies of new ones, in pairs."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    template = fresh(template_words)
    texts = [" ".join(template + fresh(own_words)) for _ in range(n + pairs)]
    copies = []
    for t in texts[n:]:
        words = t.split()
        for i in range(changes):
            words[-3 - 7 * i] = f"other{rng.randrange(10**9)}"
        copies.append(" ".join(words))
    return dict(enumerate(texts + copies)), [(n + i, n + pairs + i) for i in range(pairs)]


def _roots(spark, texts, pairs):
    ship_package(spark)
    assert min(_jaccard(texts[a], texts[b]) for a, b in pairs) > 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r.rid: r.root for r in simhash.similar_groups(docs).collect()}


def test_near_copies_beside_unrelated_smaller_texts_are_found(spark):
    texts, pairs = _crowd(170, 70, 600, 100, changes=4)
    root = _roots(spark, texts, pairs)
    assert [(a, b) for a, b in pairs if root[a] != root[b]] == []


def test_crowded_keys_lose_nothing_and_texts_of_one_template_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 5, raising=False)
    texts, pairs = _crowd(150, 100, 60, 30)
    root = _roots(spark, texts, pairs)
    later = dict((b, a) for a, b in pairs)
    assert [i for i in texts if root[i] != later.get(i, i)] == []


def test_spanning_pairs_connect_over_a_dissimilar_head():
    h, x, y = np.full(6, -1), np.zeros(6, np.int64), np.array([-1, 0, 0, 0, 0, 0])
    a, b = simhash.spanning(np.array([h, x, y]).view(np.uint64), 65)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 2)]


def test_nearest_partners_of_larger_groups():
    wide = np.array([[0], [1], [3], [7], [2**64 - 1]], np.uint64)
    a, b, more = simhash.nearest(wide, np.array([1, 1, 2, 3, 4]), 3, 1)
    assert more and set(zip(a.tolist(), b.tolist())) == {(2, 1), (3, 1)}
    a, b, more = simhash.nearest(wide, np.array([1, 1, 2, 3, 4]), 3, 9)
    assert not more and set(zip(a.tolist(), b.tolist())) == {(2, 0), (2, 1), (2, 3), (3, 0), (3, 1)}


def test_exactly_pairs_at_the_threshold_are_linked(spark):
    """Pairs of 300 words with a run replaced, in steps around 0.8: linked if and only if their exact similarity says so."""
    rng = random.Random(8)
    texts, pairs = {}, []
    for n in range(240):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        changed, k = list(words), 10 + n % 60
        changed[100 : 100 + k] = [f"o{rng.randrange(10**9)}" for _ in range(k)]
        texts[n], texts[1000 + n] = " ".join(words), " ".join(changed)
        pairs.append((n, 1000 + n))
    ship_package(spark)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    root = {r.rid: r.root for r in simhash.similar_groups(docs).collect()}
    at = {p: _jaccard(texts[p[0]], texts[p[1]]) for p in pairs}
    assert sum(0.78 < j < 0.8 for j in at.values()) > 5 and sum(0.8 <= j < 0.82 for j in at.values()) > 5
    assert [p for p, j in at.items() if (root[p[0]] == root[p[1]]) != (j >= 0.8)] == []


def test_a_crowd_just_below_the_threshold_stays_apart_and_hides_nothing(spark):
    """All texts of a template have similarity 0.7 to 0.75; some have a partner at 0.85."""
    texts, pairs = _crowd(340, 60, 120, 25, seed=5, changes=3)
    apart = [_jaccard(texts[0], texts[i]) for i in range(1, 30)]
    assert 0.65 < min(apart) and max(apart) < 0.8
    root = _roots(spark, texts, pairs)
    later = dict((b, a) for a, b in pairs)
    assert [i for i in texts if root[i] != later.get(i, i)] == []


def test_ids_that_repeat_and_texts_without_words(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, "x " + long), (2, "other words only here now"), (3, ""), (4, None), (5, " "), (6, "one two"), (7, "ONE  two"), (None, long + " y")]
    ship_package(spark)
    found = {r.rid: r.root for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2] == 1 and found[4] == found[5] == 3 and found[7] == 6 and found[(1 << 63) - 1] == 1


def test_a_crowd_just_below_the_threshold_makes_no_more_rows_than_keys(spark, monkeypatch):
    texts, pairs = _crowd(340, 60, 150, 10, seed=6, changes=3)
    made, stored = {}, simhash.stored

    def counted(df, name):
        found = stored(df, name)
        made[name] = max(made.get(name, 0), found.count())
        return found

    monkeypatch.setattr(simhash, "stored", counted)
    root = _roots(spark, texts, pairs)
    assert [(a, b) for a, b in pairs if root[a] != root[b]] == []
    assert {k: n for k, n in made.items() if n > simhash.KEYS * len(texts)} == {}


def test_parts_of_open_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 20_000)
    texts, pairs = _crowd(340, 60, 120, 25, seed=5, changes=3)
    root = _roots(spark, texts, pairs)
    later = dict((b, a) for a, b in pairs)
    assert [i for i in texts if root[i] != later.get(i, i)] == []


def test_joining_pairs_are_those_of_similar_sets(monkeypatch):
    monkeypatch.setattr(simhash, "PARTNERS", 2)
    rng = random.Random(3)
    base = rng.sample(range(10**9), 100)
    sets = [np.unique(base[: 100 - k] + rng.sample(range(10**9), k)) for k in [rng.randrange(25) for _ in range(60)]]
    group = np.arange(60) // 3
    got = simhash.joining(np.zeros((60, simhash.LANES), np.uint64), group, sets, 5, 0.8)

    def joined(links):
        root = group.copy()
        for a, b in links:
            root[root == root[a]] = root[b]
        return {tuple(np.flatnonzero(root == r)) for r in root}

    similar = [(a, b) for a in range(60) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert set(got) <= {(a, b) for p in similar for a, b in (p, p[::-1])} and len(got) < 20
    assert joined(got) == joined(similar) and len(joined(got)) > 1


def test_balls_of_fingerprints_link_texts_that_share_no_key(spark, monkeypatch):
    """One word of some 2,000 differs, so fingerprints do in few bits; keys that never meet leave the balls alone."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**9)}" for _ in range(2000)] for _ in range(6)]
    texts = {n: " ".join(words) for n, words in enumerate(base)} | {10 + n: " ".join([*words[:-1], "other"]) for n, words in enumerate(base)}
    fp = {n: simhash.wide_simhash(np.unique(simhash.shingle_hashes(t, 5)))[0] for n, t in texts.items()}
    near = {n for n in range(6) if ((fp[n] ^ fp[10 + n]) & (1 << 64) - 1).bit_count() <= 2}
    monkeypatch.setattr(simhash, "_met", lambda batches, most: iter(()))
    roots = _roots(spark, texts, [(n, 10 + n) for n in range(6)])
    assert len(near) >= 4 and all(roots[10 + n] == n for n in near)
    assert all(roots[n] == n for n in range(6))


def test_pairs_that_balls_have_joined_are_not_asked_again(spark):
    met = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 4, 5), (3, 3, 9)], "key long, a long, b long")
    grouped = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, root long")
    assert sorted(tuple(r) for r in simhash._apart(met, grouped).collect()) == [(2, 4, 5), (3, 3, 9)]
