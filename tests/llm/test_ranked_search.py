"""Ranked search against brute force over every document; bounds, blocks and awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from livescope.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def _brute(docs, queries, k=10):
    held = [(i, _terms(t)) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, df = sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for q, text in queries:
        asked[q] |= set(_terms(text))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * len(held)) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms & set(c))
            scored += [(-s, R.LAST_ID if i is None else i)] if s > 0 else []
        out += [(q, rank, None if i == R.LAST_ID else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _frames(spark, docs, queries):
    return (spark.createDataFrame([(i, t, 0.0, "x") for i, t in docs], "doc_id long, text string, score double, query string"),
            spark.createDataFrame([(q, t, 1) for q, t in queries], "item_id long, text string, rank int"))


def _got(frame):
    return sorted([(r["query"], r["rank"], r.doc_id, r.score) for r in frame.collect()], key=str)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["Été", "STRASSE", "straße", "x1", "X1"] * 20
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300]))).replace(" w1 ", rng.choice([" ", "-", "\n", "\x00"]))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(3, docs[3][1]), (None, docs[3][1]), (None, None), (900, ""), (901, "-- !!"), (902, "rare " * 3000)]
    queries = [(q, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 80])))) for q in range(60)]
    queries += [(70, docs[3][1]), (71, "rare"), (72, None), (73, "... "), (74, "nowhereatall"), (75, "w1 w2"), (75, "w3"), (None, "rare w1")]
    want = _brute(docs, queries)
    frame, asked = _frames(spark, docs, queries)
    indexed = R.index(frame.repartition(5))
    assert _got(R.search(indexed, asked)) == want
    monkeypatch.setattr(R, "BLOCK_TERMS", 50)  # many blocks
    monkeypatch.setattr(R, "AT_ONCE", 3000)
    assert _got(R.search(indexed, asked, k=3)) == _brute(docs, queries, 3)


def test_nothing_to_search(spark, none):
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert R.search(R.index(none), asked).count() == 0
    frame, empty = _frames(spark, [(1, "one"), (2, None)], [])
    assert R.search(R.index(frame), empty).count() == 0
    blank, _ = _frames(spark, [(1, ""), (2, None)], [])
    assert R.search(R.index(blank), asked).count() == 0


def test_very_long_texts_are_cut_between_terms(spark, monkeypatch):
    text = ("alpha Beta, " * 3000 + "z" * 5000 + " gamma").encode()
    want = R.terms_of(text)
    for part in (7, 100, 4999, 40_000):
        monkeypatch.setattr(R, "PART", part)
        assert R.terms_of(text) == want
    assert R.terms_of(b"abc" * 30_000) == Counter({b"abc" * 30_000: 1})
    assert R.terms_of(b" " * 50_000) == Counter()
    monkeypatch.undo()
    docs = [(1, text.decode() * 40), (2, "gamma")]
    frame, asked = _frames(spark, docs, [(1, "gamma alpha")])
    assert _got(R.search(R.index(frame), asked)) == _brute(docs, [(1, "gamma alpha")])


counts = st.dictionaries(st.integers(0, 60).map(lambda n: b"t%d" % n), st.integers(1, 10**7), max_size=25)


@settings(deadline=None, max_examples=60)
@given(st.lists(counts.filter(bool), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=30), min_size=1, max_size=5))
def test_bounds_are_never_below_scores(documents, queries):
    block = R._block([(q, [(b"t%d" % t, 37 * t) for t in sorted(terms)]) for q, terms in enumerate(queries)], 100, 10_000)
    ms = np.array([10 + 7 * d for d in range(len(documents))], np.int64)
    upper = R.bounds(block, [R.sketch_of(Counter(c)) for c in documents], ms)
    for d, held in enumerate(documents):
        for q, terms in enumerate(block.terms):
            assert upper[d, q] >= sum(w * R.impact(held[t], int(ms[d])) for t, w in terms if t in held)


def test_bounds_prune(spark):
    """Documents without a query's terms are mostly told apart by their sketches alone."""
    rng = random.Random(1)
    sketches = [R.sketch_of(Counter({b"d%d-%d" % (d, t): rng.randrange(1, 5) for t in range(200)})) for d in range(200)]
    block = R._block([(0, [(b"q%d" % t, 1) for t in range(100)])], 200, 40_000)
    upper = R.bounds(block, sketches, np.full(200, 100, np.int64))
    assert np.mean(upper / R.impact(1, 100)) < 20  # some 5 of 100 terms by chance, with counts up to 4
