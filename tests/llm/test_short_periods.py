"""Suffix-array dedup against brute force."""

import random

from livescope.llm import suffix_dedup
from livescope.llm.common import ship_package


def _brute(texts, window=100):
    seen, out = set(), {}
    for i in sorted(texts):
        raw, gone = texts[i].encode(), set()
        for at in range(len(raw) - window + 1):
            held = raw[at : at + window]
            if held in seen:
                gone.update(range(at, at + window))
            seen.add(held)
        out[i] = (len(gone), bytes(b for j, b in enumerate(raw) if j not in gone))
    return out


def _texts():
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    runs = [(unit * 400)[:n] for unit in ("=", "ab", "x-_", fresh(17), fresh(60), fresh(69)) for n in (101, 150, 200, 354)] + ["=" * (100 + 509)]
    texts = [fresh(80) + run.translate(str.maketrans("=x", chr(0x21 + i) * 2)) + fresh(80) for i, run in enumerate(runs)]
    texts += [texts[2], texts[7], texts[-1]]
    return dict(enumerate(texts))


def test_short_periods_inside_one_document_and_its_copies(spark):
    ship_package(spark)
    texts = _texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == _brute(texts)
