import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from livescope.llm import bpe, packing, tokens

BYTE, WORD = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("word_bpe_49k.json")
AWKWARD = [
    "", " ", "\n\n a  b\t\tc \r\n", "don't won't I'LL 's's ''s", "x<|endoftext|> y  <|endoftext|>", "<|startoftext|>", "a\x1cb\x1d c\x85d e  f　g",
    "É é ́x ΑΣ ΑΣ. ﬁ ǅ İ", "漢字かな混じり文" * 30, "😀👩‍👩‍👧 ﻿​", "1234567890 12.5%", "a" * 5000, " " * 300 + "z", "-" * 700 + "'s", "\n" * 99 + "q",
]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_units_give_the_library_s_ids(path, kind):
    enc, rng = tokens.Encoder(path, kind), random.Random(1)
    alphabet = list("ab eE\n\t'.,-!19é漢́ \u0085 ") + ["'s", "  ", "\r\n", "the ", "İ"]
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert enc.encode(t).tolist() == enc.whole(t).tolist(), repr(t)
        if kind == "byte":
            assert enc.decode(enc.encode(t)) == enc.tok.decode(enc.whole(t).tolist(), skip_special_tokens=False)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    enc = tokens.Encoder(BYTE, "byte")
    t = " ".join(f"w{i % 70}" for i in range(500))
    assert enc.encode(t).tolist() == enc.whole(t).tolist()


def test_tree_concatenation_is_exact():
    enc, rng = tokens.Encoder(BYTE, "byte"), random.Random(2)
    kinds = ["abcdefgh", "ab ", " \n", "!'-s", "0123456789", "éß漢字", "aA1 .\n'st"]
    for trial in range(400):
        t = "".join(rng.choice(kinds[trial % len(kinds)]) for _ in range(rng.randrange(2, 900)))
        at = rng.randrange(1, len(t))
        got = bpe.join(enc, enc.whole(t[:at]), enc.whole(t[at:]))
        assert got.tolist() == enc.whole(t).tolist(), repr(t)


def test_encode_and_decode_whole_tables(spark, docs):
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(AWKWARD)] + [(50, None, "x"), (50, "twice", "x"), (50, "twice", "x"), (None, "no id", "x")], docs.schema)
    enc = tokens.Encoder(BYTE, "byte")
    want = sorted((str(r.doc_id), enc.whole(r.text or "").tolist(), r.text or "") for r in table.collect())
    for longest in (1 << 16, 50):
        got = bpe.decode(bpe.encode(table, BYTE, longest=longest), BYTE).collect()
        assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == want
    assert bpe.decode(bpe.encode(table.where("false"), BYTE), BYTE).count() == 0


def check_packing(pieces, rows, enc):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for d, t in rows:
        ids = [*enc.whole(t or "").tolist(), packing.END_ID]
        own = sorted(by_doc[d], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and all(p.doc_tokens == len(ids) for p in own)
        assert [x for p in own for x in np.frombuffer(p.ids, np.uint32).tolist()] == ids
    waste = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        used = sum(p.length for p in own)
        assert used <= packing.WINDOW and all(p.length > 0 for p in own)
        waste += packing.WINDOW - used
    return waste, len(by_sequence)


def test_packing_keeps_every_id_and_fills_windows(spark, docs):
    rng = random.Random(4)
    rows = [(i, " ".join("word" for _ in range(rng.choice((0, 1, 5, 300, 900, 2000, 4095, 4096, 9000)))), "x") for i in range(150)] + [(900, None, None)]
    table = spark.createDataFrame(rows, docs.schema)
    waste, sequences = check_packing(packing.packed(table, WORD).collect(), [(d, t) for d, t, _ in rows], tokens.Encoder(WORD, "word"))
    assert waste < packing.WINDOW
    digest = packing.digests(packing.packed(table.where("doc_id = 3"), WORD)).collect()
    assert sum(r.length for r in digest) == digest[0].doc_tokens and all(0 <= r.ids_crc32 < 1 << 32 for r in digest)
    assert packing.packed(table.where("false"), WORD).count() == 0


def test_packing_of_repeated_rows(docs):
    got = packing.packed(docs, WORD)
    assert got.agg(F.sum("length")).first()[0] == packing.tokens(docs, WORD).agg(F.sum("n")).first()[0]
    one = got.where("doc_id = 1").first()
    assert zlib.crc32(one.ids) == zlib.crc32(np.array([2], np.uint32).tobytes())


def test_non_negative_least_squares_uses_up_an_exact_histogram():
    table = packing.combinations(8, 3)
    assert (table.T @ np.arange(9) == 8).all()
    want = np.zeros(table.shape[1])
    want[[2, 5]] = 30, 12
    assert np.abs(table @ packing.nnls(table, table @ want) - table @ want).max() < 0.2


def test_shards_follow_the_table(spark):
    counts = spark.range(500).select(F.col("id").alias("row"), (F.col("id") * 37 % 5000 + 1).alias("n"))
    pieces = packing.plan(counts, shard=100)
    assert pieces.agg(F.sum("length")).first()[0] == counts.agg(F.sum("n")).first()[0]
    assert pieces.select((F.col("sequence_id") / (1 << 32)).cast("int").alias("s")).distinct().count() == 5


def test_packing_keeps_a_bounded_number_of_units(spark):
    """A worker's memory is cache entries times cores, and the pipeline shares its executor with all stages before."""
    from livescope.llm import packing

    assert getattr(packing, "CACHE", tokens.CACHE) <= 400_000
    path = tokens.vocabulary("word_bpe_49k.json")
    small, texts = tokens.Encoder(path, "word", 40), [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(30)]
    for t in texts * 2:
        assert small.encode(t).tolist() == small.whole(t).tolist()
        assert len(small.known) + len(small.older) <= 40
