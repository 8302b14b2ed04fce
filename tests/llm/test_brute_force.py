"""Quality, packing and the whole pipeline against independent versions; columns of any name."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from livescope.llm import exact_dedup, packing, quality, simhash, substring_dedup
from livescope.llm.common import crc_mod
from livescope.llm.tokens import tokenizer, vocabulary

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _word(rng):
    return "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad texts, exact copies, near copies and a shared passage, with labels."""
    rng = random.Random(31)
    texts, labels = {}, {}
    for i in range(160):
        words, good = [_word(rng) for _ in range(rng.randrange(90, 240))], rng.random() < 0.75
        texts[i], labels[i] = " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)
    fine = [i for i in texts if labels[i]]
    passage = " ".join(_word(rng) for _ in range(70))
    for n, i in enumerate(fine[:60]):
        new = 1000 + n
        if n < 20:
            texts[new] = texts[i].replace(" ", "\n ")
        elif n < 40:
            words = texts[i].split()
            words[len(words) // 2] = _word(rng) + "x"
            texts[new] = " ".join(words)
        else:
            texts[new] = f"{_word(rng)} {passage} " + " ".join(_word(rng) for _ in range(120))
    texts[3000], texts[3001], texts[3002] = "", None, "word " * 20_000
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, labels


def _model(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)


def test_quality_matches_plain_gradient_descent(spark, corpus):
    folder, texts, labels = corpus
    learn = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = sorted((labels[i], float(sum(quality.features(texts[i]).tolist())), i) for i in learn)
    x, y = np.array([quality.features(texts[i]) for _, _, i in rows]), np.array([v for v, _, _ in rows])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    rng = np.random.default_rng(7)
    better, worse = (rng.choice(np.flatnonzero(y == k), quality.PAIRS) for k in (1, 0))
    apart, w = z[better] - z[worse], np.zeros(z.shape[1])
    ridge = 0.02 * quality.PAIRS / 100
    for _ in range(6000):  # sum of log(1 + exp(-w . difference)) + ridge / 2 |w|^2
        w -= 2e-5 * (-(apart.T @ (1 / (1 + np.exp(apart @ w)))) + ridge * w)
    s = np.sort(z @ w)
    rejected = (y == 0).sum()
    threshold = (s[rejected - 1] + s[rejected]) / 2
    got = {r.doc_id: r.score for r in quality.score(spark.read.parquet(f"{folder}/documents.parquet"), _model(spark, folder)).collect()}
    assert len(got) == len(texts)
    each = {i: np.clip((quality.features(t or "") - x.mean(0)) / (x.std(0) + 1e-6), -8, 8) @ w - threshold for i, t in texts.items()}
    far = [i for i in texts if abs(each[i]) > 0.3]
    assert len(far) > 0.9 * len(texts) and all((got[i] >= 0.5) == (each[i] > 0) for i in far)
    order = np.argsort([each[i] for i in texts]), np.argsort([got[i] for i in texts])
    assert np.corrcoef(np.argsort(order[0]), np.argsort(order[1]))[0, 1] > 0.99


def _shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute_pipeline(texts, model):
    kept = {i: t for i, t in texts.items() if model.scores(quality.features(t or "").reshape(1, -1))[0] >= 0.5}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    kept = {i: kept[i] for i in first.values()}
    sets, root = {i: _shingles(t or "") for i, t in kept.items()}, {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            both = len(sets[i] | sets[j])
            if j < i and (both == 0 or len(sets[i] & sets[j]) / both >= 0.8):
                root[i] = min(root[i], root[j])
    kept = {i: t for i, t in kept.items() if root[i] == i}
    starts, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in kept.items()}
    for i in sorted(kept):
        for at in range(len(words[i]) - 49):
            starts.setdefault(tuple(words[i][at : at + 50]), i)
    for i in sorted(kept):
        gone = set()
        for at in range(len(words[i]) - 49):
            if starts[tuple(words[i][at : at + 50])] < i:
                gone.update(range(at, at + 50))
        left = b" ".join(w for at, w in enumerate(words[i]) if at not in gone).decode()
        if not gone or left:
            out[i] = left if gone else (kept[i] or "")
    return out


def test_pipeline_matches_brute_force(spark, corpus):
    folder, texts, _ = corpus
    want = _brute_pipeline(texts, _model(spark, folder))
    rows = corpus_pipeline.run(spark, folder).collect()
    tok = tokenizer(vocabulary("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in want.items()}
    assert {r.doc_id for r in rows} == set(want) and any(1040 <= i < 1060 for i in want) and not any(1000 <= i < 1040 for i in want)
    filled = {}
    for i in want:
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()] and sum(p.length for p in pieces) == len(ids[i])
        for p in pieces:
            assert p.doc_tokens == len(ids[i]) and p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
            filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_least_squares_leave_less_to_cut_of_lengths_like_documents(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = np.minimum(4095, np.exp(rng.normal(6, 1.2, 2000)).astype(int) + 1).tolist()
    packed = packing.pack(lengths)
    covered = {}
    for s in packed:
        assert sum(n for _, _, n in s) <= 4096
        for i, a, n in s:
            covered.setdefault(i, []).append((a, n))
    for i, n in enumerate(lengths):
        own = sorted(covered[i])
        assert [a for a, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1].tolist()] and sum(k for _, k in own) == n
    cuts = sum(len(s) for s in packed) - len(lengths)
    monkeypatch.setattr(packing, "nnls", lambda a, b, rounds=0: np.zeros(a.shape[1]))
    assert cuts < sum(len(s) for s in packing.pack(lengths)) - len(lengths)


def test_filters_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, 0, 1.5, "a"), (2, text.replace(" ", "  "), 0, 2.5, "b"), (3, text + " tail", 0, None, "c"), (4, " ".join(f"v{i}" for i in range(60)), 0, 1.0, None)]
    for names in (("doc_id", "text", "n_chars", "a.b", "gone_id"), ("doc_id", "text", "rid", "th", "spans"), ("doc_id", "text", "cut", "row", "text_sha256"), ("doc_id", "text", "root", "key`s", "wide")):
        docs = spark.createDataFrame(rows, "x long, t string, n long, p double, q string").toDF(*names)
        assert exact_dedup.first_copies(docs).columns == list(names) and {r[0] for r in exact_dedup.first_copies(docs).collect()} == {1, 3, 4}
        assert simhash.first_of_groups(docs).columns == list(names) and {r[0] for r in simhash.first_of_groups(docs).collect()} == {1, 4}
        cut = substring_dedup.without_repeats(docs)
        assert cut.columns == list(names) and {r[0]: r[1] for r in cut.collect()} == {1: text, 3: "tail", 4: rows[3][1]}
