import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from livescope.llm import lm_score, quality, toxicity
from livescope.llm.common import crc_mod

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randrange(30, 200))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(("nasty", "vile", "awful")))
        rows.append((i, " ".join(words) + ".", "x"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, docs.schema).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)), spark.createDataFrame(
        [*labels, (1, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int"
    )


def test_quality_separates_held_out_documents(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    held = got.join(labels, "doc_id").where(crc_mod(F.col("doc_id"), 3) == 1).toPandas()
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.97
    assert quality.accepted(docs, model).columns == docs.columns
    one = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert one.scores(np.zeros((1, 26)))[0] > 0.9 and quality.score(docs.where("false"), model).count() == 0


def test_toxicity_votes_with_evidence(labelled):
    docs, labels = labelled
    model, held = toxicity.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    got = toxicity.score(held, model)
    assert got.count() == docs.count()
    out = got.join(labels, "doc_id").where(crc_mod(F.col("doc_id"), 5) == 0).toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.97
    assert all(len(e) for e, s in zip(out.evidence, out.score, strict=True) if s >= 0.5)
    nothing, empty = toxicity.train(docs.where("false"), labels, F.lit(True))
    assert toxicity.score(empty, nothing).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    idf = rng.random(30) + 0.5
    examples = [(i, int(rng.integers(2)), sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist()), None) for i in range(400)]
    examples = [(i, y, t, rng.integers(1, 5, len(t)).tolist()) for i, y, t, _ in examples]
    index = toxicity.Index(examples, idf)
    dense = np.zeros((400, 30))
    for i, _, t, c in examples:
        dense[i, t] = index.weights(t, c)
    for i, _, t, c in examples[:60]:
        want = sorted((-round(float(s), 12), j) for j, s in enumerate(dense @ dense[i]) if s > 0 and j != i)[:10]
        got = [(-s, int(index.ids[at])) for s, at in index.nearest(t, c, 10, without=i)]
        assert [j for _, j in got] == [j for _, j in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_match_brute_force(docs, order):
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    counts = {}
    for _, ws in rows:
        for n in range(1, order + 1):
            for i in range(len(ws) - n + 1):
                counts[tuple(ws[i : i + n])] = counts.get(tuple(ws[i : i + n]), 0) + 1
    total = sum(len(ws) for _, ws in rows)

    def word(ws, i):
        for n in range(min(order, i + 1), 1, -1):
            gram = tuple(ws[i - n + 1 : i + 1])
            if counts[gram] >= 2:
                return np.log(counts[gram] / counts[gram[:-1]]) + np.log(0.4) * (min(order, i + 1) - n)
        return np.log(counts[ws[i],] / total) + np.log(0.4) * (min(order, i + 1) - 1)

    want = sorted((str(d), len(ws), round(sum(word(ws, i) for i in range(len(ws))), 6)) for d, ws in rows)
    got = sorted((str(r.doc_id), r.n_words, round(r.score, 6)) for r in lm_score.lm_scores(docs, order=order, batch_bytes=2000).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)
    assert lm_score.lm_scores(docs.where("false")).count() == 0


def test_pipeline_stages_keep_the_columns_and_the_clean(spark, labelled, tmp_path):
    docs, labels = labelled
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 600)
    table = docs.unionByName(copies).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if number < 4:
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{number}")
        held = spark.read.parquet(f"{tmp_path}/{number}")
        sizes.append(held.count())
    good = {r.doc_id for r in labels.where("quality = 1 and doc_id < 300").collect()}
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert len(good - kept) <= 4 and not {d for d in kept if 600 <= d < 620}
    assert sizes[1] < sizes[0] and spark.read.parquet(f"{tmp_path}/4").select("doc_id").distinct().count() == sizes[3]


def test_quality_learns_from_every_labelled_row(spark):
    """3,400 rows of one label, so many that none of them may be left out for being many."""
    docs = spark.range(3700).selectExpr("id AS doc_id", "if(id < 3400, repeat(concat('word', id, ' '), cast(id % 7 + 1 as int)), concat('#!', id, ' #!')) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 3400 as int) AS quality")
    model = quality.train(docs, labels, F.lit(True))
    x = np.array([quality.features(r.text) for r in docs.collect()])
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-9) and np.allclose(model.scale, x.std(axis=0) + 1e-6, rtol=1e-6)
    s = np.sort(model.scaled(x) @ model.w)
    assert abs(model.threshold - (s[299] + s[300]) / 2) < 1e-9


def test_every_labelled_row_is_compared_however_rare_the_other_label(spark):
    marked = spark.range(1000).selectExpr("id AS doc_id", "cast(id >= 3 as int) AS y", "array(cast(id as double)) AS x")
    groups = [[(r.y, r.x[0]) for r in g.rows] for g in quality.grouped(marked, {0: 3, 1: 997}, 50).collect()]
    assert all({y for y, _ in g} == {0, 1} for g in groups) and {x for g in groups for _, x in g} == set(range(1000)) and max(map(len, groups)) < 120


def test_compared_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    y, z, w = np.array([0, 1, 1, 0, 1]), rng.normal(size=(5, quality.WIDTH)), rng.normal(size=quality.WIDTH)
    d = np.array([a - b for a in z[y == 1] for b in z[y == 0]])
    p = 1 / (1 + np.exp(-d @ w))
    got = quality._compared(y, z, w)
    assert got[0] == 6 and np.allclose(got[1:27], (p - 1) @ d) and np.allclose(got[27:].reshape(26, 26), (d.T * (p * (1 - p))) @ d)


def test_the_place_of_a_value_is_exact(spark):
    values = [0.5] * 5 + [1e-300, 3.0, 3.0000000001, 7e9, -2.0] + [float(i) / 7 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [quality.nth(df, k) for k in (0, 1, 6, 1500, 3009)] == [sorted(values)[k] for k in (0, 1, 6, 1500, 3009)]


def test_packed_texts_are_the_texts_and_smaller(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(7)) for _ in range(400)]
    rows = [(i % 3, i if i % 7 else None, " ".join(rng.choices(words, k=rng.randrange(300))) + "é") for i in range(200)] + [(4, 900, "")]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:b])], names=["batch", "doc_id", "text"]) for a, b in ((0, 90), (90, 201))]
    monkeypatch.setattr(lm_score, "PACK_BYTES", 60_000)
    packs = pa.Table.from_batches(lm_score._packed(iter(batches)))
    got = [tuple(r.values()) for b in (0, 1, 2, 4) for r in lm_score._unpacked(packs.filter(pa.compute.equal(packs.column("batch"), b))).to_pylist()]
    assert sorted(got, key=str) == sorted(rows, key=str) and packs.num_rows == 7
    assert sum(map(len, packs.column("texts").to_pylist())) < 0.5 * sum(len(t.encode()) for _, _, t in rows)
    assert list(lm_score._packed(iter([]))) == []
