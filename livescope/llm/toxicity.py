"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

The space: terms are words and their first 4 to 6 letters, kept where the labelled sample
ties them to the label (a likelihood-ratio test), at most ``most_terms``. One pass over
every whole text makes its sparse term counts; document frequencies are then counted over
all documents, and each document with terms is compared with the labelled sample.

The index is inverted: a term has the weights of the examples that hold it, in blocks of
``BLOCK`` examples with each block's greatest weight. A query adds up those maxima, visits
blocks from the greatest bound down, and stops where the bound is below the worst of its
``k`` best: the k nearest are exact. They vote with weight 1 / (distance + 0.1); a logistic
curve, fitted on the sample's own leave-one-out votes, turns the vote into a probability,
and the neighbours are the evidence.

Training takes at most ``per_class`` labelled rows of either label, of smallest hash; with
it vocabulary and index are bounded, so both go to every task.

Cases: null, empty and term-free texts have no neighbours and get the share of toxic
documents among such; labels that are null or contradict one another are not learned from;
with labels of one kind only every score is that label's share, smoothed. Equal cosines go
to the smaller ``doc_id``. Rows that repeat a ``doc_id`` each get a row; other columns are
never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, stored, text_of
from .quality import _labelled, _newton, sample_of

PER_CLASS, MOST_TERMS, K, BLOCK = 2_500, 4_096, 10, 64
#: Likelihood ratio (chi-square with one degree of freedom) from which a term counts.
TIED = 18.0
_WORD = re.compile(r"[^\W\d_]+")
_EVIDENCE = "array<struct<doc_id: long, similarity: double, label: int>>"


def word_terms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = sorted({t for w in set(_WORD.findall(text.lower())) for t in word_terms(w)})
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32())], names=["term", "y"])


def vocabulary(texts: DataFrame, most_terms: int) -> list[str]:
    """Terms of texts(y, text) that go with y = 1, the most tied first."""
    terms = texts.select("y", "text").mapInArrow(_terms_of, "term string, y int")
    totals = texts.groupBy().agg(F.sum("y").alias("t_all"), F.sum(1 - F.col("y")).alias("c_all"))
    seen = terms.groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where("t >= 3")
    seen = seen.crossJoin(F.broadcast(totals))  # one row
    share = F.col("t_all") / (F.col("t_all") + F.col("c_all"))
    n = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0))
    tied = seen.withColumn("ratio", ratio).where((F.col("t") > n * share) & (F.col("ratio") >= TIED))
    return [r.term for r in tied.orderBy(F.desc("ratio"), "term").limit(most_terms).collect()]


def vectors(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, terms, counts: the term counts of every whole text."""
    number = {t: i for i, t in enumerate(terms)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            ids, counts = [], []
            for t in batch.column(1).to_pylist():
                found: Counter[int] = Counter()
                for w in _WORD.findall(t.lower()):
                    got = known.get(w)
                    if got is None:
                        if len(known) > 500_000:
                            known.clear()
                        got = known[w] = tuple(number[x] for x in word_terms(w) if x in number)
                    if got:
                        found.update(got)
                ids.append(sorted(found))
                counts.append([found[i] for i in sorted(found)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind), pa.array(counts, kind)], names=["doc_id", "terms", "counts"])

    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return base.mapInArrow(rows, "doc_id long, terms array<int>, counts array<int>")


class Index:
    """Labelled examples under a block-max inverted index."""

    def __init__(self, examples: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray):
        self.idf = idf
        examples = sorted(examples, key=lambda e: (e[2][:1], e[0]))  # alike examples share blocks
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.int64)
        self.blocks = -(-len(examples) // BLOCK)
        held: dict[int, list[tuple[int, float]]] = {}
        for i, (_, _, terms, counts) in enumerate(examples):
            for t, w in zip(terms, self.weights(terms, counts).tolist(), strict=True):
                held.setdefault(t, []).append((i, w))
        self.postings, self.maxima, self.starts = {}, {}, {}
        for t, own in held.items():
            at, w = np.array([i for i, _ in own]), np.array([w for _, w in own])
            top = np.zeros(self.blocks)
            np.maximum.at(top, at // BLOCK, w)
            self.postings[t], self.maxima[t] = (at, w), top
            self.starts[t] = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)

    def weights(self, terms: list[int], counts: list[int]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, float))) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: list[int], counts: list[int], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """The k examples of greatest cosine above zero, as (cosine, place)."""
        query = [(t, w) for t, w in zip(terms, self.weights(terms, counts).tolist(), strict=True) if t in self.postings] if terms else []
        if not query:
            return []
        bound = sum(w * self.maxima[t] for t, w in query)
        best: list[tuple[float, int, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) == k and bound[block] < -best[-1][0] - 1e-12):
                break
            sums = np.zeros(BLOCK)
            for t, w in query:
                a, b = self.starts[t][block], self.starts[t][block + 1]
                at, own = self.postings[t]
                sums[at[a:b] - block * BLOCK] += w * own[a:b]
            for i in np.flatnonzero(sums > 0).tolist():
                at = block * BLOCK + i
                if self.ids[at] != without:
                    best.append((-round(float(sums[i]), 12), int(self.ids[at]), at))
            best = sorted(best)[:k]
        return [(-s, at) for s, _, at in best]

    def vote(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return 0.0
        weight = np.array([1 / (1 - s + 0.1) for s, _ in found])
        return float((weight * self.labels[[at for _, at in found]]).sum() / (weight.sum() + 1.0))


class Model:
    def __init__(self, index: Index | None, curve: np.ndarray, k: int, terms: list[str]):
        self.index, self.curve, self.k, self.terms = index, curve, k, terms

    def __call__(self, terms: list[int], counts: list[int]) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.nearest(terms, counts, self.k) if self.index else []
        vote = self.index.vote(found) if self.index else 0.0
        return float(1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1])))), found


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS, most_terms: int = MOST_TERMS, k: int = K) -> tuple[Model, DataFrame]:
    """The model, and the vectors of all documents that it was counted on."""
    picked, shares = sample_of(_labelled(labels, learn, label), per_class)
    picked = stored(picked, "toxicity-sample")
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * per_class rows
    terms = vocabulary(stored(texts.select("y", "text"), "toxicity-texts"), most_terms) if min(shares) else []
    held = stored(vectors(docs, terms), "toxicity-vectors")
    frequency, total = np.zeros(len(terms)), held.count()
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # at most most_terms rows
        frequency[r.t] = r.n
    idf = np.log((total + 1) / (frequency + 1)) + 1
    if not min(shares):
        share = (shares[1] + 1) / (sum(shares) + 2)
        return Model(None, np.array([0.0, np.log(share / (1 - share))]), k, terms), held
    sample = held.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "terms", "counts").distinct().collect()
    sample = sorted((r.doc_id, r.y, list(r.terms), list(r.counts)) for r in sample)
    index = Index([e for e in sample if e[2]], idf)
    votes = np.array([index.vote(index.nearest(e[2], e[3], k, without=e[0])) for e in sample], float)
    y = np.array([e[1] for e in sample], int)
    each = np.array([shares[v] / max((y == v).sum(), 1) for v in (0, 1)])[y]
    curve = _newton(np.column_stack([votes, np.ones(len(votes))]), y.astype(float), each / each.mean() if len(each) else each, ridge=0.05)
    return Model(index, curve, k, terms), held


def score(held: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (the nearest labelled examples) of held(doc_id, terms, counts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = [], []
            for terms, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s, found = model(terms, counts)
                scores.append(s)
                evidence.append([{"doc_id": int(model.index.ids[at]), "similarity": c, "label": int(model.index.labels[at])} for c, at in found])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return held.select("doc_id", "terms", "counts").mapInArrow(rows, f"doc_id long, score double, evidence {_EVIDENCE}")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, held = train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 5) != 0)
    return score(held, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("evidence", lambda e: e.doc_id.cast("string")), ",").alias("evidence"),
    )
