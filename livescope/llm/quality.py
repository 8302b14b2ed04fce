"""Quality by Bradley-Terry ranking: scores learned from preferences between documents.

Every document has a vector of features of its whole text. A document labelled 1 is
preferred to one labelled 0; weights are learned by logistic loss on the feature
differences of such pairs, so that a document's score is how often it would be preferred.
The threshold is the quantile of the training scores at the share of rejected documents,
and the score is a logistic curve through it, 0.5 at the threshold.

Training takes every labelled row. They are dealt by hash into groups of some ``group`` rows, and in a
group each row labelled 1 is compared with each labelled 0, so comparisons grow with the rows and not with
their square; rows of a label too rare for that go to several groups. A Newton step is one pass over the
stored features, of which tasks return sums only. The threshold is the exact quantile over all of them.
Scoring reads every whole text in one pass.

Cases: null text is empty and is scored like any text; labels that are null, or of a
document with both labels, are not learned from; with labels of one kind only every score
is that label's share, smoothed, and one half without any label. A table without rows gives none;
texts are read whole at any length. Rows that repeat a ``doc_id`` each get a row; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, stored, text_of

#: Comparisons that the ridge of 0.02 a hundred is told for.
PAIRS = 20_000
#: Rows of a group, about, and rows of either label in it at least, about.
GROUP, FEWEST = 2_000, 16
_UPPER = bytes(range(65, 91))
_WORDY = bytes(range(48, 58)) + _UPPER + bytes(range(97, 123)) + bytes(range(128, 256)) + b" \t\n\v\f\r"
_ALL = bytes(range(256))
_NOT_UPPER = bytes(b for b in _ALL if b not in _UPPER)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if chr(b) not in ".,;:'\"-()?!" and not chr(b).isalnum()]] = True


def _rate(part: float, whole: float) -> float:
    return float(np.log1p(100 * part / max(whole, 1)))


def features(text: str) -> np.ndarray:
    raw = text.encode()
    n = len(raw)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x]
    odd = [len(x.translate(None, _WORDY)) / len(x) for x in lines] or [0.0]
    upper = [len(x.translate(None, _NOT_UPPER)) / len(x) for x in lines] or [0.0]
    shares = histogram[histogram > 0] / max(n, 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    count = len(words)
    return np.array(
        [
            np.log1p(n),
            np.log1p(count),
            np.log1p(len(lines)),
            np.log1p((n - count) / max(count, 1)),
            _rate(histogram[_SYMBOLS].sum(), n),
            _rate(histogram[33] + histogram[63], n),
            _rate(histogram[124], n),
            _rate(histogram[48:58].sum(), n),
            _rate(histogram[65:91].sum(), n),
            _rate(histogram[[46, 44, 59, 58]].sum(), n),
            _rate(histogram[[60, 62, 123, 125, 47, 92]].sum(), n),
            _rate(histogram[127:].sum() + histogram[:9].sum() + histogram[14:32].sum(), n) - _rate(histogram[128:].sum(), n),
            float(-(shares * np.log(shares)).sum()) if n else 0.0,
            len(distinct) / max(count, 1),
            len(distinct) / max(count, 1) ** 0.8,
            _rate(again, count),
            len(set(lines)) / max(len(lines), 1),
            np.log1p(n / max(len(lines), 1)),
            _rate(max(odd), 1),
            _rate(float(np.mean(odd)), 1),
            _rate(max(upper), 1),
            _rate(float(np.mean(upper)), 1),
            sum(x[-1:] in b".!?" for x in lines) / max(len(lines), 1),
            sum(o > 0.12 for o in odd) / max(len(lines), 1),
            sum(u > 0.3 for u in upper) / max(len(lines), 1),
            float(n == 0),
        ]
    )


#: Numbers in features().
WIDTH = 26


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, float).reshape(len(rows), WIDTH)


def _climb(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, rounds: int = 30) -> np.ndarray:
    """Newton's steps from zero by slopes(w): gradient and second derivatives."""
    w = np.zeros(width)
    for _ in range(rounds):
        step = np.linalg.solve(*slopes(w)[::-1])
        w -= step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Logistic regression without intercept."""

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (weight * (p - y)) + ridge * w, (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))

    return _climb(slopes, x.shape[1], rounds)


class Model:
    """score(features) in (0, 1); 0.5 at the quantile threshold. With a constant every score is that."""

    def __init__(self, constant: float | None = None, mean: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.constant, self.mean, self.scale = constant, mean, scale
        self.w, self.threshold, self.slope = np.zeros(WIDTH), 0.0, 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.scaled(x) @ self.w - self.threshold), -30, 30)))


def _labelled(labels: DataFrame, learn: Column, label: str) -> DataFrame:
    """doc_id, y: one row for each document with one label, of those to learn from."""
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", "y")


def sample_of(labelled: DataFrame, per_class: int) -> tuple[DataFrame, tuple[float, float]]:
    """At most per_class rows of either label, and how many rows have either."""
    counts = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    picked = labelled.where("y = 0").orderBy(order, "doc_id").limit(per_class).union(labelled.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    return picked, (float(counts.get(0, 0)), float(counts.get(1, 0)))


def _array(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, WIDTH)


def _total(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part(batch), one array a task to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [0.0]
        for batch in batches:
            if batch.num_rows:
                own = own + part(batch)
        if len(own) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64()))], names=["v"])

    return np.sum([r.v for r in rows.mapInArrow(sums, "v array<double>").collect()], axis=0)


def grouped(marked: DataFrame, rows: dict[int, int], group: int = GROUP) -> DataFrame:
    """group, rows: marked(doc_id, y, x) dealt by hash into groups to be compared within; every row is in one at least.

    rows: how many have label 0 and 1. A label with under FEWEST rows a group goes to several groups each.
    """
    groups = -(-sum(rows.values()) // group)
    copies = {y: min(groups, -(-FEWEST * groups // n)) for y, n in rows.items()}
    often = F.sequence(F.lit(0), F.when(F.col("y") == 0, copies[0]).otherwise(copies[1]) - 1)
    dealt = marked.select("doc_id", "y", "x", F.explode(often).alias("copy"))
    own = F.pmod(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(groups)) + F.col("copy"), F.lit(groups)).alias("group")
    return dealt.select(own, "y", "x").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("rows"))


def _compared(y: np.ndarray, z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of one group: comparisons, and gradient and second derivatives of their loss."""
    better, worse = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp(-np.clip(np.subtract.outer(better @ w, worse @ w), -30, 30)))
    curve = p * (1 - p)
    gradient = (p - 1).sum(axis=1) @ better - (p - 1).sum(axis=0) @ worse
    cross = better.T @ curve @ worse
    second = (better.T * curve.sum(axis=1)) @ better + (worse.T * curve.sum(axis=0)) @ worse - cross - cross.T
    return np.concatenate([[p.size], gradient, second.ravel()])


def _weights(groups: DataFrame, model: Model) -> np.ndarray:
    ridge = 0.02 / 100

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            own, at = batch.column(0), np.append(0, np.cumsum(pc.list_value_length(batch.column(0)).to_numpy()))
            y, x = own.flatten().field("y").to_numpy(), _array(own.flatten().field("x"))
            return np.sum([_compared(y[a:b], model.scaled(x[a:b]), w) for a, b in zip(at, at[1:], strict=False)], axis=0)

        sums = _total(groups.select("rows"), part)
        got, n = sums[1:] / max(sums[0], 1), WIDTH
        return got[:n] + ridge * w, got[n:].reshape(n, n) + ridge * np.eye(n)

    return _climb(slopes, WIDTH)


def nth(values: DataFrame, place: int) -> float:
    """The value s of that place, from 0, in ascending order: narrowed down by counts of a thousand ranges a round."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        at = F.floor((F.col("s") - low) / (high - low) * 999).alias("at")
        ranges = values.where(F.col("s").between(low, high)).groupBy(at).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: r.at):
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", group: int = GROUP) -> Model:
    known = stored(_labelled(labels, learn, label), "labelled")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    # Features are taken before the join, so that no text is shuffled however many labels there are.
    own = docs.where(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    marked = stored(own.mapInArrow(rows, "doc_id long, x array<double>").join(known, "doc_id"), "labelled-features")
    count = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        told = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        return Model((told.get(1, 0) + 1) / (sum(told.values()) + 2))

    n, x = sum(count.values()), marked.select("x")
    mean = _total(x, lambda b: _array(b.column(0)).sum(axis=0)) / n
    model = Model(None, mean, np.sqrt(_total(x, lambda b: ((_array(b.column(0)) - mean) ** 2).sum(axis=0)) / n) + 1e-6)
    model.w = _weights(stored(grouped(marked, count, group), "comparison-groups"), model)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scaled(_array(batch.column(1))) @ model.w)], names=["y", "s"])

    values = stored(marked.select("y", "x").mapInArrow(ranked, "y int, s double"), "training-scores")
    model.threshold = (nth(values, count[0] - 1) + nth(values, count[0])) / 2
    u = F.col("s") - model.threshold

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), u * float(w[0])))))
        first, second = values.agg(F.sum((p - F.col("y")) * u), F.sum(p * (1 - p) * u * u)).first()
        return np.array([first]) + 1e-3 * w, np.array([[second]]) + 1e-3

    model.slope = max(_climb(slopes, 1)[0], 1e-3)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row per row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            s = model.scores(_matrix(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return base.mapInArrow(rows, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of docs with a score of at least 0.5."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_matrix([features(t) for t in texts])))

    return docs.where(scores(text_of(docs)) >= 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 3) != 1)
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
