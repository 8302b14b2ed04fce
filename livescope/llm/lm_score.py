"""Stupid-backoff language-model scores, computed relationally.

Every document is scored by n-gram counts over all documents. Documents are dealt into
batches by hash. A batch lists its distinct n-grams, hashed and counted, and joins each
hash partition of the count table for its share of them: one row (bucket, batch, order,
hashes, counts). A bucket adds up the counts of all batches, which is its part of the count
table, and answers each row with the totals in the row's own order. Batches take their
answers, look up each of their n-grams, and sum the scores of each document.

Rows of single n-grams would be the plainer form. On 0.87 GB of text, order 3 has some 205
million distinct n-grams of batches; as Spark rows of (hash, batch, count) that is 16 bytes
each in a compressed shuffle, 3.2 GB one way, against six here: hashes are sorted, so that
their differences are stored, and counts take the bytes they need. There are never more
lists than there would be rows, as empty ones are left out.

Texts are shuffled in packs too, one for each batch that a task has some 32 MB of texts of:
compressed together they take under two thirds of what they take as rows.

Counts are added up before they are shuffled, so the most frequent n-gram is one entry a
batch. Buckets and batches have about ``batch_bytes`` of text to them and their number
follows the input.

The score of a word is count(n-gram) / count(its context) for the longest n-gram with at
least ``min_count`` occurrences, times ``alpha`` for each order given up; at the end it is
the word's share of all words. Words are runs without ASCII white space, A-Z lower-cased.

Cases: null, empty and blank texts have no words, score 0 and mean 0; rows that repeat a
``doc_id`` are scored and counted each; a long text is one document of its batch; a table
without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import mixed
from .common import documents, stored, text_of

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Bytes of text of a batch; also of the n-grams of a bucket.
BATCH_BYTES = 16 << 20
#: Bytes of texts that a task holds before it packs them by batch.
PACK_BYTES = 32 << 20
_PACK = "batch long, doc_ids array<long>, sizes array<int>, texts binary"
_ASK = "bucket long, batch long, gram int, n int, hashes binary, counts binary"
_ANSWER = "batch long, gram int, bucket long, n int, totals binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (batch, doc_id, text): one row for each batch, with its texts compressed together."""
    held = []
    for rows in chain(batches, [None]):
        held += [rows] if rows is not None and rows.num_rows else []
        if not held or rows is not None and sum(x.nbytes for x in held) < PACK_BYTES:
            continue
        table, held = pa.Table.from_batches(held).sort_by("batch"), []
        batch, texts = table.column("batch").to_numpy(), [t.encode() for t in table.column("text").to_pylist()]
        first = np.flatnonzero(np.diff(batch, prepend=-1))
        bounds = np.append(first, len(batch)).astype(np.int32)
        packs = [pa.compress(b"".join(texts[a:b]), "zstd", asbytes=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ids, sizes = table.column("doc_id").combine_chunks(), pa.array(map(len, texts), pa.int32())
        columns = [pa.array(batch[first]), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, sizes), pa.array(packs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["batch", "doc_ids", "sizes", "texts"])


def _unpacked(packs: pa.Table) -> pa.Table:
    """batch, doc_id, text of the packs of one batch."""
    sizes = [np.array(x, np.int64) for x in packs.column("sizes").to_pylist()]
    texts = []
    for own, pack in zip(sizes, packs.column("texts").to_pylist(), strict=True):
        raw, ends = pa.decompress(pack, int(own.sum()), "zstd", asbytes=True), np.cumsum(own)
        texts += [raw[a:b].decode() for a, b in zip((ends - own).tolist(), ends.tolist(), strict=True)]
    ids = pa.array(chain.from_iterable(packs.column("doc_ids").to_pylist()), pa.int64())
    return pa.table([pa.array(np.repeat(packs.column("batch").to_numpy(), [len(x) for x in sizes])), ids, pa.array(texts, pa.string())], names=["batch", "doc_id", "text"])


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text; by order, a hash for each word: of the n-gram that ends there, 0 where the text is too short."""
    sizes = np.zeros(len(texts), np.int64)
    parts = []
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    h = np.concatenate([np.zeros(0, np.uint64), *parts])
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, run = [], h.copy()
    for n in range(1, order + 1):
        if n > 1:
            run[1:] = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        own = mixed(run + np.uint64(n))
        own |= np.uint64(1)
        own[place < n - 1] = 0
        out.append(own)
    return sizes, out


def _pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences, bytes of one place together."""
    apart = np.diff(hashes, prepend=np.uint64(0))
    return pa.compress(apart.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _hashes_of(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, 8 * n, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the greatest needs; the first byte says how many."""
    width = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([width.itemsize]) + pa.compress(counts.astype(width).tobytes(), "zstd", asbytes=True)


def _counts_of(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    return np.frombuffer(pa.decompress(packed[1:], width * n, "zstd", asbytes=True), f"u{width}")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the hash, so that sorted hashes are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _ask(batch: pa.Table, order: int, buckets: int) -> pa.Table:
    number = batch.column("batch")[0].as_py()
    rows = []
    for n, own in enumerate(_grams(batch.column("text").to_pylist(), order)[1], 1):
        hashes, counts = np.unique(own[own != 0], return_counts=True)
        if not len(hashes):
            continue
        bucket = _bucket(hashes, buckets)
        first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        for a, b in zip(first, [*first[1:], len(hashes)], strict=True):
            rows.append((int(bucket[a]), number, n, int(b - a), _pack_hashes(hashes[a:b]), _pack_counts(counts[a:b])))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "batch", "gram", "n", "hashes", "counts"])


def _answer(asked: pa.Table) -> pa.Table:
    """One bucket: its part of the count tables, and from it an answer to each row."""
    out = []
    grams, sizes = asked.column("gram").to_numpy(), asked.column("n").to_numpy()
    for n in np.unique(grams):
        rows = np.flatnonzero(grams == n)
        hashes = [_hashes_of(asked.column("hashes")[i].as_py(), int(sizes[i])) for i in rows.tolist()]
        counts = [_counts_of(asked.column("counts")[i].as_py(), int(sizes[i])) for i in rows.tolist()]
        keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.uint64)
        mine, a = totals[at], 0
        for i, size in zip(rows.tolist(), sizes[rows].tolist(), strict=True):
            out.append((asked.column("batch")[i].as_py(), int(n), asked.column("bucket")[i].as_py(), size, _pack_counts(mine[a : a + size])))
            a += size
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "gram", "bucket", "n", "totals"])


def _sum(batch: pa.Table, answers: pa.Table, order: int, alpha: float, min_count: int) -> pa.Table:
    sizes, grams = _grams(batch.column("text").to_pylist(), order)
    counts = []
    for n, own in enumerate(grams, 1):
        rows = sorted((b, i) for i, (b, g) in enumerate(zip(answers.column("bucket").to_pylist(), answers.column("gram").to_pylist(), strict=True)) if g == n)
        totals = np.concatenate([np.zeros(0, np.uint64), *(_counts_of(answers.column("totals")[i].as_py(), answers.column("n")[i].as_py()) for _, i in rows)])
        known = own != 0
        got = np.zeros(len(own))
        got[known] = totals[np.unique(own[known], return_inverse=True)[1]]
        counts.append(got)
    score = np.zeros(len(grams[0]))
    open_ = np.ones(len(score), bool)
    given_up = np.zeros(len(score))
    for n in range(order, 1, -1):
        here = grams[n - 1] != 0
        hit = open_ & here & (counts[n - 1] >= min_count)
        context = np.concatenate(([0.0], counts[n - 2][:-1])) if len(score) else counts[n - 2]
        score[hit] = np.log(counts[n - 1][hit] / context[hit]) + given_up[hit] * np.log(alpha)
        open_ &= ~hit
        given_up[open_ & here] += 1
    score[open_] = np.log(counts[0][open_]) + given_up[open_] * np.log(alpha)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sums = [np.bincount(doc, weights=x, minlength=len(sizes)) for x in (score, open_, given_up)]
    return pa.table(
        [batch.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.int64))],
        names=["doc_id", "n_words", "part", "n_alone", "n_backoffs"],
    )


def lm_scores(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """doc_id, n_words, n_backoffs, score (sum of natural logarithms), mean_score."""
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // batch_bytes))
    dealt = base.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("batch"), "doc_id", "text").mapInArrow(_packed, _PACK)
    asked = dealt.groupBy("batch").applyInArrow(lambda t: _ask(_unpacked(t), order, n), _ASK)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    parts = (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(lambda a, b: _sum(_unpacked(a), b, order, alpha, min_count), "doc_id long, n_words long, part double, n_alone long, n_backoffs long")
    )
    parts = stored(parts, "lm-parts")
    words = parts.agg(F.sum("n_words")).first()[0] or 0
    score = F.col("part") - F.col("n_alone") * F.lit(float(np.log(max(words, 1))))
    return parts.select("doc_id", "n_words", "n_backoffs", score.alias("score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(0.0).alias("mean_score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir)).select("doc_id", "n_words", "n_backoffs", F.round("mean_score", 6).alias("mean_score"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents
), w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
p AS (SELECT doc_id, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
t AS (
  SELECT p.doc_id, a.n AS n1, b.n AS before1, c2.n AS n2, e.n AS before2, c3.n AS n3,
    CASE WHEN p.u IS NOT NULL THEN 3 WHEN p.v IS NOT NULL THEN 2 ELSE 1 END AS top
  FROM p JOIN c1 a ON a.w = p.w LEFT JOIN c1 b ON b.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w
  LEFT JOIN c2 e ON e.v = p.u AND e.w = p.v LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
), r AS (SELECT *, CASE WHEN top = 3 AND n3 >= 2 THEN 3 WHEN top >= 2 AND n2 >= 2 THEN 2 ELSE 1 END AS got FROM t),
s AS (
  SELECT doc_id, top - got AS backed, (top - got) * ln(0.4)
    + CASE got WHEN 3 THEN ln(n3 / before2) WHEN 2 THEN ln(n2 / before1) ELSE ln(n1 / (SELECT count(*) FROM w)) END AS s
  FROM r
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_backoffs, 0)::BIGINT AS n_backoffs, coalesce(mean_score, 0.0) AS mean_score
FROM d LEFT JOIN (SELECT doc_id, sum(backed) AS n_backoffs, round(avg(s), 6) AS mean_score FROM s GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
