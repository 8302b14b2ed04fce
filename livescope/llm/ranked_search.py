"""Ranked lexical search over hashed max-sketches, with exact scores.

``index`` reads every text once. A document's row holds its number of terms, its terms with
their counts, and a sketch: eight cells a distinct term, each term in two of them by its
hash, and a cell keeps the maximum of what falls into it. An impact grows with the term's
count and all else in it is the document's own, so cells keep counts (in 256 levels, rounded
up) and stand for impacts under any corpus statistics. For a query term the smaller of its
two cells bounds the term's impact, and weights times bounds, summed, bound the score.

``search`` takes the queries in blocks of bounded size. Each task looks a block's terms up in
all sketches of a batch at once, then takes (document, query) pairs by descending bound and
rescores them exactly from the document's terms until the bound falls below the k-th best
score so far. Every document is bounded and no candidate is capped; tasks return k rows a
query at most, and the k best of those are the result.

Document frequencies and lengths cover all documents. Terms and scores are exact: hashes
only place cells, and a collision can only raise a bound.

Cases: null and empty texts hold no term, are not counted and are never found; a query
without terms, or with none that the corpus holds, returns nothing; rows that share a query id
are one query; equal scores go by ascending id, a null id last; rows that repeat an id are
documents of their own; very long texts are cut into terms in parts; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LAST_ID, documents, stored
from .tokens import slices

TOP = 10
#: Cells of a sketch for each distinct term.
CELLS = 8
#: Queries are searched in blocks of so many terms; a longer query is a block of its own.
BLOCK_TERMS = 100_000
#: Looked-up cells at once, and hashes of words that a worker keeps.
AT_ONCE, KEPT = 1 << 20, 1 << 20
#: Bytes of text that are cut into terms at once.
PART = 4 << 20
#: Results of tasks are merged in so many parts a query first.
SALTS = 64

#: Terms are runs of ASCII letters, digits and all beyond ASCII; A to Z in lower case.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
#: Counts that cells can hold: each up to 200, then in steps of a third or so.
LEVELS = np.array([*range(201), *(int(200 * 2 ** (0.45 * k)) + 1 for k in range(1, 56))], np.int64)

INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_SPARK_INDEX = "doc_id long, n long, sketch binary, words binary, counts binary"


class Block(NamedTuple):
    """Some queries: each one's terms with weights, and for each distinct term the queries that hold it."""

    queries: list[int | None]
    terms: list[list[tuple[bytes, int]]]
    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    of: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int


def terms_of(text: bytes) -> Counter:
    """A text's terms and how often each occurs."""
    if len(text) <= PART:
        return Counter(text.translate(_LOWER).split())
    found, at = Counter(), 0
    while at < len(text):
        part = text[at : at + PART].translate(_LOWER)
        if at + PART < len(text):
            end = part.rfind(b" ") + 1
            more = 2 * PART
            while not end:  # one term longer than a part
                part = text[at : at + more].translate(_LOWER)
                end = part.rfind(b" ") + 1 if at + more < len(text) else len(part)
                more *= 2
            part = part[:end]
        found.update(part.split())
        at += len(part)
    return found


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hash = _Hashes()


def _cells(hashes: np.ndarray, width) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash in a sketch of ``width`` cells."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return ((low * width) >> np.uint64(32)).astype(np.int64), ((high * width) >> np.uint64(32)).astype(np.int64)


def sketch_of(terms: Counter) -> bytes:
    if not terms:
        return b""
    hashes = np.fromiter(map(_hash.__getitem__, terms), np.uint64, len(terms))
    level = np.searchsorted(LEVELS, np.fromiter(terms.values(), np.int64, len(terms))).astype(np.uint8)
    sketch = np.zeros(CELLS * len(terms), np.uint8)
    for cells in _cells(hashes, np.uint64(len(sketch))):
        np.maximum.at(sketch, cells, level)
    return sketch.tobytes()


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            n, sketches, words, counts = [], [], [], []
            for text in batch.column(1):
                terms = terms_of(text.as_py() or b"")
                n.append(terms.total())
                sketches.append(sketch_of(terms))
                words.append(b" ".join(terms))
                counts.append(np.fromiter(terms.values(), "<u4", len(terms)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n,)), *(pa.array(x, pa.binary()) for x in (sketches, words, counts))], schema=INDEX)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, sketch, words, counts: one row per row of docs, written to the shared folder."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))
    return stored(rows.mapInArrow(_indexed, _SPARK_INDEX), "search-index")


def vocabulary(indexed: DataFrame) -> DataFrame:
    """word, df: every term of the corpus and how many documents hold it."""
    return indexed.where("n > 0").select(F.explode(F.split(F.col("words").cast("string"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def weighted_queries(queries: DataFrame, indexed: DataFrame, n_docs: int, query: str = "item_id", text: str = "text") -> DataFrame:
    """query, word, weight: the distinct terms of each query that the corpus holds."""
    words = F.split(F.trim(F.regexp_replace(F.translate(F.coalesce(queries[text], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                            r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")
    asked = stored(queries.select(queries[query].cast("long").alias("query"), F.explode(words).alias("word")).where("word <> ''").distinct(), "query-terms")
    # Counted before the join: a term of every document is one row a task by then.
    held = vocabulary(indexed).join(asked.select("word").distinct(), "word", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    return asked.join(stored(held, "query-vocabulary"), "word").select("query", "word", weight.cast("long").alias("weight"))


def blocks(weighted: DataFrame, n_docs: int, n_terms: int) -> Iterator[Block]:
    """The queries in blocks of bounded size."""
    grouped = weighted.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("terms")).orderBy("query")
    held, size = [], 0
    for row in grouped.toLocalIterator():
        if held and size + len(row.terms) > BLOCK_TERMS:
            yield _block(held, n_docs, n_terms)
            held, size = [], 0
        held.append((row["query"], [(t.word.encode(), t.weight) for t in row.terms]))
        size += len(row.terms)
    if held:
        yield _block(held, n_docs, n_terms)


def _block(held: list, n_docs: int, n_terms: int) -> Block:
    by_word: dict[bytes, list[tuple[int, int]]] = {}
    for place, (_, terms) in enumerate(held):
        for word, weight in terms:
            by_word.setdefault(word, []).append((place, weight))
    lengths = np.array([len(x) for x in by_word.values()], np.int64)
    flat = np.array([x for posted in by_word.values() for x in posted], np.int64).reshape(-1, 2)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in by_word], np.uint64)
    return Block([q for q, _ in held], [t for _, t in held], hashes, np.cumsum(lengths) - lengths, lengths, flat[:, 0], flat[:, 1], n_docs, n_terms)


def impact(count, m):
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def bounds(block: Block, sketches: list[bytes], ms: np.ndarray) -> np.ndarray:
    """documents x queries: no score is higher."""
    sizes = np.array([len(s) for s in sketches], np.int64)
    cells, at = np.frombuffer(b"".join(sketches), np.uint8), (np.cumsum(sizes) - sizes)[:, None]
    first, second = _cells(block.hashes[None, :], sizes.astype(np.uint64)[:, None])
    level = np.minimum(cells[first + at], cells[second + at])
    doc, term = np.nonzero(level)
    value = impact(LEVELS[level[doc, term]], ms[doc])
    times = block.lengths[term]
    row = np.repeat(np.arange(len(doc)), times)
    post = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + block.starts[term][row]
    n = len(block.queries)
    # Sums stay below 2 ** 53, where doubles are exact.
    summed = np.bincount(doc[row] * n + block.of[post], weights=value[row] * block.weights[post], minlength=len(sketches) * n)
    return summed.astype(np.int64).reshape(len(sketches), n)


class _Best:
    """The k best (score, -id) of each query in one task."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in block.queries]
        self.least = np.ones(len(block.queries), np.int64)

    def take(self, ids: list[int], ns: list[int], sketches: list[bytes], words, counts) -> None:
        ms = np.array([10 + (90 * n * self.block.n_docs) // self.block.n_terms for n in ns], np.int64)
        upper = bounds(self.block, sketches, ms)
        doc, query = np.nonzero(upper >= self.least)
        values, terms = upper[doc, query], {}
        for pair in np.argsort(-values, kind="stable"):
            d, q, heap = int(doc[pair]), int(query[pair]), self.heaps[query[pair]]
            if len(heap) == self.k and (int(values[pair]), -ids[d]) <= heap[0]:
                continue
            if d not in terms:
                terms[d] = dict(zip(words[d].as_py().split(b" "), np.frombuffer(counts[d].as_py(), "<u4").tolist()))
            held, m = terms[d], int(ms[d])
            score = sum(w * impact(held[t], m) for t, w in self.block.terms[q] if t in held)
            if score > 0:
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, -ids[d]))
                elif (score, -ids[d]) > heap[0]:
                    heapq.heapreplace(heap, (score, -ids[d]))
                if len(heap) == self.k:
                    self.least[q] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        out = [(q, None if -i == LAST_ID else -i, s) for q, heap in zip(self.block.queries, self.heaps) for s, i in heap]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], schema=FOUND)


def _searcher(block: Block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = _Best(block, k), max(1, AT_ONCE // max(1, len(block.hashes)))
        for batch in batches:
            ids, ns = (batch.column(c).to_pylist() for c in (0, 1))
            for at in range(0, len(ids), step):
                to = slice(at, at + step)
                here = [LAST_ID if i is None else i for i in ids[to]]
                best.take(here, ns[to], batch.column(2)[to].to_pylist(), batch.column(3)[to], batch.column(4)[to])
        yield best.rows()

    return searched


def search(indexed: DataFrame, queries: DataFrame, k: int = TOP, query: str = "item_id", text: str = "text") -> DataFrame:
    """query, rank, doc_id, score: the k best documents of each query."""
    spark = indexed.sparkSession
    stats = indexed.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    if stats.docs:
        weighted = weighted_queries(queries, indexed, stats.docs, query, text)
        for block in blocks(weighted, stats.docs, stats.terms):
            held = indexed.where("n > 0").select("doc_id", "n", "sketch", "words", "counts")
            found = found.unionByName(stored(held.mapInArrow(_searcher(block, k), found.schema), "found"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    part = salted.withColumn("place", F.row_number().over(W.partitionBy("query", "salt").orderBy(*order))).where(F.col("place") <= k)
    best = part.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("query", "item_id")


_SQL_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_SQL_TERMS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id), c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM d, c), df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
