"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document. It goes where its words also
start in a document with a smaller ``doc_id``.

Pass 1 makes a count-min sketch of window counts, with ``depth`` rows of ``2 ** width_bits``
cells: by default the least power of two with ``SPARE`` cells or more for each piece, so that a
row takes one window in ``SPARE`` to be repeated that is not, and both rows one in
``SPARE ** 2``. Windows that share an anchor (see ``anchors``) share their cells, so a cell's sum
is never below any of its windows' counts. Each partition adds up its own sketch (the partial
aggregate of its cells) and partition sketches are merged by adding them. A sketch of a size
that follows the input would not fit in one task at 100 TB (some 1e12 pieces, 8e12 cells), so
partition sketches hold the cells in use only, and the merged one is dealt by cell.

Pass 2 takes the pieces whose estimate is 2 or more in every row, and compares exactly.
Equal pieces fold into one with its first document; only where several pieces share an
anchor are their windows compared one by one, by a 128-bit digest of their words. Every
step groups before the shuffle or joins against a written table with one row a key.

Cases: a null text has no words; texts shorter than a window lose nothing; a null
``doc_id`` counts as the largest; rows that repeat a ``doc_id`` are not smaller than one
another, so they take nothing from each other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import pieces
from .common import LAST_ID, all_columns, column_of_row, documents, id_of, set_apart, stored, stored_alone, text_of

GRAM = 8
#: Cells of a row of the sketch for each piece, at least.
SPARE = 8
#: Windows handled at once; longer texts go block by block, one window less than a block apart.
BLOCK = 1 << 16
_PIECE = "anchor long, digest long, rid long, th long, first int, n int"


class Words:
    """The words of a text, with the place of each in their space-joined bytes."""

    def __init__(self, text: str):
        self.words = text.encode().split()
        self.joined = b" ".join(self.words)
        self.starts = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1, out=self.starts[1:])

    def span(self, a: int, b: int) -> bytes:
        return self.joined[self.starts[a] : self.starts[b] - 1]


def _pieces_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hashed = xxhash.xxh64_intdigest
    for batch in batches:
        found = []
        for rid, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = Words(text)
            n = len(words.words)
            if n < window:
                continue
            h = np.fromiter(map(hashed, words.words), np.uint64, n)
            starts = words.starts.tolist()
            for at in range(0, n - window + 1, BLOCK):
                anchor, first, runs = pieces(h[at : at + BLOCK + window - 1], window, GRAM)
                first = first + at
                digest = [xxhash.xxh3_64_intdigest(words.joined[starts[a] : starts[b] - 1]) for a, b in zip(first.tolist(), (first + runs + window - 1).tolist(), strict=True)]
                found.append((anchor, np.array(digest, np.uint64), np.full(len(first), rid), np.full(len(first), th), first, runs))
        if found:
            anchor, digest, rid, th, first, runs = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(rid), pa.array(th), pa.array(first.astype(np.int32)), pa.array(runs.astype(np.int32))],
                names=["anchor", "digest", "rid", "th", "first", "n"],
            )


def _windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of the wanted pieces of each text."""
    for batch in batches:
        for rid, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = Words(text)
            starts = words.starts.tolist()
            rows: list[tuple[bytes, int, int, int]] = []
            for piece in wanted:
                a = piece["first"]
                for at in range(piece["n"]):
                    held = words.joined[starts[a + at] : starts[a + at + window] - 1]
                    rows.append((blake2b(held, digest_size=16).digest(), piece["anchor"], piece["digest"], at))
            for i in range(0, len(rows), BLOCK):
                held, anchor, digest, at = zip(*rows[i : i + BLOCK], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held, pa.binary()), pa.array([rid] * len(at), pa.int64()), pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(at, pa.int32())],
                    names=["held", "rid", "anchor", "digest", "at"],
                )


def _cells(depth: int, width_bits: int):
    """The cells of an anchor, one in each row of the sketch."""
    h = F.col("anchor")
    out = []
    for row in range(depth):
        h = F.xxhash64(h, F.lit(row))
        out.append(F.lit(row << width_bits).cast("long") + h.bitwiseAND((1 << width_bits) - 1))
    return out


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, depth: int = 2, width_bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (rid, th, doc_id, text), and the spans (rid, th, first, last) of words to remove."""
    keyed = docs.select(
        id_of(docs, doc_id).alias("rid"), F.xxhash64(text_of(docs, text)).alias("th"), docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text")
    )
    found = stored(keyed.select("rid", "th", "text").mapInArrow(lambda it: _pieces_of(it, window), _PIECE), "pieces")

    # Pass 1: partition sketches, merged by sum.
    if width_bits is None:
        width_bits = max(10, (SPARE * found.count() - 1).bit_length())
    cells = _cells(depth, width_bits)
    sketch = found.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").agg(F.count("*").alias("estimate"))
    often = stored(sketch.where("estimate > 1").select("cell"), "sketch")

    # Pass 2: only windows that every row of the sketch holds to be repeated.
    suspects = found
    for cell in cells:
        suspects = suspects.withColumn("cell", cell).join(often, "cell", "left_semi").drop("cell")
    suspects = stored(suspects, "suspects")
    firsts = stored(
        suspects.groupBy("anchor", "digest").agg(F.min(F.struct("rid", "th", "first", "n")).alias("own"), F.min("rid").alias("first_rid")), "first-pieces"
    )
    contested = stored(firsts.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1").select("anchor"), "contested")
    wanted = (
        firsts.join(contested, "anchor", "left_semi")
        .select("own.rid", "own.th", F.struct("own.first", "own.n", "anchor", "digest").alias("piece"))
        .groupBy("rid", "th")
        .agg(F.collect_list("piece").alias("wanted"))
    )
    windows = stored(
        keyed.select("rid", "th", "text").join(stored(wanted, "wanted"), ["rid", "th"])
        .select("rid", "text", "wanted")
        .mapInArrow(lambda it: _windows_of(it, window), "held binary, rid long, anchor long, digest long, at int"),
        "windows",
    )
    starts = stored(windows.groupBy("held").agg(F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid")).where("last_rid > first_rid").select("held", "first_rid"), "window-starts")
    inside = windows.join(starts, "held").where("rid > first_rid").select("rid", "anchor", "digest", "at").distinct()

    whole = suspects.join(firsts.select("anchor", "digest", "first_rid"), ["anchor", "digest"]).where("rid > first_rid")
    last = F.col("n") + F.lit(window - 2)
    partly = suspects.select("anchor", "digest", "rid", "th", "first").join(stored(inside, "inside"), ["anchor", "digest", "rid"])
    spans = whole.select("rid", "th", "first", (F.col("first") + last).alias("last")).union(
        partly.select("rid", "th", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("at") + window - 1).alias("last"))
    )
    return keyed, spans


def _cut(texts: DataFrame) -> DataFrame:
    """texts(text, spans, ...) with cut: what is left of each text, and what went."""

    @F.pandas_udf("n_words long, n_removed long, removed array<struct<first: int, last: int>>, kept_text string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for held, spans in zip(texts, lists, strict=True):
            words = held.encode().split()
            if spans is None or not len(spans):
                rows.append((len(words), 0, [], b" ".join(words).decode()))
                continue
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, [s["first"] for s in spans], 1)
            np.add.at(depth, [s["last"] + 1 for s in spans], -1)
            gone = np.cumsum(depth)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
            runs = [{"first": a, "last": b - 1} for a, b in edge.reshape(-1, 2).tolist()]
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            rows.append((len(words), int(gone.sum()), runs, kept.decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "removed", "kept_text"])

    return texts.withColumn("cut", cut("text", "spans"))


def _lists(spans: DataFrame) -> DataFrame:
    return stored(spans.distinct().groupBy("rid", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, **sketch: int) -> DataFrame:
    """doc_id, n_words, n_removed, removed (spans of word places, both ends in), kept_text (words joined by one space)."""
    keyed, spans = repeated_spans(docs, doc_id, text, window, **sketch)
    return _cut(keyed.join(_lists(spans), ["rid", "th"], "left")).select("doc_id", "cut.*")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The rows and columns of docs, with repeated words cut from text and n_chars counted anew.

    Texts that lose nothing stay as they are; a document that loses all its words goes.
    """
    lists = stored_alone(lambda: _lists(repeated_spans(docs, window=window)[1]), "span-lists")
    rid = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID))
    asked, others = set_apart(docs.select(all_columns(docs)), rid, lists.select(F.col("rid").alias("key")))
    text = F.coalesce("row.text", F.lit(""))
    whole = asked.select(rid.alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"), "row")
    cut = _cut(whole.join(lists, ["rid", "th"], "left")).where("cut.n_removed = 0 or cut.n_removed < cut.n_words")
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept_text")).otherwise(F.col("row.text"))
    n_chars = F.when(F.col("cut.n_removed") > 0, F.char_length("cut.kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    made = {"text": text, "n_chars": n_chars}
    return cut.select(*[made.get(c, column_of_row(c)).alias(c) for c in docs.columns]).union(others.select(*[column_of_row(c).alias(c) for c in docs.columns]))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), n AS (SELECT doc_id, ws, len(ws) AS n_words FROM w),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS held FROM (
    SELECT doc_id, ws, unnest(range(1, n_words - 48)) AS i FROM n WHERE n_words >= 50)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY held) AS first_id FROM win) WHERE doc_id > first_id
), cov AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM gone
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, n_words + 1)) AS p FROM n
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n_kept
  FROM words LEFT JOIN cov ON words.doc_id = cov.doc_id AND words.p = cov.p WHERE cov.p IS NULL GROUP BY words.doc_id
)
SELECT n.doc_id, n_words, n_words - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id
"""
