"""BPE encoding and decoding, long texts by tree concatenation.

A text of up to ``longest`` characters is encoded by the task that reads it. A longer one
is cut into halves until the parts are short, wherever the cuts fall, and the parts are
encoded in parallel by other tasks. Neighbours are then joined up the tree: a window of
tokens around each join is encoded again and grows until it begins with tokens of the
left side and ends with tokens of the right side, unchanged. What lies between replaces
what was there; where both sides never agree, the window is both parts whole.

Cases: null text is empty, without ids; texts with a special token are never cut, because
the library looks for these before anything else; rows that repeat a ``doc_id`` each get
a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, text_of
from .tokens import Encoder, bytes_of_ids, encoder, slices, vocabulary

#: Characters that one task encodes in one go.
LONGEST = 1 << 16
#: Tokens on which both sides must agree, and the first window's tokens on either side.
AGREE, WINDOW = 8, 32
_SLICE = 500
#: A task encodes and decodes in two Python processes at once, so each keeps fewer units and takes less text at a time.
_CACHE, _AT_ONCE = 600_000, 2 << 20


def _whole_bytes(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def join(enc: Encoder, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of two neighbouring parts' text from the ids of the parts."""
    table, size = bytes_of_ids(enc.path), WINDOW
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        whole = a == 0 and b == len(right)
        while a > 0 and not _starts_char(table[left[a]]):
            a -= 1
        while b < len(right) and not _starts_char(table[right[b]]):
            b += 1
        ids = enc.whole((_whole_bytes(table, left[a:]) + _whole_bytes(table, right[:b])).decode())
        front = a == 0 or (len(ids) > 2 * AGREE and np.array_equal(ids[:AGREE], left[a : a + AGREE]))
        back = b == len(right) or (len(ids) > 2 * AGREE and np.array_equal(ids[len(ids) - AGREE :], right[b - AGREE : b]))
        if whole or (front and back):
            return np.concatenate([left[:a], ids, right[b:]])
        size *= 2


def _starts_char(token: bytes) -> bool:
    return token[0] & 0xC0 != 0x80


def cuts(n: int, longest: int) -> list[int]:
    """Ends of the parts when n characters are halved until none is longer."""
    parts = 1
    while n > parts * longest:
        parts *= 2
    return [n * (i + 1) // parts for i in range(parts)]


def _rows(doc: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, ids (array<int>): as the library encodes each whole text, special tokens not added."""

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte", _CACHE)
        for batch in batches:
            for some in slices(batch, 1, _AT_ONCE):
                yield _rows(some.column(0).to_pylist(), enc.encode_many(some.column(1).to_pylist()))

    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    special = F.lit(False)
    for token in encoder(path, "byte", _CACHE).tok.get_added_tokens_decoder().values():
        special = special | F.contains("text", F.lit(token.content))
    short = base.where((F.length("text") <= longest) | special).mapInArrow(direct, "doc_id long, ids array<int>")

    # Long texts: a table of their parts, each encoded on its own, in any task.
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ends = cuts(len(t), longest)
                parts = [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(parts), pa.int64()), pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                    names=["doc_id", "row", "part", "text"],
                )

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte", _CACHE)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, row, part, t = (batch.column(c)[i].as_py() for c in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([row], pa.int64()), pa.array([part], pa.int32()), pa.array([enc.encode(t)], pa.list_(pa.int32()))],
                    names=["doc_id", "row", "part", "ids"],
                )

    def tree(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        enc = encoder(path, "byte", _CACHE)
        parts = parts.sort_by("part")
        ids = [np.array(x, np.int32) for x in parts.column("ids").to_pylist()]
        while len(ids) > 1:
            ids = [join(enc, a, b) for a, b in zip(ids[::2], ids[1::2], strict=True)]
        return pa.Table.from_batches([_rows(parts.column("doc_id")[:1].to_pylist(), ids)])

    long = base.where((F.length("text") > longest) & ~special).withColumn("row", F.monotonically_increasing_id())
    pieces = stored(long.select("doc_id", "row", "text").mapInArrow(split, "doc_id long, row long, part int, text string"), "long-parts")
    encoded = pieces.repartition("row", "part").mapInArrow(one, "doc_id long, row long, part int, ids array<int>")
    joined = encoded.groupBy("row").applyInArrow(tree, "doc_id long, ids array<int>")
    return short.unionByName(joined)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens(doc_id, ids) with decoded, the text as the library's decode gives it, special tokens kept."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte", _CACHE)
        for batch in batches:
            ids = batch.column(1)
            for at in range(0, batch.num_rows, _SLICE):
                some = ids.slice(at, _SLICE)
                values, ends = some.values.to_numpy(zero_copy_only=False), some.offsets.to_numpy()
                got = [enc.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, _SLICE), some, pa.array(got, pa.string())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(texts, "doc_id long, ids array<int>, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    found = decode(encode(documents(spark, sf_dir), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
