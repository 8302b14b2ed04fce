"""Suffix-array dedup: which byte strings of ``window`` bytes start earlier as well.

Windows that may be equal share an anchor (see ``anchors``), so texts are cut into pieces
of windows with one anchor, and anchors are dealt out instead of suffixes:

1. Anchors that occur once hold nothing repeated and go no further, unless their piece has
   a window twice (a run of short period); such pieces are always compared.
2. Equal pieces fold into one, at its earliest place; every other copy goes whole. They are known
   by their anchor and a 64-bit digest of their bytes. Two distinct pieces of one anchor agree by
   chance with odds of 2 ** -64: 1e12 pieces with 4,096 to an anchor have 1e-4 such pairs expected,
   an anchor that 1e9 distinct pieces share has 0.03.
3. Distinct pieces that share an anchor may still share windows. Buckets of such pieces get
   a suffix array and its Burrows-Wheeler transform. Breadth-first backward extension
   derives the common prefixes by increasing length: an interval of suffixes that begin
   with one string is extended to the left by each symbol before them, and where the new
   interval ends no longer prefix has been found before, the common prefix there is as long
   as the string. It stops at ``window``; neighbours without a value by then have at least
   ``window`` bytes in common. In each run of those the earliest place stays.

An anchor with more than ``hot`` distinct pieces would make its bucket, and so one task, grow
with the input; its windows are grouped one by one instead, by their bytes, with the minimum
taken before the shuffle: the exact way for the rest.

Places are (doc_id, start). Cases: null text is empty; texts shorter than a window lose
nothing; a null ``doc_id`` counts as the largest; rows that repeat doc_id and text are one
document; texts of one ``doc_id`` come in the order of their hashes; matches never cross
documents; a table without rows gives none; long texts are read block by block. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import gram_hashes, runs_of
from .common import documents, id_of, stored, text_of

WINDOW, GRAM = 100, 32
#: Windows of a piece at most, and bytes handled at once.
RUN, BLOCK = 255, 1 << 17
#: Distinct pieces of an anchor up to which suffix arrays compare them; pieces of a bucket, about.
HOT, BUCKET = 4_096, 2_048
_BYTE_HASH = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _cut(raw: bytes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, first windows, numbers of windows of a text's pieces, and whether one has a window twice, block by block."""
    data, width = np.frombuffer(raw, np.uint8), window - GRAM + 1
    for at in range(0, len(raw) - window + 1, BLOCK):
        grams = gram_hashes(_BYTE_HASH[data[at : at + BLOCK + window - 1]], GRAM)
        anchor, first, runs = runs_of(grams, width)
        if runs.max(initial=0) > RUN:
            times = -(-runs // RUN)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            left = np.repeat(runs, times) - step * RUN
            anchor, first, runs = np.repeat(anchor, times), np.repeat(first, times) + step * RUN, np.minimum(left, RUN)
        # Equal windows of a piece have its anchor at one place of each, so it has the anchor twice.
        sizes = runs + width - 1
        starts = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) - np.repeat(starts - first, sizes)
        inner = np.add.reduceat(grams[places] == np.repeat(anchor, sizes), starts, dtype=np.int64) > 1
        for i in np.flatnonzero(inner).tolist():
            a, n = int(first[i]) + at, int(runs[i])
            inner[i] = len({raw[j : j + window] for j in range(a, a + n)}) < n
        yield anchor, first + at, runs, inner


def _anchors_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Anchors of pieces, twice where a piece has a window twice."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            found = [x for t in batch.column(0).slice(a, 500).to_pylist() for anchor, _, _, inner in _cut(t, window) for x in (anchor, anchor[inner])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])


def _pieces_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hashed = xxhash.xxh3_64_intdigest
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            found = []
            for rid, th, raw in zip(*(batch.column(i).slice(a, 500).to_pylist() for i in range(3)), strict=True):
                for anchor, first, runs, inner in _cut(raw, window):
                    digest = [hashed(raw[i:j]) for i, j in zip(first.tolist(), (first + runs + window - 1).tolist(), strict=True)]
                    found.append((anchor, digest, np.full(len(first), rid), np.full(len(first), th), first << 8 | runs, inner))
            if found:
                digests = pa.array(np.array([d for x in found for d in x[1]], np.uint64).view(np.int64))
                anchor, rid, th, pos, inner = (np.concatenate([x[i] for x in found]) for i in (0, 2, 3, 4, 5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), digests, pa.array(rid), pa.array(th), pa.array(pos), pa.array(inner)], names=["anchor", "digest", "rid", "th", "pos", "inner"]
                )


def _contents_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rid, th, raw, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            cut = [raw[(p >> 8) : (p >> 8) + (p & 255) + window - 1] for p in (w["pos"] for w in wanted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([rid] * len(cut), pa.int64()), pa.array([th] * len(cut), pa.int64()), pa.array([w["pos"] for w in wanted], pa.int64()), pa.array(cut, pa.binary()), pa.array([w["hot"] for w in wanted], pa.bool_())],
                names=["anchor", "rid", "th", "pos", "held", "hot"],
            )


def order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys (below 2 ** bits) in ascending order, equal ones by place. Key and place are sorted as one number where they fit."""
    room = len(key).bit_length()
    if bits + room > 64:
        return np.argsort(key, kind="stable")
    both = key.astype(np.uint64) << np.uint64(room) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << room) - 1)).astype(np.int64)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols (below 512) in the order of their first ``depth`` symbols or more."""
    n, known = len(symbols), 4
    bits = 9 * known
    key = np.zeros(n, np.uint64)
    for i in range(known):
        key[: n - i] |= symbols[i:].astype(np.uint64) << np.uint64(9 * (known - 1 - i))
    while True:
        order = order_of(key, bits)
        ranked = key[order]
        rank = np.zeros(n, np.uint64)
        rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
        last = int(rank[order[-1]])
        if known >= depth or last == n - 1:
            return order
        half = (last + 1).bit_length()
        key = (rank + np.uint64(1)) << np.uint64(half)
        key[: max(0, n - known)] |= rank[known:] + np.uint64(1)
        bits, known = 2 * half, known * 2


def long_common_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the order, whether at least ``least`` symbols are shared with the place before.

    Backward extension over the Burrows-Wheeler transform, one level for each length.
    """
    n = len(symbols)
    bwt = symbols[order - 1]  # of the first suffix: the last symbol
    back = np.empty(n, np.int64)
    back[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)  # where the suffix one symbol longer is
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        # All (interval, symbol before it), with the first and last place of each.
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        pair = owner * 512 + bwt[at]
        by = order_of(pair, 9 + len(low).bit_length())
        change = np.flatnonzero(np.diff(pair[by], prepend=-1))
        first, last = at[by[change]], at[by[np.append(change[1:], len(by)) - 1]]
        low, high = back[first], back[last] + 1
        new = open_[high]
        open_[high] = False
        low, high = low[new], high[new]
        if not len(low):
            break
    return open_[:n]


def _compare(bucket: pa.Table, window: int) -> pa.Table:
    """Windows of a bucket's pieces that start earlier as well: rid, th, first, n."""
    rid, th, pos = (bucket.column(x).to_numpy() for x in ("rid", "th", "pos"))
    once = np.unique(np.column_stack([rid, th, pos]), axis=0, return_index=True)[1]  # rows that repeat come more than once
    rid, th, pos, held = rid[once], th[once], pos[once], bucket.column("held").take(pa.array(once)).to_pylist()
    sizes = np.array([len(h) for h in held])
    raw = np.frombuffer(b"\0".join(held) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 0
    order = suffix_order(raw, window)
    shared = long_common_prefixes(raw, order, window)
    piece = np.repeat(np.arange(len(held)), sizes + 1)[order]
    start = order - (ends - sizes)[piece]
    group = np.cumsum(~shared)
    inside = start + window <= sizes[piece]
    piece, start, group = piece[inside], start[inside], group[inside]
    place = np.lexsort((start + (pos[piece] >> 8), th[piece], rid[piece], group))
    later = np.ones(len(place), bool)
    later[0:1] = False
    g = group[place]
    later[1:] = g[1:] == g[:-1]
    piece, start = piece[place][later], start[place][later]
    # Runs of neighbouring windows.
    by = np.lexsort((start, piece))
    piece, start = piece[by], start[by]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(piece)))
    p = piece[head]
    return pa.table(
        [pa.array(rid[p]), pa.array(th[p]), pa.array((pos[p] >> 8) + start[head]), pa.array(n.astype(np.int64))],
        names=["rid", "th", "first", "n"],
    )


def _first(pos: str = "pos") -> Column:
    return F.shiftright(pos, 8)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (rid, th, doc_id, raw), and runs (rid, th, first, n) of windows that start earlier."""
    held = text_of(docs, text)
    keyed = docs.select(id_of(docs, doc_id).alias("rid"), F.xxhash64(held).alias("th"), docs[doc_id].alias("doc_id"), held.cast("binary").alias("raw"))
    long = keyed.where(F.octet_length("raw") >= window)

    anchors = long.select("raw").mapInArrow(lambda it: _anchors_of(it, window), "anchor long")
    often = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = long.select("rid", "th", "raw").mapInArrow(lambda it: _pieces_of(it, window), "anchor long, digest long, rid long, th long, pos long, inner boolean")
    suspects = stored(found.join(often, "anchor", "left_semi"), "suspects")
    firsts = stored(suspects.groupBy("anchor", "digest").agg(F.min(F.struct("rid", "th", "pos")).alias("own"), F.count("*").alias("copies"), F.max("inner").alias("inner")), "first-pieces")
    n = F.col("pos").bitwiseAND(255).alias("n")
    copies = stored(firsts.where("copies > 1").select("anchor", "digest", "own"), "copied-pieces")
    copied = suspects.join(copies, ["anchor", "digest"]).where(F.struct("rid", "th", "pos") != F.col("own")).select("rid", "th", _first().alias("first"), n)

    contested = stored(firsts.groupBy("anchor").agg(F.count("*").alias("contents"), F.max("inner").alias("inner")).where("contents > 1 or inner").select("anchor", (F.col("contents") > hot).alias("hot")), "contested")
    wanted = firsts.select("anchor", "own.rid", "own.th", "own.pos").join(contested, "anchor")
    wanted = wanted.groupBy("rid", "th").agg(F.collect_list(F.struct("anchor", "pos", "hot")).alias("wanted"))
    contents = stored(
        keyed.select("rid", "th", "raw").join(stored(wanted, "wanted"), ["rid", "th"]).select("rid", "th", "raw", "wanted")
        .mapInArrow(lambda it: _contents_of(it, window), "anchor long, rid long, th long, pos long, held binary, hot boolean"),
        "contents",
    )
    buckets = max(1, -(-contents.where("not hot").count() // bucket))
    dealt = contents.where("not hot").select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "rid", "th", "pos", "held")
    compared = dealt.groupBy("bucket").applyInArrow(lambda t: _compare(t, window), "rid long, th long, first long, n long")

    at = F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("at")
    single = contents.where("hot").select("rid", "th", "pos", "held", at).select(
        "rid", "th", (_first() + F.col("at")).alias("first"), F.expr(f"substring(held, at + 1, {window})").alias("held")
    )
    earliest = stored(single.groupBy("held").agg(F.min(F.struct("rid", "th", "first")).alias("own"), F.count("*").alias("n")).where("n > 1").select("held", "own"), "hot-windows")
    apart = single.join(earliest, "held").where(F.struct("rid", "th", "first") != F.col("own")).select("rid", "th", "first", F.lit(1).cast("long").alias("n"))
    return keyed, copied.unionByName(compared).unionByName(apart)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (spans of bytes, ends in), kept (binary)."""
    keyed, runs = repeated_spans(docs, doc_id, text, window, **sizes)
    lists = stored(runs.distinct().groupBy("rid", "th").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "spans")

    @F.pandas_udf("n_bytes long, n_removed long, removed array<struct<first: long, last: long>>, kept binary")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, runs in zip(texts, lists, strict=True):
            if runs is None or not len(runs):
                rows.append((len(raw), 0, [], raw))
                continue
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, [r["first"] for r in runs], 1)
            np.add.at(depth, [r["first"] + r["n"] + window - 1 for r in runs], -1)
            gone = np.cumsum(depth)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2).tolist()
            rows.append((len(raw), int(gone.sum()), [{"first": a, "last": b - 1} for a, b in edge], np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "removed", "kept"])

    joined = keyed.join(lists, ["rid", "th"], "left")
    return joined.select("doc_id", cut("raw", "runs").alias("cut")).select("doc_id", "cut.*")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
