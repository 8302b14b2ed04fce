"""The trie of all conversations' prefixes, by union-find over sorted neighbours.

A conversation is a row of 128-bit digests of its turns. Rows are sorted by it over the whole
cluster, so that conversations with a common prefix are neighbours, and the depth of the
turns that two neighbours share (their LCP) is an edge. Each partition joins its rows by
union-find over the edges in descending depth: a merge of two components makes a branching node,
and the turns down to where a component last merged are a chain of nodes with the same members.
Sizes, smallest members, children, leaves and saved words follow from prefix sums over rows.

Nodes that hold neither the first nor the last row of a partition are finished there. The others,
two paths a partition, are its contracted forest: they are merged across boundaries, depth by
depth, where the last row of a partition shares so many turns with the first row of the next.

Cases: a row without conv_id belongs to no conversation; null turns come first, equal turns go by
their digest; null role and text are empty; a conversation may be without turns and then is a
member of the root alone; rows that repeat all values are turns of their own; an empty table has no
root; texts of any length are digests here; other columns are ignored. A conversation itself is a group
of rows, 16 bytes a turn. Conversations that thousands share are cut by id when rows are sorted, and the ids that
end at such a node go to its hash as pieces of text, in order and one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .sharding import SQL_CRC32

DIGEST = 16
#: Ids in a piece of text that is sent on to be hashed, and nodes in a batch of results.
PIECE, BATCH = 8192, 65_536
NOTHING = hashlib.sha256(b"").hexdigest()
NODE, SPINE, ENDS, BOUNDARY = range(4)

_OUT = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("depth", pa.int32()), ("side", pa.int32()), ("whole", pa.bool_()), ("parent_side", pa.int32()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("before", pa.int64()), ("ends", pa.string()), ("piece", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()),
    ("sums", pa.list_(pa.int64())),
])
_SPARK_OUT = (
    "kind int, part int, depth int, side int, whole boolean, parent_side int, conv_id long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved long, before long, ends string, piece int, first_key binary, last_key binary, sums array<long>"
)


# ---- conversations as rows of digests


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words: one row per row that has a conv_id."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """conv_id, key, words: each conversation with its first h turns from the first conversation of its block.

    h is crc32(conv_id) modulo ``most``. Turns are dealt by block, so grouping and join share one shuffle.
    """
    dealt = turns(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % block).repartition("base")
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "words")
    own = dealt.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(one)).alias("own"))
    heads = own.where("conv_id = base").select("base", F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.coalesce("head", F.slice("own", 1, 0))
    joined = own.join(heads, "base", "left").select(
        "conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))).alias("all")
    )
    return joined.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("all", lambda t: t.digest), "")).alias("key"),
        F.transform("all", lambda t: t.words.cast("long")).alias("words"),
    )


# ---- one partition


def common_turns(a: bytes, b: bytes) -> int:
    """How many digests two keys share from their start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class _Forest:
    """Nodes of a sorted partition that branch or where a row ends.

    ``depth``, ``lo``, ``hi``, ``least``, ``children`` and ``parent`` by node; the chain of a node starts
    below its parent's depth.
    """

    def __init__(self, ids: np.ndarray, lens: np.ndarray, lcp: np.ndarray):
        n = len(ids)
        depth, lo, hi, least = lens.tolist(), list(range(n)), list(range(n)), ids.tolist()
        children, parent, same = [0] * n, [-1] * n, list(range(n))
        leader, node = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while leader[x] != x:
                leader[x] = x = leader[leader[x]]
            return x

        for r in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
            d, a, b = int(lcp[r]), find(r - 1), find(r)
            left, right = node[a], node[b]
            if depth[left] == d and depth[right] == d:
                new, same[right] = left, left
                children[left] += children[right]
            elif depth[left] == d:
                new, parent[right] = left, left
                children[left] += 1
            elif depth[right] == d:
                new, parent[left] = right, right
                children[right] += 1
            else:
                new = len(depth)
                for values, value in ((depth, d), (lo, 0), (hi, 0), (least, 0), (children, 2), (parent, -1), (same, new)):
                    values.append(value)
                parent[left] = parent[right] = new
            lo[new], hi[new], least[new] = lo[left], hi[right], min(least[left], least[right])
            if hi[b] - lo[b] > hi[a] - lo[a]:
                a, b = b, a
            leader[b], node[a] = a, new

        def settled(x: int) -> int:
            while same[x] != x:
                same[x] = x = same[same[x]]
            return x

        kept = [k for k in range(len(depth)) if same[k] == k]
        place = {k: i for i, k in enumerate(kept)}
        self.depth, self.lo, self.hi, self.least, self.children = (np.array([v[k] for k in kept], np.int64) for v in (depth, lo, hi, least, children))
        self.parent = np.array([place[settled(parent[k])] if parent[k] >= 0 else -1 for k in kept], np.int64)
        self.first, self.last = place[settled(0)], place[settled(n - 1)]


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": np.full(n, kind)}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT
    )


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _partition(
    part: int, ids: np.ndarray, lens: np.ndarray, lcp: np.ndarray, sums: np.ndarray, starts: np.ndarray, keys: tuple[bytes, bytes], piece: int, most: int
) -> Iterator[pa.RecordBatch]:
    """Finished nodes, both paths at the borders, the ids that end on them, and the border rows.

    ``sums[starts[r] + e] - sums[starts[r]]`` is the number of words of row r's first e turns.
    """
    n, forest = len(ids), _Forest(ids, lens, lcp)
    inner = np.arange(1, n)
    shared = np.concatenate([[0], np.cumsum(sums[starts[inner] + lcp[inner]] - sums[starts[inner]])])
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:] < lens[:-1], False))])  # the last row's own is known later
    equal = np.append((lcp[1:] == lens[1:]) & (lcp[1:] == lens[:-1]), False)  # to the next row
    ends_at = np.flatnonzero(~equal)

    def run(k: int) -> np.ndarray:
        """The ids that end at node k."""
        if lens[forest.lo[k]] != forest.depth[k]:
            return ids[:0]
        lo = forest.lo[k]
        return ids[lo : min(ends_at[np.searchsorted(ends_at, lo)], forest.hi[k]) + 1]

    def values(k: np.ndarray, d: np.ndarray) -> dict:
        lo, hi = forest.lo[k], forest.hi[k]
        before = np.where(d > 0, sums[starts[lo] + np.maximum(d - 1, 0)] - sums[starts[lo]], 0)
        return {
            "depth": d, "part": np.full(len(k), part), "conv_id": forest.least[k], "n_convs": hi - lo + 1,
            "n_children": np.where(d == forest.depth[k], forest.children[k], 1), "n_leaves": leaf[hi + 1] - leaf[lo],
            "saved": shared[hi] - shared[lo] - (hi - lo) * before, "before": before,
        }

    border = (forest.lo == 0) | (forest.hi == n - 1)
    top = np.where(forest.parent >= 0, forest.depth[forest.parent], -1)
    inside = np.flatnonzero(~border)
    chains = np.cumsum(forest.depth[inside] - top[inside])
    for at in range(0, len(inside), most):  # a batch of chains; chains themselves may be longer
        k = inside[at : at + most]
        times = forest.depth[k] - top[k]
        each = np.repeat(k, times)
        d = np.arange(len(each)) - np.repeat(chains[at : at + most] - times - (chains[at - 1] if at else 0), times) + top[each] + 1
        uppermost, above = d == top[each] + 1, forest.parent[each]
        waits = uppermost & border[above]
        hashes = {x: hashlib.sha256(_joined(ends).encode()).hexdigest() for x in k.tolist() if len(ends := run(x))}
        yield _batch(
            NODE, len(each), **values(each, d),
            parent_conv_id=pa.array(np.where(uppermost, forest.least[above], forest.least[each]), mask=waits),
            parent_side=pa.array((forest.lo[above] > 0).astype(np.int32), mask=~waits),
            ends=[hashes.get(x, NOTHING) if own else NOTHING for x, own in zip(each.tolist(), (d == forest.depth[each]).tolist())],
        )

    for side, k in ((0, forest.first), (1, forest.last)):
        while k >= 0 and (side == 0 or forest.lo[k] > 0):
            d = np.arange(top[k] + 1, forest.depth[k] + 1)
            each = np.full(len(d), k)
            found, above = values(each, d), forest.parent[k]
            # The first row's part in children is known when the partition before is.
            found["n_children"] = found["n_children"] - ((d < lens[0]) if side == 0 else 0)
            over = side if above < 0 or forest.lo[above] > 0 else 0
            yield _batch(
                SPINE, len(d), **found, side=np.full(len(d), side), whole=np.full(len(d), bool(forest.lo[k] == 0 and forest.hi[k] == n - 1)),
                parent_side=np.where(d == top[k] + 1, over, side),
            )
            ends = run(k)
            for no, at in enumerate(range(0, len(ends), piece)):
                yield _batch(ENDS, 1, part=[part], depth=[forest.depth[k]], side=[side], piece=[no], ends=[_joined(ends[at : at + piece])])
            k = above
    yield _batch(BOUNDARY, 1, part=[part], first_key=[keys[0]], last_key=[keys[1]], sums=[(sums[starts[0] : starts[0] + lens[0] + 1] - sums[starts[0]]).tolist()])


def _sorted_rows(batches: Iterator[pa.RecordBatch], piece: int, most: int) -> Iterator[pa.RecordBatch]:
    """The forest of one sorted partition of (part, conv_id, key, words)."""
    ids, lens, lcp, words, first, last = [], [], [], [], None, b""
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0)[0].as_py()
        ids.append(batch.column(1).to_numpy())
        words.append(batch.column(3).flatten().to_numpy(zero_copy_only=False))
        for key in batch.column(2):
            key = key.as_py()
            if first is None:
                first = key
            lens.append(len(key) // DIGEST)
            lcp.append(common_turns(last, key))
            last = key
    if first is not None:
        count = np.array(lens, np.int64)
        sums = np.concatenate([[0], np.cumsum(np.concatenate(words))]).astype(np.int64)
        yield from _partition(part, np.concatenate(ids), count, np.array(lcp, np.int64), sums, np.cumsum(count) - count, (first, last), piece, most)


# ---- across partitions


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, shared, words_shared, first_len, last_len: what a partition's first row shares with the row before it."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            common = -1 if row["before_key"] is None else common_turns(row["before_key"], row["first_key"])
            out.append((row["part"], common, row["sums"][max(common, 0)], len(row["first_key"]) // DIGEST, len(row["last_key"]) // DIGEST))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())], names=["part", "shared", "words_shared", "first_len", "last_len"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each (depth, run) over sorted pieces of ids; one piece is held at a time."""
    at, state, out = None, None, []
    for batch in batches:
        for depth, run, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "run", "ends"))):
            if (depth, run) != at:
                if state:
                    out.append((*at, state.hexdigest()))
                at, state = (depth, run), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if state:
        out.append((*at, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int64(), pa.string()))], names=["depth", "run", "sha"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has conv_id (distinct), key (16 bytes a turn) and words (a number a turn).
    """
    rows = stored(sequences.select("conv_id", "key", "words"), "sequences")
    placed = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "key", "words")
    found = stored(placed.mapInArrow(partial(_sorted_rows, piece=PIECE, most=BATCH), _SPARK_OUT), "forests")

    # One row a partition: what its first row shares with the last one before it, and its last with the next.
    keys = found.where(F.col("kind") == BOUNDARY).select("part", "first_key", "last_key", "sums")
    before = keys.withColumn("before_key", F.lag("last_key").over(W.orderBy("part")))
    shared = stored(before.mapInArrow(_borders, "part int, shared int, words_shared long, first_len int, last_len int"), "borders")
    borders = shared.withColumn("shared_next", F.coalesce(F.lead("shared").over(W.orderBy("part")), F.lit(-1)))

    # Both paths of each partition, at one depth in order: a piece goes on where its first row shares so much.
    goes_on = (F.col("side") == 0) & (F.col("shared") >= F.col("depth"))
    piece = found.where(F.col("kind") == SPINE).join(borders, "part").select(
        "part", "depth", "side", "parent_side", "conv_id", "n_convs", (~goes_on).alias("starts"),
        (F.col("n_children") + F.when((F.col("side") == 0) & (F.col("shared") <= F.col("depth")) & (F.col("depth") < F.col("first_len")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") + F.when((F.col("whole") | (F.col("side") == 1)) & (F.col("shared_next") < F.col("last_len")), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + F.when(goes_on, F.col("words_shared") - F.col("before")).otherwise(0)).alias("saved"),
    )
    pieces = stored(piece.withColumn("run", F.sum(F.col("starts").cast("long")).over(W.partitionBy("depth").orderBy("part", "side"))), "pieces")
    merged = stored(pieces.groupBy("depth", "run").agg(*[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("conv_id").alias("conv_id")), "merged")

    # Which node each piece became, for those that have it as parent.
    became = stored(pieces.select("part", "depth", "side", "run").join(merged.select("depth", "run", "conv_id"), ["depth", "run"]).select(
        "part", (F.col("depth") + 1).alias("depth"), F.col("side").alias("parent_side"), F.col("conv_id").alias("parent_conv_id")), "parents")
    above = pieces.where("starts").join(became, ["part", "depth", "parent_side"]).select("depth", "run", "parent_conv_id")
    ends = found.where(F.col("kind") == ENDS).select("part", "depth", "side", "piece", "ends").join(pieces.select("part", "depth", "side", "run"), ["part", "depth", "side"])
    in_order = ends.select("depth", "run", "part", "side", "piece", "ends").repartition("depth", "run").sortWithinPartitions("depth", "run", "part", "side", "piece")
    hashes = in_order.mapInArrow(_hashed, "depth int, run long, sha string")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    spine = merged.join(above, ["depth", "run"], "left").join(hashes, ["depth", "run"], "left").withColumn("ends", F.coalesce("sha", F.lit(NOTHING))).select(columns)
    nodes = found.where(F.col("kind") == NODE)
    waiting = nodes.where("parent_conv_id IS NULL").drop("parent_conv_id").join(became, ["part", "depth", "parent_side"])
    whole = nodes.where("parent_conv_id IS NOT NULL").select(columns).unionByName(waiting.select(columns)).unionByName(spine)
    return whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{digest: digest, words: words}} ORDER BY turn NULLS FIRST, digest, words) AS own, {SQL_CRC32.format('conv_id::VARCHAR')} % 4 AS h FROM t GROUP BY conv_id),
q AS (SELECT o.conv_id, list_concat(coalesce(b.own, [])[1:o.h], o.own[o.h + 1:]) AS q FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, unnest(range(0, len(q) + 1)) AS depth, q FROM q),
m AS (SELECT array_to_string(list_transform(q[1:depth], lambda x: x.digest), '') AS path, depth, conv_id, len(q) = depth AS ends, CASE WHEN depth > 0 THEN q[depth].words ELSE 0 END AS words FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY ALL),
c AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
a AS (SELECT left(path, 32 * up) AS path, n_children, n_convs, words FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM k)),
s AS (SELECT path, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM a GROUP BY path)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (path) LEFT JOIN k u ON k.depth > 0 AND u.path = left(k.path, 32 * (k.depth - 1)) AND u.depth = k.depth - 1
"""
