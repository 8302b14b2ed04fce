"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``d`` bits have a common variant within
``ceil(d / 2)`` bits of both. So every distinct fingerprint emits all its variants in
that ball, variants meet in a shuffle, and those that meet are verified. Copies share
a fingerprint, so a group of copies is one row before anything is emitted, and at most
1 + 64 distinct fingerprints (for d = 2) can meet on a variant: no variant is hot.
Fingerprints that meet are linked to the smallest one there, which keeps their
component without making all pairs.

Cases: a null or blank text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle of them all; a null ``doc_id`` counts as the
largest. Rows that repeat a ``doc_id`` each get a row; texts are read whole at any length; a
table without rows gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import mixed
from .common import LAST_ID, all_columns, column_of_row, documents, id_of, set_apart, stored, stored_alone, text_of
from .components import components

SEED = 42
#: Independent fingerprints of the wide form.
LANES = 8
#: Keys that similar texts meet on, and smallest shingles in each.
KEYS, MINIMA = 32, 6
#: Documents of a key compared in one place, about; more are dealt out by pairs of parts.
CROWD = 4_096
#: Shingles of a part of a key whose documents are compared by their sets; each document counts as some more.
PART, EACH = 1 << 20, 500
#: Partners of a document that a task looks at first, and by how much more it looks at in each round.
PARTNERS, WIDER = 64, 16
_BLOCK = 1 << 15
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, KEYS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return np.array([hashed(joined, SEED)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    spans = zip(starts[:n].tolist(), (starts[width:] - 1).tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def simhash(text: str, width: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (long)."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return docs.select(docs[doc_id].alias("doc_id"), fingerprint(text_of(docs, text)).alias("fp"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (variant, fp) sorted by both: the smallest fingerprint of each variant with each other one."""
    last_variant, last_fp = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, fp = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.ones(len(fp), bool)
        new[1:] = variant[1:] != variant[:-1]
        new[0] = last_variant is None or variant[0] != last_variant
        heads = np.concatenate(([last_fp], fp[new])) if not new[0] else fp[new]
        head = heads[np.cumsum(new) - (1 if new[0] else 0)]
        linked = head != fp
        yield pa.RecordBatch.from_arrays([pa.array(head[linked]), pa.array(fp[linked])], names=["a", "b"])
        last_variant, last_fp = variant[-1], head[-1]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): verified links between distinct fingerprints ``fp``, enough for their components.

    Only for even distances, where all that meet on a variant are within ``distance`` of one another.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    masks = [sum(1 << i for i in bits) for r in range((distance + 1) // 2 + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = distinct.select(
        F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed])).alias("variant"), "fp"
    )
    met = variants.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(_stars, "a long, b long")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id, n_links (of its fingerprint's star): one row per row of docs."""
    marked = stored(fingerprints(docs, doc_id, text, width), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min(id_of(marked)).alias("first_id")), "simhash-distinct")
    edges = stored(links(distinct, distance), "simhash-links")
    roots = components(edges)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "simhash-roots")
    ids = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-ids")
    named = stored(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def wide_simhash(distinct: np.ndarray) -> list[int]:
    """LANES independent fingerprints of the same distinct shingles, as signed 64-bit integers."""
    out = []
    for lane in range(LANES):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(distinct), _BLOCK):
            block = mixed(distinct[at : at + _BLOCK] + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(distinct), bitorder="little").view(np.int64)[0]))
    return out


def meeting_keys(distinct: np.ndarray) -> list[int]:
    """64-bit keys, each of MINIMA smallest permuted shingles: texts agree on one with the MINIMA-th power of their Jaccard similarity."""
    if not len(distinct):
        return []
    least = np.min([np.multiply.outer(_ODD, distinct[at : at + 2048]).min(axis=1) for at in range(0, len(distinct), 2048)], axis=0)
    rows, key = least.reshape(-1, MINIMA), np.arange(KEYS, dtype=np.uint64)
    for i in range(MINIMA):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64).tolist()


def spanning(wide: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unsigned fingerprints: places (a, b) of pairs within ``most`` bits that connect all that any such pairs connect."""
    left, todo, a, b = np.arange(len(wide)), [], [], []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.bitwise_count(wide[left] ^ wide[at]).sum(axis=1) <= most
        found, left = left[near], left[~near]
        todo.extend(found.tolist())
        a.append(np.full(len(found), at))
        b.append(found)
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def nearest(wide: np.ndarray, group: np.ndarray, most: int, partners: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of each fingerprint the places of its nearest ones of larger groups within ``most`` bits, and whether any has more than ``partners``.

    Groups of one size go by their number, so of two groups one asks: members of a large group don't all ask for the same outsider.
    """
    a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    if (group == group[0]).all():
        return a[0], b[0], False
    _, which, times = np.unique(group, return_inverse=True, return_counts=True)
    rank = np.argsort(np.lexsort((np.arange(len(times)), times)))[which]
    for at in np.flatnonzero(rank < rank.max()).tolist():
        apart = np.bitwise_count(wide ^ wide[at]).sum(axis=1)
        found = np.flatnonzero((apart <= most) & (rank > rank[at]))
        if len(found) > partners:
            found, more = found[np.argsort(apart[found], kind="stable")[:partners]], True
        a.append(np.full(len(found), at))
        b.append(found)
    return np.concatenate(a), np.concatenate(b), more


_PAIRS = "key long, a long, b long"


def _met(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From (key, rep, wide) sorted by key: pairs (a, b) of each key that span what is near in it, to be verified."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)]
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = [*(batch.column(i).to_numpy() for i in range(2)), batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, LANES)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        # The last key may go on in the next batch.
        ready = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
        (key, rep, wide), held = [x[:ready] for x in held], [x[ready:] for x in held]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        sizes = np.diff(np.append(first, len(key)))
        two = first[sizes == 2]
        two = two[(np.bitwise_count(wide[two] ^ wide[two + 1]).sum(axis=1) <= most) & (rep[two] != rep[two + 1])]
        a, b = [two], [two + 1]
        for at, size in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = spanning(wide[at : at + size], most)
            a.append(x + at)
            b.append(y + at)
        a, b = np.concatenate(a), np.concatenate(b)
        rows = np.unique(np.column_stack([key[a], np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["key", "a", "b"])


def joining(wide: np.ndarray, group: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """Places (a, b) of texts of different groups, within ``most`` bits and of that Jaccard similarity, enough to join all groups that any such texts join."""
    now, size = np.unique(group, return_inverse=True)[1], np.array([len(s) for s in sets])
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    own, has = np.split(at, np.cumsum(size)[:-1]), np.zeros(len(shingles), bool)
    out, partners, more = [], PARTNERS, True
    while more:
        a, b, more = nearest(wide, now, most, partners)
        for x, ys in zip(a[(new := np.flatnonzero(np.diff(a, prepend=-1)))].tolist(), np.split(b, new[1:]), strict=False):
            ys = ys[now[ys] != now[x]]
            has[own[x]] = True
            shared = np.array([np.count_nonzero(has[own[y]]) for y in ys.tolist()], np.int64)
            has[own[x]] = False
            for y in ys[shared >= similarity * (size[x] + size[ys] - shared)].tolist():
                if now[y] != now[x]:
                    out.append((x, y))
                    now[now == now[y]] = now[x]
        partners *= WIDER
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """The rows of batches of (key, rep, group, wide, set)."""
    for batch in batches:
        key, rep, group = (batch.column(i).to_pylist() for i in range(3))
        yield from zip(key, rep, group, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4)), strict=True)


def _joined(batches: Iterator[pa.RecordBatch], most: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """From (key, rep, group, wide, set) sorted by key: similar pairs (a, b) that join the groups of each key."""
    for _, own in groupby(_rows(batches), key=itemgetter(0)):
        _, rep, group, wide, sets = zip(*own, strict=True)
        found = joining(np.array(wide).view(np.uint64), np.array(group), list(sets), most, similarity) if len(set(group)) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([rep[x] for x, _ in found], pa.int64()), pa.array([rep[y] for _, y in found], pa.int64())], names=["a", "b"])


def farthest(similarity: float) -> int:
    """Differing bits of all lanes at that Jaccard similarity, or above it in one pair of some 200.

    Sets of one size with similarity j have cosine 2j / (1 + j), others a greater one; 2.6 standard deviations are added.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(64 * LANES * p + 2.6 * np.sqrt(64 * LANES * p * (1 - p))))


def _sets(asked: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """rid, set: the distinct shingles of each text of the documents in asked(rid)."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], dtype=object)

    own = docs.select(id_of(docs, doc_id).alias("rid"), text_of(docs, text).alias("text")).join(asked, "rid", "left_semi").distinct()
    return stored(own.select("rid", shingles("text").alias("set")), "shingle-sets")


def _parts(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """rows with keys of over ``most`` dealt into parts: each two parts of a key meet under a key of their own."""
    crowds = rows.groupBy("key").agg(F.sum(weight).alias("n")).where(F.col("n") > most)
    crowds = stored(crowds.select("key", F.ceil(F.col("n") / most).alias("parts")), "crowded-keys")
    part, other = F.pmod(F.xxhash64("rep"), F.col("parts")), F.col("other")
    spread = rows.join(crowds, "key", "left").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
    place = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(part, other), F.greatest(part, other)))
    return spread.withColumn("key", place).drop("parts", "other")


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    """pairs(a, b) with similar: whether their sets of shingles have that Jaccard similarity. Only documents in pairs are cut again."""
    asked = stored(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct(), "asked")
    sets = _sets(asked, docs, doc_id, text, width)
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    enough = shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared)
    # An id may stand for several texts: one similar pair of them is enough.
    return stored(both.select("a", "b", enough.alias("similar")).groupBy("a", "b").agg(F.bool_or("similar").alias("similar")), "verified-pairs")


def ball_pairs(reps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): of reps(rep, wide), enough pairs for all components of first fingerprints within ``distance`` bits; equal ones go with the first document."""
    own = reps.select(F.col("wide")[0].alias("fp"), "rep")
    heads = stored(own.groupBy("fp").agg(F.min("rep").alias("head")), "ball-heads")
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
    near = links(heads.select("fp"), distance).join(a, "a").join(b, "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    equal = own.join(heads, "fp").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    return stored(near.union(equal).where("a <> b").distinct(), "ball-pairs")


def _apart(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The pairs (key, a, b) whose ends are not in one group of grouped(node, root)."""
    a, b = (grouped.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("key", "a", "b")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """rid, root: the smallest id that each document reaches over pairs of texts whose sets of shingles have that Jaccard similarity or more.

    Balls of the first lane's fingerprints come first: what they link within two bits and its sets confirm is
    one group from there on. A pair at similarity 0.8 differs in some 15 bits of 100, too many for balls of a key that
    stays selective. For those, documents meet on 64-bit keys made of their smallest shingles, and
    bring all bits of all lanes with them; pairs of one group are not asked again. Fingerprints only sort out pairs that are too far apart;
    what is left is verified exactly. First a key proposes pairs that span all that is near in it: if
    they hold, the rest of the key's pairs adds nothing. Where one did not hold, the documents of the key meet
    again with their sets, and a task gives only similar pairs that join groups, fewer than it has documents.
    In a crowded key documents are dealt into parts, and each two parts are compared in a place of their own.
    Texts with equal sets of shingles are one from the start.
    """

    @F.pandas_udf("wide array<long>, keys array<long>, same long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts]
        return pd.DataFrame({"wide": [wide_simhash(s) for s in sets], "keys": [meeting_keys(s) for s in sets], "same": [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]})

    marked = docs.select(id_of(docs, doc_id).alias("rid"), marks(text_of(docs, text)).alias("marks"))
    marked = stored(marked.select("rid", "marks.wide", "marks.keys", "marks.same"), "wide-simhash")
    reps = stored(marked.groupBy("wide", "same").agg(F.min("rid").alias("rep"), F.first("keys").alias("keys")), "wide-distinct")
    balls = _verified(ball_pairs(reps), docs, doc_id, text, width, similarity).where("similar").select("a", "b")
    grouped = components(balls)
    dealt = reps.select(F.explode("keys").alias("key"), "rep", "wide")
    placed, most = _parts(dealt, F.lit(1), CROWD), farthest(similarity)
    met = placed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _met(it, most), _PAIRS)
    met = stored(_apart(stored(met, "met-on-keys"), grouped), "met")
    pairs = _verified(met.select("a", "b").distinct(), docs, doc_id, text, width, similarity)
    links = balls.union(pairs.where("similar").select("a", "b"))
    roots = components(links)
    again = stored(met.join(pairs.where("not similar"), ["a", "b"], "left_semi").select("key").distinct(), "open-keys")
    rows = placed.join(again, "key", "left_semi").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("group"), "wide")
    # Keys whose documents are all of one group by now have nothing left to join.
    several = rows.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("last")).where("least < last").select("key")
    rows = stored(rows.join(several, "key", "left_semi"), "open-rows")
    if not rows.isEmpty():
        sets = _sets(rows.select(F.col("rep").alias("rid")).distinct(), docs, doc_id, text, width).withColumnRenamed("rid", "rep")
        sizes = sets.groupBy("rep").agg(F.sum(F.size("set") + EACH).alias("weight"))
        parts = _parts(rows.join(sizes, "rep"), F.col("weight"), PART).join(sets, "rep").select("key", "rep", "group", "wide", "set")
        found = parts.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _joined(it, most, similarity), "a long, b long")
        found = stored(found.distinct(), "joining-pairs")
        if not found.isEmpty():
            roots = components(links.union(found))
    named = stored(reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("wide", "same", F.coalesce("root", "rep").alias("root")), "wide-roots")
    return marked.select("rid", "wide", "same").join(named, ["wide", "same"]).select("rid", "root")


def first_of_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows and columns of docs that reach no smaller doc_id."""
    gone = stored_alone(lambda: similar_groups(docs, width=width, similarity=similarity).where("rid > root").select("rid").distinct(), "later-near-copies")
    rid = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID))
    asked, others = set_apart(docs.select(all_columns(docs)), rid, gone.select(F.col("rid").alias("key")))
    return asked.join(gone, rid == gone["rid"], "left_anti").union(others).select(*[column_of_row(c).alias(c) for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
