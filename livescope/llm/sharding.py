"""Sharding by a weighted hash tree of regions, racks and shards (DataFrame functions only).

A key goes down the tree: at each level every child draws ``-ln(u) / weight`` from a hash u
of the key and the child's path, and the least draw wins. So a child is taken in
proportion to its weight, and a child whose weight changes only gains keys from its
siblings or loses keys to them. A node's weight is the sum of its shards' weights:
a change at a shard is felt in the subtrees on the way to it, between all other subtrees
no key moves. A shard that joins as a region of its own takes keys only into itself.

The tree is configuration, a few rows that the driver holds. Keys are placed where
their rows are read; slots, the gapless places within a shard, come from counts by shard
and range of ids, so no shard is ever one task. Texts are read once and don't move.

Cases: a null text has no bytes; a null id counts as the largest one, and all its rows go to
one shard, as the key decides, while their slots still come from many ranges; rows that repeat an id
get a slot each; a text of any length is one row of fixed size; a table without rows gives none;
other columns are ignored. Shards of weight 0 take no keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, id_of, stored, text_of


class Shard(NamedTuple):
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """So many regions of so many racks of so many shards, all of weight 1, numbered from 0."""
    return [Shard(n, f"region-{n // (racks * shards)}", f"rack-{n // shards % racks}") for n in range(regions * racks * shards)]


def with_own_region(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree and one more shard in a region of its own, which takes keys only into itself."""
    new = 1 + max(s.shard for s in tree)
    return [*tree, Shard(new, f"region-of-{new}", "rack-0", weight)]


def _paths(s: Shard) -> tuple[str, str, str]:
    return s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"


def _checked(tree: Iterable[Shard]) -> list[Shard]:
    found = sorted(tree)
    if len({s.shard for s in found}) < len(found):
        raise ValueError("a shard stands twice in the tree")
    if any(not 0 <= s.weight < float("inf") or "/" in s.region + s.rack for s in found):
        raise ValueError("weights are finite and not negative, names hold no slash")
    found = [s for s in found if s.weight]
    if not found:
        raise ValueError("no shard has a weight")
    return found


def _children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """path -> path of each child -> its weight; the root's path is empty."""
    found: dict[str, dict[str, float]] = {}
    for s in tree:
        for above, path in zip(("", *_paths(s)), _paths(s)):
            of = found.setdefault(above, {})
            of[path] = of.get(path, 0.0) + s.weight
    return found


def draw(key: Column, path: Column, weight: Column) -> Column:
    """The first 52 bits of an MD5 as a number u between 0 and 1, then -ln(u) / weight."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def place(key: Column, tree: Iterable[Shard]) -> Column:
    """The shard of a string key that is not null."""
    leaves = _checked(tree)
    below = _children(leaves)
    table = F.create_map(*[
        x for path, of in below.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in of.items()]))
    ])
    at = F.lit("")
    for _ in range(3):
        at = F.array_min(F.transform(table[at], lambda c: F.struct(draw(key, c.path, c.weight).alias("draw"), c.path.alias("path")))).path
    return F.element_at(F.split(at, "/"), -1).cast("int")


def sharded(docs: DataFrame, tree: Iterable[Shard], grown: Iterable[Shard] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: one row per row of docs.

    ``grown_shard`` is the place in a second tree, null without one.
    """
    key, body = id_of(docs, doc_id).cast("string"), text_of(docs, text).cast("binary")
    rows = stored(
        docs.select(
            docs[doc_id].cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            place(key, tree).alias("shard"),
            (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "placed",
    )
    # Ranges of (id, place in the input): an id that many rows share is cut as well.
    order = [F.col("doc_id").asc_nulls_last(), F.col("at")]
    ranges = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = stored(
        counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start")), "range-starts"
    )
    within = ranges.withColumn("no", F.row_number().over(W.partitionBy("shard", "part").orderBy(*order)))
    return within.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("no") - 1).cast("long").alias("slot"), "grown_shard"
    )


#: 16 shards; the 17th comes as a region of its own.
TREE = even_tree(regions=2, racks=2, shards=4)
GROWN = with_own_region(TREE)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), TREE, GROWN).withColumn("law", F.lit("key"))


def _sql_tree(name: str, tree: list[Shard]) -> str:
    """Each level as (above, path, weight)."""
    rows = ", ".join(f"('{above}', '{path}', {w})" for above, of in _children(tree).items() for path, w in of.items())
    return f"{name}(above, path, weight) AS (VALUES {rows})"


def _sql_descent(name: str, tree: str) -> str:
    """Three levels of least draws."""
    level = (
        "SELECT doc_id, arg_min(path, {{draw: -ln((('0x' || substr(md5(doc_id || '/' || path), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight, path: path}}) AS path"
        " FROM {rows} JOIN {tree} ON {on} GROUP BY doc_id"
    )
    first = level.format(rows="ids", tree=tree, on=f"{tree}.above = ''")
    later = [level.format(rows=f"(SELECT doc_id, path AS up FROM {name}{k})", tree=tree, on=f"{tree}.above = up") for k in (1, 2)]
    return f"{name}1 AS ({first}), {name}2 AS ({later[0]}), {name}3 AS ({later[1]})"


#: crc32 bit by bit: each byte is xored in, then eight shifts follow.
SQL_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode({0})), '..'),"
    " lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))))"
)

OP11_SQL = f"""
WITH {_sql_tree('tree', TREE)}, {_sql_tree('wider', GROWN)}, ids AS (SELECT DISTINCT doc_id FROM documents),
{_sql_descent('a', 'tree')}, {_sql_descent('b', 'wider')}
SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {SQL_CRC32.format("coalesce(text, '')")} AS text_crc32, 'key' AS law,
  split_part(a3.path, '/', 3)::INTEGER AS shard, row_number() OVER (PARTITION BY a3.path ORDER BY d.doc_id) - 1 AS slot, split_part(b3.path, '/', 3)::INTEGER AS grown_shard
FROM documents d JOIN a3 USING (doc_id) JOIN b3 USING (doc_id)
"""
