"""Document fingerprints by invertible Bloom lookup sketches (DataFrame functions only).

A text is cut into paragraphs: up to the first line end after 64 characters, 256 characters
at most, by one rule for texts of any length. A sketch has three rows of cells; every distinct
paragraph digest is added to one cell in each row, a cell holding a count and the XORs of its
digests and of their check sums. Sketches are made by a hash aggregate over (text, cell): three
rows a digest, never cells times digests. Two sketches of one size subtract cell by cell, what
both texts have cancels out, and cells with a single digest are peeled until nothing is left:
the digests that differ. A pass takes the three rows of cells in turn, so that a digest is found
in one cell only. Where cells are left over, both texts are sketched again with four times the
cells. Likeness is the share of all digests of either text that both have.

The fingerprint is a text's own sketch, written out; its size follows from the number of its
digests alone, so equal texts have equal fingerprints. A pair is compared at the greater of
both sizes, or at a greater one still where the difference of a fixed quarter of the digests
(those that end in two zero bits) says that it would not peel. All of a document's cells are
in one partition, so sketching, subtracting and peeling shuffle its digests once.

The edited text of a document takes its end from the next one in descending ``doc_id``:
documents are dealt into ranges of ids, sorted there, and a range's last document takes the
first of the next range, so texts are shuffled once and no task sees more than its ranges.

Cases: null text is empty, has no digests, and is like any other empty text (1.0). A null
``doc_id`` counts as the largest; rows that repeat a ``doc_id`` follow each other in the
order of their texts' hashes. A single document is its own next; a table without rows gives
none. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, id_of, stored, text_of

#: Cells of a row of the smallest sketch, of three rows; growth at a retry; passes over the three rows.
CELLS, ROWS, GROWTH, PASSES = 16, 3, 4, 3
#: Digests to a cell of a row in a text's own sketch, at most.
LOAD = 4
#: Documents of a range, about, and ranges at most (their bounds are sent to every task).
RANGE, RANGES = 32, 50_000


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{64,256}?\n|.{1,256}"), F.lit(0))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def cells_for(need: Column) -> Column:
    """The least power of two that is at least need and CELLS."""
    least = F.greatest(F.ceil(need).cast("long"), F.lit(CELLS).cast("long"))
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(least - 1)))


def own_cells(held: Column) -> Column:
    return cells_for(F.size(held) / LOAD)


def pair_cells(a: Column, b: Column) -> Column:
    """Where a pair starts: the greater of both sizes, or what the difference of a quarter of the digests asks for."""
    few_a, few_b = (F.filter(x, lambda d: d.bitwiseAND(3) == 0) for x in (a, b))
    apart = 4 * (F.size(F.array_except(few_a, few_b)) + F.size(F.array_except(few_b, few_a)))
    return F.greatest(own_cells(a), own_cells(b), cells_for(apart / 2))


def _check(d: Column) -> Column:
    return F.hash(d, F.lit(17))


def _cell(d: Column, row: int, cells: Column) -> Column:
    return F.xxhash64(d, F.lit(row)).bitwiseAND(cells - 1).cast("int") + row * cells


def sketches(lists: DataFrame, *keys: str) -> DataFrame:
    """keys, cells, cell, and n, k, c of side a and of side b there, from lists(keys, cells, first, held).

    ``held`` are digests of side a where ``first`` is true, of side b otherwise. Rows of a key
    must be in one partition already, or are brought there.
    """
    each = lists.select(*keys, "cells", "first", F.explode("held").alias("d"))
    each = each.select(*keys, "cells", "first", "d", _check(F.col("d")).alias("c"), F.explode(F.array(*[_cell(F.col("d"), r, F.col("cells")) for r in range(ROWS)])).alias("cell"))
    sides = []
    for side, mine in (("a", F.col("first")), ("b", ~F.col("first"))):
        sides += [
            F.count(F.when(mine, 1)).cast("int").alias(f"n{side}"),
            F.coalesce(F.bit_xor(F.when(mine, F.col("d"))), F.lit(0).cast("long")).alias(f"k{side}"),
            F.coalesce(F.bit_xor(F.when(mine, F.col("c"))), F.lit(0)).alias(f"c{side}"),
        ]
    return each.groupBy(*keys, "cells", "cell").agg(*sides)


def subtract(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, cells, cell, tag, n, k, c: side a less side b, without the cells that cancel out."""
    apart = cells.select(
        *keys, "cells", "cell", F.lit(0).cast("long").alias("tag"), (F.col("na") - F.col("nb")).alias("n"),
        F.col("ka").bitwiseXOR(F.col("kb")).alias("k"), F.col("ca").bitwiseXOR(F.col("cb")).alias("c"),
    )
    return apart.where("n <> 0 or k <> 0 or c <> 0")


def _peel_row(state: DataFrame, row: int, named: bool, *keys: str) -> DataFrame:
    """Digests that are alone in a cell of that row leave it and their cells in the other rows."""
    k, cells = F.col("k"), F.col("cells")
    pure = (F.col("cell") >= 0) & (F.abs("n") == 1) & (_check(k) == F.col("c")) & (F.col("cell") == _cell(k, row, cells))
    places = F.when(pure, F.array(F.lit(-1), *[_cell(k, r, cells) for r in range(ROWS) if r != row])).otherwise(F.array("cell"))
    moved = state.select(*keys, "cells", F.col("cell").alias("was"), "tag", "n", "k", "c", F.explode(places).alias("cell"))
    found, left = (F.col("cell") < 0) & (F.col("was") >= 0), (F.col("cell") >= 0) & (F.col("cell") != F.col("was"))
    n = F.when(left, -F.col("n")).otherwise(F.col("n"))
    if named:
        tag = F.when(found, k).otherwise(F.col("tag"))
    else:  # only how many were found: their digests needn't go along
        tag, n = F.col("tag"), F.when(found, F.abs("n")).otherwise(n)
    k, c = (F.col(x) if named else F.when(found, F.lit(0).cast(t)).otherwise(F.col(x)) for x, t in (("k", "long"), ("c", "int")))
    moved = moved.select(*keys, "cells", "cell", tag.alias("tag"), n.alias("n"), k.alias("k"), c.alias("c"))
    summed = moved.groupBy(*keys, "cells", "cell", "tag").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return summed.where("n <> 0 or k <> 0 or c <> 0")


def peeled(state: DataFrame, *keys: str, named: bool = True) -> DataFrame:
    """The state after PASSES over the rows of cells: found digests have cell -1, and n 1 if of side a, -1 if of b.

    Whatever is found or left still adds up to the difference, so where no cell is left the
    digests found are exactly those that differ. Unless ``named``, cell -1 only has their number.
    """
    return reduce(lambda held, row: _peel_row(held, row, named, *keys), [*range(ROWS)] * PASSES, state)


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Of the numbers of digests and of those that are in one only."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - apart) / (a + b + apart))


def _tried(pairs: DataFrame) -> DataFrame:
    """pairs(key, a, b, cells) with found (digests and signs; null where cells are left)."""
    dealt = pairs.repartition("key")
    lists = dealt.select(
        "key", "cells", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("a").alias("held")), F.struct(F.lit(False).alias("first"), F.col("b").alias("held")))).alias("x")
    ).select("key", "cells", "x.*")
    state = peeled(subtract(sketches(lists, "key"), "key"), "key")
    ends = state.groupBy("key").agg(F.max("cell").alias("left"), F.collect_list(F.struct("n", "k")).alias("got"))
    nothing = F.expr("cast(array() as array<struct<n: int, k: bigint>>)")
    return dealt.join(ends, "key", "left").select(*dealt.columns, F.when(F.coalesce("left", F.lit(-1)) < 0, F.coalesce("got", nothing)).alias("found"))


def compare(pairs: DataFrame, cells: int | None = None) -> DataFrame:
    """pairs(key, a, b) of digest lists, with near and the digests only in a and only in b.

    Starts with ``cells`` to a row, or as many as pair_cells() says, and goes on with larger
    sketches until every pair is peeled.
    """
    start = F.lit(cells) if cells else pair_cells(F.col("a"), F.col("b"))
    left, out = pairs.select("key", "a", "b", start.alias("cells")), None
    while True:
        tried = stored(_tried(left), "iblt-pairs")
        good = tried.where("found is not null").select(
            "key",
            likeness(F.size("a"), F.size("b"), F.size("found")).alias("near"),
            F.transform(F.filter("found", lambda f: f.n == 1), lambda f: f.k).alias("only_a"),
            F.transform(F.filter("found", lambda f: f.n == -1), lambda f: f.k).alias("only_b"),
        )
        out = good if out is None else out.unionByName(good)
        left = tried.where("found is null").select("key", "a", "b", (F.col("cells") * GROWTH).alias("cells"))
        if left.isEmpty():
            return out


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the next document in descending doc_id; after the last, of the first."""
    base = docs.select(docs[doc_id].alias("doc_id"), id_of(docs, doc_id).alias("rid"), text_of(docs, text).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    n = max(1, min(RANGES, base.count() // RANGE))
    shares = [i / n for i in range(1, n)]
    bounds = (base.agg(F.percentile_approx("rid", shares, max(10_000, 20 * n))).first()[0] or []) if shares else []
    bounds = sorted(set(bounds))
    if bounds:
        # Binary search: how many bounds are not above the id.
        known = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 50 else F.from_json(F.lit(str(bounds)), "array<bigint>")
        held = F.lit(len(bounds))
        place = F.aggregate(
            F.sequence(F.lit(0), F.lit(len(bounds).bit_length())),
            F.struct(F.lit(0).alias("lo"), held.alias("hi")),
            lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
                F.when(
                    F.element_at(known, F.floor((s.lo + s.hi) / 2).cast("int") + 1) <= F.col("rid"),
                    F.struct((F.floor((s.lo + s.hi) / 2).cast("int") + 1).alias("lo"), s.hi.alias("hi")),
                ).otherwise(F.struct(s.lo.alias("lo"), F.floor((s.lo + s.hi) / 2).cast("int").alias("hi")))
            ),
            lambda s: s.lo,
        )
    else:
        place = F.lit(0)
    ranged = base.withColumn("range", place)
    heads = stored(ranged.groupBy("range").agg(F.max(F.struct("rid", "h")).alias("top")), "range-heads")
    order = W.partitionBy(F.lit(0)).orderBy("range")  # one row a range
    everything = W.partitionBy(F.lit(0))
    follow = heads.select("range", F.coalesce(F.lag("top").over(order), F.max_by("top", "range").over(everything)).alias("top"))
    follow = stored(follow.select("range", "top.rid", "top.h"), "range-follow")
    # At most RANGES rows of three numbers.
    first = base.select("rid", "h", "text").join(F.broadcast(follow), ["rid", "h"]).groupBy("range").agg(F.min("text").alias("after"))
    first = stored(first, "range-texts")
    within = W.partitionBy("range").orderBy(F.desc("rid"), F.desc("h"))
    led = ranged.withColumn("lead", F.lead("text").over(within)).join(first, "range", "left")
    return led.select("doc_id", "text", F.coalesce("lead", "after").alias("next_text"))


def written(cells: Column, held: Column) -> Column:
    """A sketch as text: cells of a row, then each cell in use with its count, digests and checks in hexadecimal."""
    each = F.transform(F.array_sort(held), lambda x: F.concat_ws(":", F.hex(x.cell), F.hex(x.n), F.hex(x.k), F.hex(x.c)))
    return F.concat_ws("|", cells.cast("string"), F.array_join(each, ","))


def _side(of: str, first: bool, held: str, cells: Column) -> Column:
    return F.struct(F.lit(of).alias("of"), F.lit(first).alias("first"), F.col(held).alias("held"), cells.alias("cells"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    found = with_next(docs, doc_id, text).withColumn("edited", edited).select(
        "doc_id",
        F.monotonically_increasing_id().alias("key"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        # One column: what the three texts share lies close together and compresses.
        F.array(digests(F.col("text")), digests(F.col("edited")), digests(F.col("next_text"))).alias("lists"),
    )
    found = stored(found, "paragraph-digests")

    # Digests of a document go to one partition; all that follows is done there.
    dealt = found.repartition("key").select("*", *[F.col("lists")[i].alias(x) for i, x in enumerate("aeb")])
    sized = dealt.select("key", "a", "e", "b", own_cells(F.col("a")).alias("ca"), own_cells(F.col("e")).alias("ce"), pair_cells(F.col("a"), F.col("e")).alias("cae"), pair_cells(F.col("a"), F.col("b")).alias("cab"))
    sides = [_side("a", True, "a", F.col("ca")), _side("e", True, "e", F.col("ce"))]
    own = sketches(sized.select("key", F.explode(F.array(*sides)).alias("x")).select("key", "x.*"), "key", "of")
    cell = F.struct("cell", F.col("na").alias("n"), F.col("ka").alias("k"), F.col("ca").alias("c"))
    held = own.groupBy("key").agg(*[F.collect_list(F.when(F.col("of") == x, cell)).alias(f"s{x}") for x in "ae"])
    sides = [_side(x, first, y, F.col(f"ca{x}")) for x in "eb" for first, y in ((True, "a"), (False, x))]
    pairs = sketches(sized.select("key", F.explode(F.array(*sides)).alias("x")).select("key", "x.*"), "key", "of")
    state = peeled(subtract(pairs, "key", "of"), "key", "of", named=False)
    ends = state.groupBy("key").agg(*[f(F.when(F.col("of") == x, y)).alias(f"{name}_{x}") for x in "eb" for name, f, y in (("left", F.max, F.col("cell")), ("apart", F.sum, F.when(F.col("cell") < 0, F.col("n"))))])
    none = F.expr("cast(array() as array<struct<cell: int, n: int, k: bigint, c: int>>)")
    near = stored(
        dealt.join(held, "key", "left").join(ends, "key", "left").select(
            "doc_id", "key", "n_chars", "edited_sha256",
            written(own_cells(F.col("a")), F.coalesce("sa", none)).alias("fingerprint"), written(own_cells(F.col("e")), F.coalesce("se", none)).alias("edited_fingerprint"),
            *[F.when(F.coalesce(f"left_{x}", F.lit(-1)) < 0, likeness(F.size("a"), F.size(x), F.coalesce(f"apart_{x}", F.lit(0)))).alias(f"near_{x}") for x in "eb"],
        ),
        "fingerprints",
    )
    # Few pairs are left: those that their first size does not tell apart.
    again = stored(near.where("near_e is null or near_b is null").select("key", "near_e", "near_b").join(found.select("key", "lists"), "key"), "iblt-retries")
    again = again.select("near_e", "near_b", F.explode(F.array(*[F.struct(F.struct("key", F.lit(x).alias("of")).alias("key"), F.col("lists")[0].alias("a"), F.col("lists")[i].alias("b")) for i, x in ((1, "e"), (2, "b"))])).alias("x"))
    again = again.where("(x.key.of = 'e' and near_e is null) or (x.key.of = 'b' and near_b is null)").select("x.*")
    more = compare(again).groupBy("key.key").agg(*[F.max(F.when(F.col("key.of") == x, F.col("near"))).alias(f"again_{x}") for x in "eb"])
    return near.join(more, "key", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.coalesce("near_e", "again_e").alias("near_edited"), F.coalesce("near_b", "again_b").alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
