"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text, its white-space runs made one space, is cut where its content says so:
equal texts have equal cuts. Each chunk is replaced by an identifier that is
verified to stand for one content, and documents are compared by their recipes,
the ordered lists of identifiers. Chunk contents are shuffled once, duplicates
removed before the shuffle; documents themselves never move.

Cases: null text counts as empty; all empty texts are one group; a text of any length is a list
of chunks; a table without rows gives none. Rows that
repeat a ``doc_id`` with the same text are one document and are kept alike.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LAST_ID, SPACES, all_columns, column_of_row, documents, id_of, set_apart, stored, stored_alone, text_of

#: A chunk ends after these three character classes, at least 96 characters on;
#: without such a place within 1024 characters it ends there.
CHUNK = r"(?s).{96,1024}?[adhimoqtz0-4][ceglnrsuy5-9][ ,.;:!?]|.{1,1024}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def chunks_of(text: Column) -> Column:
    """The content-defined chunks of a text, in order; joined they give it back."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per row of docs."""
    base = docs.select(docs[doc_id].alias("doc_id"), normalised(text_of(docs, text)).alias("norm"))
    cut = base.select("doc_id", "norm", chunks_of(F.col("norm")).alias("chunks"))

    # Verified identifiers: a hash that has one content only names it; contents that share
    # a hash are numbered.
    contents = cut.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = stored(contents.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "chunk-clashes")

    whole = cut.select(
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform("chunks", lambda c: F.struct(chunk_hash(c).alias("h"), F.lit(0).alias("no"))).alias("recipe"),
    )
    if not shared.isEmpty():
        numbered = stored(
            contents.join(shared, "h", "left_semi").withColumn("no", F.row_number().over(W.partitionBy("h").orderBy("chunk"))),
            "chunk-numbers",
        )
        placed = cut.withColumn("row", F.monotonically_increasing_id()).select(
            "doc_id", "row", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode_outer("chunks").alias("at", "chunk")
        ).withColumn("h", chunk_hash(F.col("chunk")))
        whole = (
            placed.join(numbered, ["h", "chunk"], "left")
            .groupBy("row")
            .agg(
                F.first("doc_id").alias("doc_id"),
                F.first("text_sha256").alias("text_sha256"),
                F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "h", F.coalesce("no", F.lit(0)).alias("no"))))).alias("list"),
            )
            .select("doc_id", "text_sha256", F.transform("list", lambda x: F.struct(x.h.alias("h"), x.no.alias("no"))).alias("recipe"))
        )
    recipes = stored(whole, "recipes")

    # Groups are counted before the shuffle, so a group that holds a third of all rows is a
    # few rows here; in the join it is an ordinary skewed key of a sort-merge join.
    groups = stored(
        recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
        "recipe-groups",
    )
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs whose document is the first of its equals."""
    gone = stored_alone(lambda: exact_dedup(docs).where("not kept").select("doc_id", "text_sha256").distinct(), "later-copies")
    rid = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID))
    asked, others = set_apart(docs.select(all_columns(docs)), rid, gone.select(id_of(gone).alias("key")))
    sha = F.sha2(normalised(F.coalesce(F.col("row.text"), F.lit(""))).cast("binary"), 256)
    left = asked.join(gone, F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (sha == gone["text_sha256"]), "left_anti").union(others)
    return left.select(*[column_of_row(c).alias(c) for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
