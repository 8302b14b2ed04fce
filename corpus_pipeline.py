"""The corpus pipeline: quality, exact dedup, near-dedup, substring dedup, packing.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and all but the last return them with the columns of ``documents``, further columns of any
name included. Near-dedup takes shingles of five words and a Jaccard similarity of 0.8; balls of fingerprints come before keys of shingles.
Stages are written to the application's folder, which is deleted when the driver ends.

Cases: a null text counts as empty in every stage; empty texts are scored like any other, and those that
pass are copies of one another, so one of them is left at most; rows without doc_id, or that repeat one, go through
each stage as its module says (a null id is the largest; rows that repeat id and text stay or go together); of ties
the smallest doc_id stays; texts are read whole at any length; a document that loses all its words goes;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livescope.llm import exact_dedup, packing, quality, simhash, substring_dedup
from livescope.llm.common import crc_mod, documents, run_dir, ship_package
from livescope.llm.tokens import vocabulary

#: Some stages can't be told in SQL (a trained model, a tokenizer): tests compare each with brute force.
ORACLE_SQL = None


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels, crc_mod(F.col("doc_id"), 3) != 1))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.first_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.first_of_groups(docs)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring_dedup.without_repeats(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.digests(packing.packed(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", _quality),
    ("exact_dedup", _exact),
    ("simhash_near_dedup", _near),
    ("substring_dedup", _substrings),
    ("packing", _pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
