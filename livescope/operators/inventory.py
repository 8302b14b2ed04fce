"""A build's classes and methods: probe numbers, schema hashes, scopes and suppressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assign_probe_index(methods: DataFrame) -> DataFrame:
    """idx: the place of a method among its class's, by name and descriptor, from 0."""
    return methods.withColumn("idx", F.row_number().over(W.partitionBy("cls").orderBy("name", "desc")) - 1)


def schema_hash(methods: DataFrame) -> DataFrame:
    """SHA-256 of a class's methods in the order of the pair (name, desc), each on a line."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "desc")))
    lines = F.array_join(F.transform(pairs, lambda x: F.concat(x["name"], x["desc"], F.lit("\n"))), "")
    return methods.groupBy("cls").agg(F.sha2(lines.cast("binary"), 256).alias("schema_hash"), F.count("*").alias("probe_count"))


def public_api(cls: Column, is_public: Column) -> Column:
    """Public, and no package segment that says internal."""
    package = F.slice(F.split(F.lower(cls), r"\."), 1, F.size(F.split(cls, r"\.")) - 1)
    return is_public & ~F.arrays_overlap(package, F.array(F.lit("internal"), F.lit("impl")))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; a bracket that is never closed is itself."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def parse_rule(line: str) -> tuple[str, str, str, str] | None:
    """class, method and descriptor globs and the comment of ``class#method(desc)  # comment``; None for a blank line."""
    found = re.search(r"(?:^|\s)#", line)
    rule, comment = (line[: found.start()], line[found.end() :].strip()) if found else (line, "")
    rule = rule.strip()
    if not rule:
        return None
    cls, _, rest = rule.partition("#")
    name, paren, desc = rest.partition("(")
    return cls or "*", name or "*", "(" + desc if paren else "*", comment


def match_rules(methods: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """methods with rule_no, the first rule (class, method, descriptor) that matches, or null."""
    first = None
    for number, (cls, name, desc) in enumerate(rules):
        hit = F.col("cls").rlike(glob_regex(cls)) & F.col("name").rlike(glob_regex(name)) & F.col("desc").rlike(glob_regex(desc))
        first = F.when(hit, number) if first is None else first.when(hit, number)
    return methods.withColumn("rule_no", first if first is not None else F.lit(None).cast("int"))


def roots(entry_points: DataFrame, methods: DataFrame) -> DataFrame:
    """(ref, kept): entry points; those of test kind or in test code are dropped, not kept."""
    tests = methods.where("is_test").select(F.col("p_partkey").alias("ref"), F.lit(True).alias("in_test"))
    each = entry_points.groupBy("ref").agg(F.bool_or(F.col("kind") != "test").alias("production"))
    return each.join(tests, "ref", "left").select("ref", (F.col("production") & F.col("in_test").isNull()).alias("kept"))
