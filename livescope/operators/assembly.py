"""A build's whole inventory from class, method and call-site facts, and its documents with all five tables.

Stages always run in this order: probeable methods and their numbers, schema hashes, what can be observed, test code, entry points,
subtypes, call edges, components of library and test code, timing. A build without any class is an error, and so is
a timing selection over its budget.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, inventory, static


class Inventory(NamedTuple):
    classes: DataFrame  # cls, is_public_api, is_test, schema_hash, probe_count
    methods: DataFrame  # ref, cls, name, desc, idx, observable, short_circuitable, is_test, timed
    entry_points: DataFrame  # cls, name, desc, kind
    edges: DataFrame  # src_cls, src_name, src_desc, dst_cls, dst_name, dst_desc, resolution, semantics
    components: DataFrame  # component, cls, name, desc


class Timing(NamedTuple):
    includes: list[str]
    excludes: list[str]
    most: int = 250


def assemble(classes: DataFrame, methods: DataFrame, sites: DataFrame, links: DataFrame, services: DataFrame, specs: DataFrame, timing: Timing) -> Inventory:
    """Of classes(cls, annotations, origin, is_public), methods(k, cls, name, desc, ...), sites(src, ...), links(parent, ref), services(cls) and specs(place, spec)."""
    if classes.isEmpty():
        raise ValueError("no class to make an inventory of")
    probes = inventory.assign_probe_index(static.probeable(methods))
    hashes = inventory.schema_hash(probes)
    tests = graph.kept(static.test_classes(classes, methods).select("cls", "is_test"))
    marked = methods.join(tests, "cls")
    entries = static.entry_points_annotated(classes, methods)
    below = graph.kept(graph.descendants(links))
    points = entries.select("cls", "name", "desc", "kind").unionByName(static.entry_points_main(methods)).unionByName(static.entry_points_services(services))
    points = points.unionByName(static.entry_points_boundary(below, methods, specs)).distinct()

    resolved = graph.kept(static.resolve_edges(sites, classes, methods, below))
    named = methods.select("k", "cls", "name", "desc")
    of = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("cls", "name", "desc")]
    edges = resolved.join(named.select(F.col("k").alias("src"), *of("src")), "src")
    inside = edges.where("semantics = 'blocking' AND resolution <> 'unresolved'").join(named.select(F.col("k").alias("dst"), *of("dst")), ["dst_cls", "dst_name", "dst_desc"]).select("src", "dst").distinct()
    refs = marked.select(F.col("k").alias("ref"), "is_test", "cls", "name", "desc")
    members = graph.kept(static.components(refs.select("ref"), inside))
    mixed = members.join(refs, "ref").groupBy("component").agg(F.bool_or("is_test").alias("t"), F.bool_and("is_test").alias("all_t")).where("t AND NOT all_t").select("component")
    components = members.join(mixed, "component").join(refs, "ref").select("component", "cls", "name", "desc")

    chosen = static.select_timed(marked, entries, timing.includes, timing.excludes)
    within, largest = static.budget(chosen, timing.most)
    if not within:
        raise ValueError(f"over the budget of {timing.most} timed methods: " + ", ".join(f"{r.reason} {r.methods}" for r in largest.collect()))  # five rows
    of_class = classes.select("cls", F.col("annotations").alias("of_class"))
    said = probes.join(tests, "cls").join(of_class, "cls").join(chosen.select("k", F.lit(True).alias("timed")), "k", "left").select(
        F.col("k").alias("ref"), "cls", "name", "desc", "idx", static.observable().alias("observable"), static.short_circuitable(F.col("annotations"), F.col("of_class")).alias("short_circuitable"),
        "is_test", F.coalesce("timed", F.lit(False)).alias("timed"),
    )
    about = classes.select("cls", static.public_api(F.col("is_public"), F.col("cls")).alias("is_public_api")).join(tests, "cls").join(hashes, "cls", "left").withColumn("probe_count", F.coalesce("probe_count", F.lit(0).cast("long")))
    return Inventory(about, said, points, edges.select(*[f"{s}_{c}" for s in ("src", "dst") for c in ("cls", "name", "desc")], "resolution", "semantics"), components)


def _ref(side: str = "") -> Column:
    return F.concat(f"{side}cls", F.lit("#"), f"{side}name", f"{side}desc")


#: Rows of a document, about: classes, entry points, edges and components.
ROWS = 20_000


def documents(found: Inventory, build: str, artifact: str, rows: int = ROWS) -> DataFrame:
    """(build, body): the inventory as documents of some ``rows`` rows each, so that no document grows with its build.

    Each is whole by itself and holds all of its classes; the tables of a build are those of all its documents. Classes nest their methods first.
    """
    method = F.struct("idx", "name", "desc", F.col("observable").alias("dynamicallyObservable"), F.col("short_circuitable").alias("shortCircuitable"), F.col("is_test").alias("isTest"), F.col("timed").alias("tier2"))
    of_class = found.methods.groupBy("cls").agg(F.array_sort(F.collect_list(method)).alias("methods"))
    classes = found.classes.join(of_class, "cls", "left").select(F.xxhash64("cls").alias("key"), F.struct(
        F.col("cls").alias("name"), F.col("probe_count").alias("probeCount"), F.col("schema_hash").alias("schemaHash"), F.col("is_public_api").alias("isPublicApi"), F.col("is_test").alias("isTest"),
        F.coalesce("methods", F.array().cast(of_class.schema["methods"].dataType)).alias("methods"),
    ).alias("classes"))
    points = found.entry_points.select(F.xxhash64("cls", "name").alias("key"), F.struct(F.col("cls").alias("class"), F.col("name").alias("method"), "desc", "kind").alias("entryPoints"))
    edges = found.edges.select(F.xxhash64("src_cls", "src_name").alias("key"), F.struct(_ref("src_").alias("from"), _ref("dst_").alias("to"), "resolution", "semantics").alias("callEdges"))
    groups = found.components.groupBy("component").agg(F.array_sort(F.collect_list(_ref())).alias("members"))
    groups = groups.select(F.xxhash64("component").alias("key"), F.struct(F.lit("library-test").alias("kind"), "members").alias("libraryTestSccs"))
    items = classes
    for table in (points, edges, groups):
        items = items.unionByName(table, allowMissingColumns=True)
    items = graph.kept(items)
    pieces = 1 + items.count() // rows
    dealt = items.withColumn("piece", F.pmod("key", F.lit(pieces)).cast("int")).repartition(pieces, "piece")
    tables = ("classes", "entryPoints", "callEdges", "libraryTestSccs")
    whole = dealt.groupBy("piece").agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in tables])  # what a row is not is null and left out
    return whole.select(F.lit(build).alias("build"), F.to_json(F.struct(F.lit(build).alias("buildSha"), F.lit(artifact).alias("artifact"), "piece", *tables)).alias("body"))
