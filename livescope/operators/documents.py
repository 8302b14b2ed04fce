"""Inventory documents, wire exports and the checks of a window's records.

Checks give the name of the reject, or null; the first that fails names it, as in ``coalesce(check1, check2, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import TEST_RUNNERS

OBSERVABLE, DE_INSTRUMENTED, NOT_OBSERVABLE = "OBSERVABLE", "DE_INSTRUMENTED", "NOT_DYNAMICALLY_OBSERVABLE"
# What call edges may say.
RESOLUTIONS, SEMANTICS = ("exact", "cha", "unresolved"), ("blocking", "noop", "no-op")
HISTOGRAM = "loglinear-16-v1"
# Keys that a record may not carry, as its sender would have worked them out.
PERCENTILES, RATES = ("p50", "p90", "p99", "percentiles"), ("rate", "ratio", "percentage", "callsPerSecond")
_METHOD = "struct<idx: int, name: string, desc: string, line: int, access: string, synthetic: boolean, tier2: boolean, tier2Reason: string, observability: string, dynamicallyObservable: boolean, shortCircuitable: boolean, isTest: boolean, annotations: array<string>>"
_CLASS = f"struct<name: string, sourceFile: string, probeCount: int, schemaHash: string, isPublicApi: boolean, isTest: boolean, methods: array<{_METHOD}>, annotations: array<string>>"
INVENTORY = f"buildSha string, artifact string, piece int, classes array<{_CLASS}>, entryPoints array<struct<class: string, method: string, desc: string, kind: string>>, callEdges array<struct<`from`: string, `to`: string, resolution: string, semantics: string>>, libraryTestSccs array<struct<kind: string, members: array<string>>>"


def eligibility(observability: Column, flag: Column) -> Column:
    """The string wins over the flag; neither means not observable."""
    word = F.replace(F.lower(F.trim(observability)), F.lit("_"), F.lit("-"))
    named = F.when(word.isin("observable", "dynamically-observable"), OBSERVABLE).when(word.isin("de-instrumented", "deinstrumented", "stripped"), DE_INSTRUMENTED).otherwise(NOT_OBSERVABLE)
    return F.when(observability.isNotNull(), named).when(flag, OBSERVABLE).otherwise(NOT_OBSERVABLE)


def parse_inventories(bodies: DataFrame) -> DataFrame:
    """bodies(body) as inv, and fault: why a document can't be taken, or null. A bad document is a row, never a failed job."""
    parsed = bodies.withColumn("inv", F.from_json("body", INVENTORY))
    methods = F.flatten(F.transform(F.filter("inv.classes", lambda c: c.methods.isNotNull()), lambda c: c.methods))
    edges = F.col("inv.callEdges")
    bad = lambda key, known, other: F.exists(edges, lambda e: ~F.coalesce(e[key], F.lit(other)).isin(*known))
    fault = (
        F.when(F.col("inv").isNull() | F.col("inv.buildSha").isNull(), "unreadable")
        .when(F.coalesce(F.exists("inv.classes", lambda c: c["name"].isNull() | (c["name"] == "")), F.lit(False)), "class without name")
        .when(F.coalesce(F.exists(methods, lambda m: m.idx.isNull()), F.lit(False)), "method without idx")
        .when(F.coalesce(bad("resolution", RESOLUTIONS, "unresolved"), F.lit(False)), "bad resolution")
        .when(F.coalesce(bad("semantics", SEMANTICS, "blocking"), F.lit(False)), "bad semantics")
    )
    return parsed.withColumn("fault", fault)


def inventory_methods(parsed: DataFrame) -> DataFrame:
    """A row a method of documents without fault, with safe defaults for what is not said."""
    classes = parsed.where("fault is null").select(F.col("inv.buildSha").alias("build"), F.col("inv.artifact").alias("artifact"), F.explode("inv.classes").alias("c"))
    m = classes.select("build", "artifact", F.col("c.name").alias("cls"), F.explode("c.methods").alias("m"))
    no = F.lit(False)
    return m.select(
        "build", "artifact", "cls", "m.idx", F.coalesce("m.name", F.lit("")).alias("name"), F.coalesce("m.desc", F.lit("")).alias("desc"), "m.line",
        F.coalesce("m.synthetic", no).alias("is_synthetic"), F.coalesce("m.tier2", no).alias("is_timed"), F.coalesce("m.isTest", no).alias("is_test"),
        F.coalesce("m.shortCircuitable", F.lit(True)).alias("short_circuitable"), eligibility(F.col("m.observability"), F.col("m.dynamicallyObservable")).alias("eligibility"),
    )


def inventory_edges(parsed: DataFrame) -> DataFrame:
    edges = parsed.where("fault is null").select(F.col("inv.buildSha").alias("build"), F.explode("inv.callEdges").alias("e"))
    return edges.select(
        "build", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.resolution", F.lit("unresolved")).alias("resolution"), F.coalesce("e.semantics", F.lit("blocking")).alias("semantics")
    )


def inventory_classes(parsed: DataFrame) -> DataFrame:
    c = parsed.where("fault is null").select(F.col("inv.buildSha").alias("build"), F.explode("inv.classes").alias("c"))
    return c.select(
        "build", F.col("c.name").alias("cls"), F.col("c.sourceFile").alias("source_file"), F.coalesce("c.probeCount", F.lit(0)).alias("probe_count"), F.col("c.schemaHash").alias("schema_hash"),
        F.coalesce("c.isPublicApi", F.lit(False)).alias("is_public_api"), F.coalesce("c.isTest", F.lit(False)).alias("is_test"),
    )


def inventory_entry_points(parsed: DataFrame) -> DataFrame:
    e = parsed.where("fault is null").select(F.col("inv.buildSha").alias("build"), F.explode("inv.entryPoints").alias("e"))
    return e.select("build", F.col("e.class").alias("cls"), F.col("e.method").alias("name"), F.col("e.desc").alias("desc"), F.coalesce("e.kind", F.lit("unknown")).alias("kind"))


def inventory_components(parsed: DataFrame) -> DataFrame:
    """(build, piece, component, kind, ref): members of library and test components, which are numbered within their document, a piece of the build's."""
    c = parsed.where("fault is null").select(F.col("inv.buildSha").alias("build"), F.coalesce("inv.piece", F.lit(0)).alias("piece"), F.posexplode("inv.libraryTestSccs").alias("component", "c"))
    return c.select("build", "piece", "component", F.col("c.kind").alias("kind"), F.explode("c.members").alias("ref"))


def edge_rate_fault(rate: Column, n_edges: Column) -> Column:
    """A sample rate is a power of two, and edges need one."""
    return F.when(rate.isNotNull() & ((rate <= 0) | (F.bit_count(rate) != 1)), "bad_field").when((n_edges > 0) & rate.isNull(), "missing_field")


def write_inventory(methods: DataFrame) -> DataFrame:
    """methods(build, artifact, cls, idx, name, desc, line, tier2Reason, ...) as one document a build; what is null is left out.

    Methods are nested by class first, so a build's document is made of one row a class.
    """
    keys = ("build", "artifact", "cls")
    fields = F.struct("idx", *[F.col(c) for c in methods.columns if c not in (*keys, "idx")])
    classes = methods.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("methods"))
    nested = classes.groupBy("build", "artifact").agg(F.array_sort(F.collect_list(F.struct(F.col("cls").alias("name"), "methods"))).alias("classes"))
    return nested.select("build", F.to_json(F.struct(F.col("build").alias("buildSha"), "artifact", "classes")).alias("body"))


def to_wire(df: DataFrame, names: dict[str, str], key: str) -> DataFrame:
    """(key, body): rows as JSON with the wire's key names, nulls written."""
    return df.select(key, F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]), {"ignoreNullFields": "false"}).alias("body"))


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of rules, numbered from 1."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_no"), "line")


def read_xml_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(cls, name, desc, covered) of a coverage report: classes with methods with an INSTRUCTION counter."""
    schema = "_name string, method array<struct<_name: string, _desc: string, counter: array<struct<_type: string, _missed: long, _covered: long>>>>"
    classes = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    methods = classes.select(F.col("_name").alias("cls"), F.explode("method").alias("m"))
    return methods.select("cls", F.col("m._name").alias("name"), F.col("m._desc").alias("desc"), F.explode("m.counter").alias("c")).where("c._type = 'INSTRUCTION'").select("cls", "name", "desc", (F.col("c._covered") > 0).alias("covered"))


def evolve(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with columns that later versions have added, and their meaning-preserving defaults where rows are older."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def resolve_errors(by_id: Column, table: Column, legacy: Column) -> Column:
    """struct<named map, unresolved, source>: ids become the names of the same window's table; an id without one is counted, never named."""
    entries = F.transform(F.map_entries(by_id), lambda e: F.struct(F.trim(F.try_element_at(table, e.key)).alias("name"), e.value.alias("n")))
    names = F.array_distinct(F.transform(F.filter(entries, lambda e: e["name"].isNotNull()), lambda e: e["name"]))
    total = lambda keep: F.aggregate(F.filter(entries, keep), F.lit(0).cast("long"), lambda a, e: a + e.n)
    named = F.map_from_arrays(names, F.transform(names, lambda x: total(lambda e: e["name"] == x)))
    none, has, old = F.expr("cast(map() as map<string, bigint>)"), F.size(F.coalesce(by_id, F.create_map())) > 0, F.size(F.coalesce(legacy, F.create_map())) > 0
    taken_old = by_id.isNull() & old
    source = F.when(has, "errors_by_class").when(taken_old, "legacy_names").otherwise("unavailable")
    return F.struct(
        F.when(has, named).when(taken_old, legacy).otherwise(none).alias("named"), F.when(has, total(lambda e: e["name"].isNull())).otherwise(F.lit(0).cast("long")).alias("unresolved"), source.alias("source")
    )


def attribution(errors: Column, named: Column) -> Column:
    """struct<attributed, unattributed>: never reconciled with one another."""
    attributed = F.aggregate(F.map_values(named), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.struct(attributed.alias("attributed"), F.greatest(F.lit(0).cast("long"), errors - attributed).alias("unattributed"))


def test_record(cls: Column, frames: Column, prefixes: Sequence[str] = TEST_RUNNERS) -> Column:
    """Whether a record's class or one of its frames belongs to a test runner; such a record is dropped and counted."""
    hit = lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, p))
    return hit(cls) | F.coalesce(F.exists(frames, hit), F.lit(False))
