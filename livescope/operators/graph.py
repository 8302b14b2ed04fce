"""Call-graph closures by frontier joins, and what they say about each method."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.livescope.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.livescope.shared.dir", folder)
    return folder.rstrip("/")


@lru_cache(maxsize=8)
def _made(folder: str, application: str) -> str:
    path = f"{folder}/tables-{application}-{uuid.uuid4().hex}"
    spark = SparkSession.active()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the shared one; the file system deletes it when the driver ends."""
    return _made(shared_folder(spark), spark.sparkContext.applicationId)


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, so that a loop's lineage stays short and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with place: the row number in its group by order, without one task for a whole group.

    Rows are dealt into ranges of (group, order) and numbered there; a range starts where the ranges of the group before it end.
    """
    ranged = kept(df.repartitionByRange(*group, *order).withColumn("part_no", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "part_no").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*group).orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    starts = kept(sizes.select(*group, "part_no", before))
    within = F.row_number().over(W.partitionBy(*group, "part_no").orderBy(*order))
    numbered = ranged.withColumn("place", within).join(starts, [*group, "part_no"])
    return numbered.withColumn("place", F.col("place") + F.col("before")).drop("part_no", "before")


#: Hops that one written round of a closure takes.
HOPS = 4


def triage(edges: DataFrame, tests: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """edges(src, dst, resolution, semantics) with category: unresolved, from_test, intra_component, noop or forward, the first that fits.

    components(component, ref) are those of library and test code that call one another: no call within one makes its own component live.
    """
    from_test = tests.select(F.col("ref").alias("src"), F.lit(True).alias("from_test")).distinct()
    marked = edges.join(from_test, "src", "left")
    if components is None:
        marked = marked.withColumn("intra", F.lit(False))
    else:
        own = components.select("component", "ref").distinct()
        pairs = edges.select("src", "dst").distinct().join(own.withColumnRenamed("ref", "src"), "src")
        intra = pairs.join(own.withColumnRenamed("ref", "dst"), ["component", "dst"], "left_semi").select("src", "dst", F.lit(True).alias("intra")).distinct()
        marked = marked.join(intra, ["src", "dst"], "left")
    category = F.when(F.col("resolution") == "unresolved", "unresolved").when(F.col("from_test"), "from_test").when(F.col("intra"), "intra_component")
    category = category.when(F.col("semantics").isin("noop", "no-op"), "noop").otherwise("forward")
    return marked.withColumn("category", category).drop("from_test", "intra")


def initialisers(methods: DataFrame) -> DataFrame:
    """(src, dst): from every method(ref, cls, name) to its class's first initialiser, and from that one to the others; they run before it.

    What a method reaches is the same as over calls to each of them, with one call a method instead of one for every initialiser.
    """
    of = methods.where("name = '<clinit>'").select("cls", F.col("ref").alias("dst"))
    first = of.groupBy("cls").agg(F.min("dst").alias("first"))
    enter = methods.select("cls", F.col("ref").alias("src")).join(first, "cls").select("src", F.col("first").alias("dst"))
    others = of.join(first, "cls").select(F.col("first").alias("src"), "dst")
    return enter.unionByName(others).where("src <> dst")


def reachable(roots: DataFrame, forward: DataFrame) -> DataFrame:
    """ref: everything that roots(ref) reach over forward(src, dst).

    A round takes ``HOPS`` hops from the frontier alone and writes what is new beside the rounds before it, so what is
    reached is written once. The last round is the one that finds nothing.
    """
    spark, folder = roots.sparkSession, f"{scratch(roots.sparkSession)}/{uuid.uuid4().hex}"
    edges = kept(forward.select("src", "dst").where("src <> dst").distinct())
    new, rounds = roots.select("ref").distinct(), []
    while True:
        rounds.append(f"{folder}/round={len(rounds)}")
        new.write.parquet(rounds[-1])
        frontier = spark.read.schema(new.schema).parquet(rounds[-1])
        reached = spark.read.schema(new.schema).parquet(*rounds)
        if frontier.isEmpty():
            return reached
        hop, found = frontier, None
        for _ in range(HOPS):
            hop = edges.join(hop, edges["src"] == hop["ref"], "left_semi").select(F.col("dst").alias("ref")).distinct()
            found = hop if found is None else found.union(hop)
        new = found.distinct().join(reached, "ref", "left_anti")


def inbound_kinds(triaged: DataFrame, reached: DataFrame) -> DataFrame:
    """(ref, only_noop, only_test) of what resolved calls enter and roots don't reach.

    only_test: every resolved call comes from a test or from within the own component. only_noop: of the others, all do nothing.
    """
    own = F.col("category").isin("from_test", "intra_component")
    inbound = triaged.where("category <> 'unresolved'").groupBy(F.col("dst").alias("ref")).agg(
        F.bool_and(own).alias("only_test"), (F.bool_or(F.col("category") == "noop") & ~F.bool_or(F.col("category") == "forward")).alias("only_noop")
    )
    return inbound.join(reached.select("ref"), "ref", "left_anti").select("ref", "only_noop", "only_test")


def static_reachable(methods: DataFrame, triaged: DataFrame, reached: DataFrame) -> DataFrame:
    """methods(ref, name) with static_reachable: true, false, or null where nothing can be said.

    True: initialisers, and what roots reach. Null: what the graph doesn't hold, and what any call enters that can't be
    resolved, does nothing, comes from tests or the own component, or from callers that are not reached themselves.
    False is left to methods of the graph that nothing calls.
    """
    calls = triaged.select(F.col("dst").alias("ref"), F.lit(True).alias("called")).union(triaged.select(F.col("src").alias("ref"), F.lit(False).alias("called")))
    nodes = calls.groupBy("ref").agg(F.bool_or("called").alias("called"))
    hit = reached.select("ref").distinct().withColumn("reached", F.lit(True))
    joined = methods.join(hit, "ref", "left").join(nodes, "ref", "left")
    state = F.when((F.col("name") == "<clinit>") | F.col("reached"), True).when(F.col("called").eqNullSafe(F.lit(False)), False)
    return joined.withColumn("static_reachable", state.cast("boolean")).drop("reached", "called")


def descendants(links: DataFrame) -> DataFrame:
    """(ancestor, ref): the closure of links(parent, ref), oneself left out, cycles allowed. Rounds are written beside one another."""
    spark, folder = links.sparkSession, f"{scratch(links.sparkSession)}/{uuid.uuid4().hex}"
    links = kept(links.select("parent", "ref").where("parent <> ref").distinct())
    new, rounds = links.select(F.col("parent").alias("ancestor"), "ref"), []
    while True:
        rounds.append(f"{folder}/round={len(rounds)}")
        new.write.parquet(rounds[-1])
        frontier = spark.read.schema(new.schema).parquet(rounds[-1])
        found = spark.read.schema(new.schema).parquet(*rounds)
        if frontier.isEmpty():
            return found
        step = frontier.join(links.withColumnRenamed("ref", "next"), F.col("ref") == F.col("parent")).select("ancestor", F.col("next").alias("ref")).where("ancestor <> ref").distinct()
        new = step.join(found, ["ancestor", "ref"], "left_anti")
