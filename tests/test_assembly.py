"""A small build from facts to its document and back."""

import pytest
from pyspark.sql import functions as F

from livescope.operators import assembly, documents

CLASS = "cls string, annotations array<string>, origin string, is_public boolean"
METHOD = (
    "k long, cls string, name string, desc string, is_public boolean, is_static boolean, is_synthetic boolean, is_bridge boolean, is_abstract boolean, is_native boolean, annotations array<string>, n_ins int, ops array<int>, is_plain boolean,"
    " invokes int, ctor_invokes int"
)


def _facts(spark):
    classes = [("a/Main", [], "app/classes", True), ("a/Lib", [], "app/classes", True), ("a/LibTest", [], "app/classes", True), ("a/internal/X", [], "app/classes", True)]
    method = lambda k, cls, name, desc, static=False, synthetic=False: (k, cls, name, desc, True, static, synthetic, False, False, False, [], 9, [1, 2, 3], False, 2, 0)
    methods = [
        method(1, "a/Main", "main", "([Ljava/lang/String;)V", static=True), method(2, "a/Lib", "go", "()V"), method(3, "a/Lib", "back", "()V"), method(4, "a/LibTest", "t", "()V"), method(5, "a/internal/X", "x", "()V"),
        method(6, "a/Lib", "lambda$0", "()V", synthetic=True), method(7, "a/Lib", "<clinit>", "()V", static=True),
    ]
    sites = [(1, "static", "a/Lib", "go", "()V"), (3, "static", "a/LibTest", "t", "()V"), (4, "static", "a/Lib", "back", "()V"), (2, "opaque", "a/Gone", "z", "()V"), (5, "instanceof", "a/Lib", "go", "()V")]
    return {
        "classes": spark.createDataFrame(classes, CLASS), "methods": spark.createDataFrame(methods, METHOD), "sites": spark.createDataFrame(sites, "src long, kind string, owner string, name string, desc string"),
        "links": spark.createDataFrame([("a/Lib", "a/LibTest")], "parent string, ref string"), "services": spark.createDataFrame([("a/internal/X",)], "cls string"),
        "specs": spark.createDataFrame([(0, "a/Lib#t()V")], "place int, spec string"),
    }


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_assembled_written_and_read_again(spark):
    found = assembly.assemble(**_facts(spark), timing=assembly.Timing(["a.Lib#*"], []))
    assert _rows(found.methods, "ref", "idx") == [(1, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert _rows(found.components.drop("component"), "cls", "name") == [("a/Lib", "back"), ("a/LibTest", "t")]
    assert {r.ref for r in found.methods.where("timed").collect()} == {2, 3}
    assert _rows(found.classes, "cls", "is_public_api", "is_test", "probe_count") == [("a/Lib", True, False, 2), ("a/LibTest", True, True, 1), ("a/Main", True, False, 1), ("a/internal/X", False, False, 1)]
    read = documents.parse_inventories(assembly.documents(found, "b", "app"))
    assert read.first().fault is None
    assert _rows(documents.inventory_classes(read), "cls", "is_public_api", "is_test", "probe_count", "schema_hash") == _rows(found.classes, "cls", "is_public_api", "is_test", "probe_count", "schema_hash")
    methods = documents.inventory_methods(read).withColumn("observable", F.col("eligibility") == "OBSERVABLE")
    columns = ("cls", "name", "desc", "idx", "observable", "short_circuitable", "is_test")
    assert _rows(methods, *columns) == _rows(found.methods, *columns)
    assert _rows(documents.inventory_entry_points(read), "cls", "name", "desc", "kind") == _rows(found.entry_points, "cls", "name", "desc", "kind")
    assert {r.kind for r in found.entry_points.collect()} == {"main", "ServiceLoader", "a/Lib#t()V"}
    ends = [F.concat(f"{s}_cls", F.lit("#"), f"{s}_name", f"{s}_desc") for s in ("src", "dst")]
    assert _rows(documents.inventory_edges(read), "src", "dst", "resolution", "semantics") == _rows(found.edges, *ends, "resolution", "semantics")
    assert _rows(documents.inventory_components(read), "component", "kind", "ref") == [(0, "library-test", "a/Lib#back()V"), (0, "library-test", "a/LibTest#t()V")]


def test_documents_of_a_build_do_not_grow_with_it(spark):
    found = assembly.assemble(**_facts(spark), timing=assembly.Timing(["a.Lib#*"], []))
    one, many = (documents.parse_inventories(assembly.documents(found, "b", "app", rows)) for rows in (1000, 2))
    assert one.count() == 1 and many.count() > 2 and many.where("fault is not null").count() == 0
    for table in (documents.inventory_classes, documents.inventory_methods, documents.inventory_entry_points, documents.inventory_edges):
        assert _rows(table(many), *table(one).columns) == _rows(table(one), *table(one).columns)
    assert _rows(documents.inventory_components(many), "kind", "ref") == _rows(documents.inventory_components(one), "kind", "ref")


def test_no_class_and_too_many_timed_methods_are_errors(spark):
    parts = _facts(spark)
    with pytest.raises(ValueError, match="no class"):
        assembly.assemble(**(parts | {"classes": parts["classes"].where("false")}), timing=assembly.Timing([], []))
    with pytest.raises(ValueError, match="over the budget of 1 .*include:a.Lib#\\* 2"):
        assembly.assemble(**parts, timing=assembly.Timing(["a.Lib#*"], [], most=1))
