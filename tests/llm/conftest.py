import pytest
from pyspark.sql import SparkSession

from livescope.llm.common import ship_package


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """Small, with every awkward case: nulls, blanks, ties, repeated rows, a clashing column."""
    a = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{i}" for i in range(300))
    rows = [
        (5, a, "x"), (3, a.replace(" ", "\n\t"), "y"), (9, a + " eleven", None), (1, None, "z"), (2, "", "z"), (4, " \t ", None),
        (7, long, "q"), (8, "intro words " + long + " tail", "q"), (8, "intro words " + long + " tail", "q"), (6, "É" * 30, "q"),
        (None, long, "n"), (10, "the " * 200, "r"), (11, "the " * 180, "r"), (12, "ab" * 400, "r"), (13, "ab" * 300 + "c", "r"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
