"""What the operators share: where intermediate tables go, and how rows are named.

Rows are known by ``doc_id``; a null ``doc_id`` counts as the largest one, and a
null text as the empty text. Rows that repeat both are the same document.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it; the same class as ``bytes.split()``.
SPACES = r"[\x20\x09-\x0D]+"
LAST_ID = (1 << 63) - 1
#: The tables that ``stored_alone`` deletes in the end.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in where it is unset, which only suits local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.livescope.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.livescope.shared.dir", found)
    return found.rstrip("/")


@lru_cache(maxsize=8)
def _made(folder: str, application: str) -> str:
    """A folder of this application's own, which the file system deletes when the driver ends."""
    path = f"{folder}/llm-{application}-{uuid.uuid4().hex}"
    spark = SparkSession.active()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def run_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    return _made(shared_dir(spark), spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives later joins a side
    whose size is known, so that Spark broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``make()``, stored; tables that it stored on the way are deleted once these are written.

    Only for what depends on no such table any more: later plans read the stored rows.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        rows = make()
    finally:
        _MADE.reset(token)
    rows, spark = stored(rows, name), rows.sparkSession
    for path in made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return rows


#: Bits of a bitmap's row, and of all its rows at most (8 MB).
ROW_BITS, MOST_BITS = 1 << 15, 1 << 26


def set_apart(rows: DataFrame, key: Column, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in found(key), and rows whose key is not: long rows of the second kind need no shuffle.

    The keys' hashes are bits of a bitmap of 8 MB at most, whatever the input; where it gets full, more rows are of the first kind.
    """
    bits = min(MOST_BITS, 1 << max(10, (16 * found.count() - 1).bit_length()))
    slot = lambda column: F.pmod(F.xxhash64(column), F.lit(bits))
    marks = found.select(slot(F.col("key")).alias("slot")).groupBy(F.floor(F.col("slot") / ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % ROW_BITS).alias("marks"))
    marks = F.broadcast(stored(marks, "marks"))
    place = slot(key)
    byte = F.conv(F.hex(F.substring("marks", F.floor(place % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    same = (F.col("part") == F.floor(place / ROW_BITS)) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return rows.join(marks, same, "left_semi"), rows.join(marks, same, "left_anti")


#: Python workers live from stage to stage: what one has freed goes back to the system, so that the next finds room.
_WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and have them return freed memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for name, value in _WORKERS.items():
        env.setdefault(name, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text], F.lit(""))


def id_of(df: DataFrame, doc_id: str = "doc_id") -> Column:
    return F.coalesce(df[doc_id].cast("long"), F.lit(LAST_ID))


def all_columns(df: DataFrame) -> Column:
    """Every column of df, whatever it is called, as one struct named row: joins beside it can't clash."""
    return F.struct(*[F.col(_quoted(c)).alias(c) for c in df.columns]).alias("row")


def column_of_row(name: str) -> Column:
    return F.col(f"row.{_quoted(name)}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: how the contracts hold rows out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
