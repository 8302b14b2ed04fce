"""Class, method and call-site facts derived from ``part``, once for Spark and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import read

_PACKAGE = "CASE {0} % 7 WHEN 0 THEN 'internal' WHEN 1 THEN 'api/impl' WHEN 2 THEN 'web' ELSE 'core' END"
_SIMPLE = """CASE {0} % 11 WHEN 0 THEN concat('Order', {0}, 'Test') WHEN 1 THEN concat('Test', {0}) WHEN 2 THEN concat('Flow', {0}, 'IT') WHEN 3 THEN concat('$Proxy', {0})
  WHEN 4 THEN concat('Job', {0}, '$$Lambda$1') WHEN 5 THEN concat('Item', {0}, '$Proxy', {0}, 'x') ELSE concat('Item', {0}) END"""
_NAME = f"concat('com/shop/', {_PACKAGE}, '/', {_SIMPLE})"
_CLASS = f"""c, {_NAME.format('c')} AS cls, c % 5 <> 0 AS is_public,
  CASE c % 13 WHEN 0 THEN 'app/target/test-classes/x' WHEN 1 THEN 'lib/src/test/java' ELSE 'app/classes' END AS origin,
  CASE c % 9 WHEN 0 THEN {{0}}('Lorg/springframework/web/bind/annotation/RequestMapping;') WHEN 1 THEN {{0}}('Lx/cache/Cacheable;') WHEN 2 THEN {{0}}('Lorg/testng/annotations/Test;', 'LBean;') ELSE {{0}}('Lx/Other$Named;') END AS annotations"""
_METHOD = f"""k, c, {_NAME.format('c')} AS cls, CASE k % 8 WHEN 0 THEN '<init>' WHEN 1 THEN '<clinit>' WHEN 2 THEN 'main' WHEN 3 THEN 'service' ELSE concat('run', k % 3) END AS name,
  CASE k % 8 WHEN 2 THEN '([Ljava/lang/String;)V' WHEN 3 THEN '(Ljavax/servlet/ServletRequest;Ljavax/servlet/ServletResponse;)V' WHEN 4 THEN '(La/B;I)V' ELSE '()V' END AS {{1}},
  k % 3 <> 0 AS is_public, k % 8 IN (1, 2) AS is_static, k % 17 = 0 AS is_synthetic, k % 19 = 0 AS is_bridge, k % 23 = 0 AS is_abstract, k % 29 = 0 AS is_native,
  CASE k % 12 WHEN 0 THEN {{0}}('Lorg/springframework/scheduling/annotation/Scheduled;') WHEN 5 THEN {{0}}('Lorg/junit/Test;') WHEN 7 THEN {{0}}('Lx/Retryable;', 'Ljavax/ws/rs/GET;') ELSE {{0}}('Lx/Plain;') END AS annotations,
  size_ % 7 AS n_ins, {{0}}(25, CASE WHEN size_ % 2 = 0 THEN 180 ELSE 181 END, 170 + size_ % 9) AS ops, size_ % 4 <> 0 AS is_plain, size_ % 2 + 1 AS invokes, size_ % 3 AS ctor_invokes"""
_SITE = f"""k AS src, CASE k % 9 WHEN 0 THEN 'static' WHEN 1 THEN 'special' WHEN 2 THEN 'lambda' WHEN 3 THEN 'opaque' WHEN 4 THEN 'instanceof' WHEN 5 THEN 'interface' ELSE 'virtual' END AS kind,
  CASE WHEN k % 14 = 6 THEN 'java/lang/Object' WHEN k % 10 = 8 THEN 'java/util/List' ELSE {_NAME.format('(c // 9)')} END AS owner,
  CASE WHEN k % 14 = 6 THEN 'getClass' ELSE concat('run', k % 3) END AS name, CASE WHEN k % 14 = 6 THEN '()Ljava/lang/Class;' ELSE '()V' END AS {{1}}"""
# c: the class of a part, four parts to one; the first class is the supertype of classes without a rule.
FACTS = f"""pk AS (SELECT p_partkey AS k, p_partkey // 4 AS c, p_size AS size_ FROM part),
cf AS (SELECT {_CLASS.format('list_value')} FROM (SELECT DISTINCT c FROM pk)), mf AS (SELECT {_METHOD.format('list_value', '"desc"')} FROM pk), cs AS (SELECT {_SITE.format('', '"desc"')} FROM pk),
ln AS (SELECT {_NAME.format('(c // 3)')} AS parent, cls AS ref FROM cf WHERE c > 0)"""


def _spark(sql: str) -> str:
    return sql.format("array", "desc").replace("//", "div")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey div 4 AS c", "p_size AS size_")


def class_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("c").distinct().selectExpr(*_split(_spark(_CLASS)))


def method_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).selectExpr(*_split(_spark(_METHOD)))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).selectExpr(*_split(_spark(_SITE)))


def type_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, ref): each class below the one at a third of its number."""
    return class_facts(spark, sf_dir).where("c > 0").select(F.expr(_spark(_NAME.format("(c // 3)"))).alias("parent"), F.col("cls").alias("ref"))


def _split(sql: str) -> list[str]:
    """The columns of a select list."""
    out, depth, start = [], 0, 0
    for at, x in enumerate(sql):
        depth += (x == "(") - (x == ")")
        if x == "," and depth == 0:
            out.append(sql[start:at])
            start = at + 1
    return [*out, sql[start:]]
