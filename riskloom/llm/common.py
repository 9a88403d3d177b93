"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import parallelism, scratch_path, ship_package, spark_context

__all__ = ["drop_kept", "fresh", "keep", "kept_so_far", "parallelism", "partitions", "ready", "same", "table", "text_column"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers."""
    ship_package(spark)
    return spark


#: Folders that ``keep`` has written, in order.
_KEPT: list[str] = []


def kept_so_far() -> int:
    return len(_KEPT)


def drop_kept(spark: SparkSession, since: int) -> None:
    """Deletes the tables that ``keep`` wrote after ``since`` of them, but for the last one: that one
    holds what was made of the others.  A session without a SparkContext leaves them."""
    context = spark_context(spark)
    if context is None:
        return
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    for path in _KEPT[since:-1]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _KEPT[since:-1] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor never repeats the work above this point.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Tasks for an explicit exchange: the session's shuffle partitions, one per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), parallelism(spark))


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def same(a: Column, b: Column) -> Column:
    """Null-safe equality (still an equi-join key)."""
    return a.eqNullSafe(b)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))

