"""The training flow's data-driven encoding: flags for the categories present,
then every numeric column.

Two forms:

* flags as columns, for columns of few categories, which become columns of the
  plan and so have to be known to the driver (distinct values are found by a
  grouped aggregate).  Callers that know them pass them in and no job runs;
* ``one_hot_sparse`` for any number of categories: a written dictionary numbers
  the distinct values of each column densely, in their order, by range
  partitions and the counts of those before, and is joined back; a row holds
  the numbers of its flags.  The driver gets a count for each partition only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encoders as E
from ..schemas import NULL_DEFAULT_COLUMNS
from ..session import parallelism, scratch_path
from .staging import completed_loans

FLAGGED = ["home_ownership", "purpose"]


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the distinct values of the columns as text, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()


def categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values present in each column, nulls left out, from one pass."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in distinct_values(df, columns).collect():  # they become columns of the plan
        found[r["column"]].append(r["value"])
    return {c: sorted(v, key=lambda x: x.encode()) for c, v in found.items()}


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, number): the distinct values of all columns, numbered from 0 in the order of column
    and value, without a gap."""
    spark = df.sparkSession
    values = distinct_values(df, columns).withColumn("rank", F.element_at(
        F.create_map(*[x for k, c in enumerate(columns) for x in (F.lit(c), F.lit(k))]), F.col("column")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), parallelism(spark))
    path = scratch_path(spark, "dictionary")
    dealt = values.repartitionByRange(n, "rank", "value").sortWithinPartitions("rank", "value")
    dealt.select("column", "value", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("part", F.shiftrightunsigned("place", 33))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select("column", "value", (F.col("place") + F.col("offset")).alias("number"))


def one_hot_sparse(df: DataFrame, columns: list[str], to: str = "flags", values: DataFrame | None = None) -> DataFrame:
    """``df`` with the ascending numbers of the flags that each row sets, instead of the columns; a null
    and a value that the dictionary lacks set none."""
    values = dictionary(df, columns) if values is None else values
    for k, c in enumerate(columns):
        own = values.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("number").alias(f"_n{k}"))
        df = df.join(own, F.col(f"`{c}`").cast("string") == F.col("_value"), "left").drop("_value")
    numbers = F.array_sort(F.array_compact(F.array(*[F.col(f"_n{k}") for k in range(len(columns))])))
    return df.withColumn(to, numbers).drop(*columns, *[f"_n{k}" for k in range(len(columns))])


def one_hot_dynamic(df: DataFrame, columns: list[str], prefixes: list[str] | None = None,
                    values: dict[str, list[str]] | None = None) -> DataFrame:
    """Replace each column by one boolean flag per category (of ``values``, or of those present);
    a null value sets no flag.  Flags are booleans, as in pandas >= 2."""
    values = values or categories(df, columns)
    flags = {f"{prefix}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False))
             for c, prefix in zip(columns, prefixes or columns) for v in values[c]}
    return df.select(*[c for c in df.columns if c not in columns], *[f.alias(n) for n, f in flags.items()])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("loan_status", "target")) -> list[str]:
    """Numeric columns in frame order; booleans are not numeric."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def _encoded(raw: DataFrame) -> DataFrame:
    df = completed_loans(raw).withColumns({
        "target": E.label_target("loan_status"),
        "term": E.term_contains("term"),
        "grade": E.grade_ordinal("grade").cast("double"),
        "sub_grade": E.sub_grade_ordinal("sub_grade").cast("double"),
        "emp_length": E.emp_length_map("emp_length"),
    })
    return df.fillna({k: v for k, v in NULL_DEFAULT_COLUMNS.items() if k in df.columns})


def training_frame(raw: DataFrame, values: dict[str, list[str]] | None = None) -> DataFrame:
    """The training flow's encoding of raw loans, before column selection."""
    return one_hot_dynamic(_encoded(raw), FLAGGED, values=values)


def training_matrix(raw: DataFrame) -> DataFrame:
    """X (every numeric column except label and status) next to the target.  The flags are booleans
    and not numeric, so their categories need not be known: no job runs."""
    df = _encoded(raw).drop(*FLAGGED)
    return df.select(*numeric_columns(df), "target")
