"""Exact stratified train/test split on a seeded integer key.

Per class, rows are ordered by ``(key, id)`` where ``key`` is a
multiplicative hash of the id modulo a prime; the first
``floor(test_fraction * n_class)`` rows form the test fold.  The result
does not depend on how the input is partitioned.

Scale: a window over the class alone would put every row of a class in one
task.  Instead rows are counted per (class, key), at most modulus rows for a
class whatever the input, the key holding each class's cut is found on that
small table, and only the rows sharing that one key are ranked to find the
id of the cut.  One pass then compares every row's (key, id) with its class's
cut, one row per class, which is written first: Spark knows how few they are
before it plans the join and broadcasts them where they are under its size
threshold.  Else it would deal the rows themselves by their class, all rows of
a class to one task.

Rows without an id cannot be told apart, so they do not count towards the
fraction and are training rows; rows that share an id are always in the same
fold.  Rows without a class form a class of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

MODULUS = 1_000_003
MULTIPLIER = 2_654_435_761


def split_key(id_col: str = "loan_id", modulus: int = MODULUS, multiplier: int = MULTIPLIER) -> Column:
    """``(id * multiplier) mod modulus`` computed without 64-bit overflow."""
    return F.pmod(F.pmod(F.col(id_col), F.lit(modulus)) * F.lit(multiplier % modulus), F.lit(modulus))


def split_cuts(df: DataFrame, label: str, id_col: str, test_fraction: float, modulus: int) -> DataFrame:
    """One row per class with a test fold: (_label, _cut_key, _cut_id), the last test row's key and id."""
    keys = df.select(F.col(label).alias("_label"), F.col(id_col).alias("_id"),
                     split_key(id_col, modulus).alias("_key")).filter(F.col("_id").isNotNull())
    per_key = keys.groupBy("_label", "_key").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy("_label").orderBy("_key")
    n_test = F.floor(F.sum("_n").over(Window.partitionBy("_label")) * F.lit(test_fraction))
    before = F.coalesce(F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (per_key.withColumns({"_before": before, "_n_test": n_test.cast("bigint")})
           .filter((F.col("_before") < F.col("_n_test")) & (F.col("_before") + F.col("_n") >= F.col("_n_test")))
           .select(F.col("_label").alias("_of"), F.col("_key").alias("_cut_key"),
                   (F.col("_n_test") - F.col("_before")).alias("_need")))
    at = keys.join(cut, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_cut_key")))
    place = F.row_number().over(Window.partitionBy("_label", "_key").orderBy("_id"))
    return at.withColumn("_place", place).filter("_place = _need").select(
        "_label", "_cut_key", F.col("_id").alias("_cut_id"))


def stratified_split(df: DataFrame, label: str = "target", id_col: str = "loan_id",
                     test_fraction: float = 0.2, modulus: int = MODULUS) -> DataFrame:
    """Add ``fold`` ('train' / 'test') to every row of ``df``."""
    path = scratch_path(df.sparkSession, "cuts")
    split_cuts(df, label, id_col, test_fraction, modulus).write.parquet(path)
    cuts = df.sparkSession.read.parquet(path)
    joined = df.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left")
    key = split_key(id_col, modulus)
    test = (key < F.col("_cut_key")) | ((key == F.col("_cut_key")) & (F.col(id_col) <= F.col("_cut_id")))
    return joined.withColumn("fold", F.when(test, F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, "fold")


def dataset_sizes(split: DataFrame, n_features: int) -> DataFrame:
    return split.agg(
        F.count_if(F.col("fold") == "train").alias("train_size"),
        F.count_if(F.col("fold") == "test").alias("test_size"),
    ).withColumn("n_features", F.lit(n_features))
