"""Confusion counts at every distinct score, and thresholds chosen by them.

Rows are counted by score first, so a hot score is one row.  The scores are
range-partitioned and written; a partition's counts before a score are a window
inside it, and what lies in all partitions above comes from their totals (a row
for each partition).  No task sees all scores and nothing is sampled.

A row is predicted positive (denied) where its score is above the threshold, as
in ``confusion``.  Rows without a score or label are in no count.  The thresholds
are the distinct scores; the last one predicts nothing positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism, scratch_path
from .metrics import scored_rows


def threshold_curve(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall and false positive rate at every distinct score."""
    spark = df.sparkSession
    rows = scored_rows(df, score, label)
    by_score = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), parallelism(spark))
    path = scratch_path(spark, "scores")
    by_score.repartitionByRange(n, "threshold").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counted = spark.read.parquet(path)
    parts = counted.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))  # a row for each partition
    above, everything = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = parts.select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "q")],
                           *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("p", "q")])
    higher = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, -1)

    def over(c: str, offset: str) -> Column:
        return (F.coalesce(F.sum(c).over(higher), F.lit(0)) + F.col(offset)).cast("bigint")

    out = counted.join(F.broadcast(offsets), "part").select(
        "threshold", over("pos", "p_above").alias("tp"), over("neg", "q_above").alias("fp"), "p_all", "q_all")
    return out.select(
        "threshold", "tp", "fp", (F.col("q_all") - F.col("fp")).cast("bigint").alias("tn"),
        (F.col("p_all") - F.col("tp")).cast("bigint").alias("fn"),
        F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide("tp", "p_all"), 6).alias("recall"),
        F.round(F.try_divide("fp", "q_all"), 6).alias("false_positive_rate"))


def _first(curve: DataFrame, rule: str, value: float, *order: Column) -> DataFrame:
    return curve.orderBy(*order).limit(1).select(F.lit(rule).alias("rule"), F.lit(float(value)).alias("value"), "*")


def threshold_for_recall(curve: DataFrame, recall: float) -> DataFrame:
    """The highest threshold at which at least this share of the positives is found (no row if none does)."""
    # the share itself, not the rounded column
    reached = F.col("tp") >= F.lit(recall) * (F.col("tp") + F.col("fn"))
    return _first(curve.filter(reached), "recall", recall, F.desc("threshold"))


def threshold_for_cost(curve: DataFrame, missed: float, refused: float) -> DataFrame:
    """The threshold of the least cost, of ``missed`` for an accepted positive and ``refused`` for a
    refused negative; of equal ones the highest."""
    cost = F.lit(float(missed)) * F.col("fn") + F.lit(float(refused)) * F.col("fp")
    return _first(curve, "cost", missed / refused, cost.asc(), F.desc("threshold"))
