"""Model-quality metrics, the evaluation gate and the threshold sweep.

AUC uses Spark ML's evaluator with ``numBins=0``: an exact, distributed
computation (range-partitioned sort of distinct scores, per-partition
prefix counts).  Everything else is one aggregation.
"""

from __future__ import annotations

import math

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AUC_THRESHOLD, DECISION_THRESHOLD


def auc_roc(df: DataFrame, score: str = "score", label: str = "target") -> float:
    """Exact area under the ROC curve (ties get half credit)."""
    data = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y",
                                       metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(data))


def auc_frame(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    auc = auc_roc(df, score, label)
    return df.sparkSession.range(1).select(F.round(F.lit(auc), 4).alias("auc_roc"))


def confusion(df: DataFrame, score: str = "score", label: str = "target",
              threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """tp, fp, tn, fn and precision / recall of the positive (denied) class.  Rows without a score
    (null or NaN) or label are in no count, here and in the sweep."""
    df = scored_rows(df, score, label)
    pred = F.col(score) > F.lit(threshold)
    pos = F.col(label) == 1
    c = df.agg(
        F.count_if(pred & pos).alias("tp"),
        F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & ~pos).alias("tn"),
        F.count_if(~pred & pos).alias("fn"),
    )
    return c.select(
        "tp", "fp", "tn", "fn",
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"),
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("recall"),
    )


def scored_rows(df: DataFrame, score: str, label: str) -> DataFrame:
    """The rows that have both a score and a label."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())


def accuracy(df: DataFrame, score: str = "score", label: str = "target",
             threshold: float = DECISION_THRESHOLD) -> DataFrame:
    df = scored_rows(df, score, label)
    hit = ((F.col(score) > F.lit(threshold)).cast("int") == F.col(label)).cast("double")
    return df.agg(F.round(F.avg(hit), 4).alias("accuracy"))


def gate_status(auc) -> str:
    """'SUCCESS' iff round(auc, 4) >= threshold; NaN or missing fails."""
    if auc is None or (isinstance(auc, float) and math.isnan(auc)):
        return "FAILED"
    return "SUCCESS" if round(auc, 4) >= AUC_THRESHOLD else "FAILED"


def evaluation_gate(metrics: DataFrame, auc_col: str = "auc_roc") -> DataFrame:
    """Add the gate to a metrics row: null or NaN AUC fails."""
    a = F.round(F.col(auc_col), 4)
    ok = F.coalesce(~F.isnan(a) & (a >= F.lit(AUC_THRESHOLD)), F.lit(False))
    return metrics.withColumns({
        "auc_threshold": F.lit(AUC_THRESHOLD),
        "passed": ok,
        "status": F.when(ok, F.lit("SUCCESS")).otherwise(F.lit("FAILED")),
    })


DEFAULT_THRESHOLDS = [round(i * 0.05, 2) for i in range(21)]


def threshold_sweep(df: DataFrame, score: str = "score", label: str = "target",
                    thresholds: list[float] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Confusion counts at many thresholds in one pass, without a cross join.

    Each row gets ``j`` = how many thresholds lie strictly below its score
    (sorted thresholds), so it is predicted positive exactly at thresholds
    ``0 .. j-1``.  A histogram over ``j`` (at most len(thresholds)+1 rows)
    and a suffix sum over it give every threshold's counts.
    """
    df = scored_rows(df, score, label)
    ts = sorted(thresholds)
    s = F.col(score)
    j = sum((s > F.lit(float(t))).cast("int") for t in ts)
    hist = (df.select(j.alias("j"), (F.col(label) == 1).alias("pos"))
              .groupBy("j").agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg")))
    spark = df.sparkSession
    grid = spark.range(len(ts)).select(
        F.col("id").cast("int").alias("i"),
        F.element_at(F.array(*[F.lit(float(t)) for t in ts]), F.col("id").cast("int") + 1).alias("threshold"))
    g = (grid.join(hist, F.col("j") == F.col("i") + 1, "full")
             .withColumn("k", F.coalesce(F.col("j"), F.col("i") + 1))
             .fillna(0, ["n_pos", "n_neg"]))
    # the frame has at most len(thresholds) + 1 rows, so single-partition windows are fine
    everything = Window.partitionBy()
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = (g.withColumn("P", F.sum("n_pos").over(everything))
          .withColumn("N", F.sum("n_neg").over(everything))
          .withColumn("tp", F.sum("n_pos").over(suffix))
          .withColumn("fp", F.sum("n_neg").over(suffix))
          .filter(F.col("i").isNotNull()))
    return g.select(
        "threshold",
        F.col("tp").cast("bigint").alias("tp"),
        F.col("fp").cast("bigint").alias("fp"),
        (F.col("N") - F.col("fp")).cast("bigint").alias("tn"),
        (F.col("P") - F.col("tp")).cast("bigint").alias("fn"),
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"),
        F.round(F.try_divide(F.col("tp"), F.col("P")), 4).alias("recall"),
    )
