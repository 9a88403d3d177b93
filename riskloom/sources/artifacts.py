"""Run metrics as JSON (models: operators/model.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metrics_frame(spark: SparkSession, metrics: dict, run_ts: str) -> DataFrame:
    """One-row DataFrame of a run's metrics."""
    row = {k: (float(v) if isinstance(v, float) else v) for k, v in metrics.items()}
    return spark.createDataFrame([row]).withColumn("run_ts", F.lit(run_ts))


def write_metrics(spark: SparkSession, metrics: dict, metrics_dir: str, run_ts: str) -> None:
    """Append one JSON record per run, partitioned by run timestamp."""
    metrics_frame(spark, metrics, run_ts).coalesce(1).write.mode("append").partitionBy(
        "run_ts").json(metrics_dir)


def read_metrics(spark: SparkSession, metrics_dir: str) -> DataFrame:
    return spark.read.json(metrics_dir)
