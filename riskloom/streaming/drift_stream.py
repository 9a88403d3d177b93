"""Counts for drift, by event-time windows of a stream of loans.

Every loan has an event time and an id.  Within the watermark a loan that
arrives again is dropped; a loan later than the watermark is dropped too, as are
loans without a time.  Each window's (feature, bin) counts are written once, when
the watermark has passed the window's end, so the sink only grows (append).  State: the
ids of the watermark's span, and windows x features x bins counts.

``psi_by_window`` compares each written window with given shares of a base period,
the trigger for retraining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.drift import FLOOR_SHARE, binned_features


def window_counts(loans: DataFrame, features: list[str], time: str, key: str, window: str, delay: str) -> DataFrame:
    """(window_start, feature, bin, n) of a stream or a table of loans."""
    timed = loans.withColumn("at", F.col(time).cast("timestamp")).filter(F.col("at").isNotNull())
    timed = timed.withWatermark("at", delay)
    once = timed.dropDuplicatesWithinWatermark([key]) if loans.isStreaming else timed.dropDuplicates([key])
    binned = binned_features(once, ["at"], features)
    counts = binned.groupBy(F.window("at", window), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "feature", "bin", "n")


def start_drift_stream(spark: SparkSession, schema: StructType, source_dir: str, sink_dir: str, checkpoint_dir: str,
                       features: list[str], time: str = "issue_d", key: str = "loan_id", window: str = "28 days",
                       delay: str = "14 days", available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = window_counts(reader.load(source_dir), features, time, key, window, delay)
    writer = (counts.writeStream.format("parquet").outputMode("append").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def psi_by_window(counts: DataFrame, base: DataFrame) -> DataFrame:
    """(window_start, feature, psi) of written windows against ``base`` (feature, bin, n).

    Bins that only one side has count there as the least share.
    """
    grid = counts.select("window_start", "feature").distinct().join(
        base.select("feature", "bin", F.col("n").alias("n_base")), "feature")  # bins are few and fixed
    both = grid.join(counts, ["window_start", "feature", "bin"], "full").fillna(0, ["n", "n_base"])
    sums = both.groupBy("window_start", "feature").agg(F.collect_list(F.struct("bin", "n", "n_base")).alias("bins"),
                                                       F.sum("n").alias("all"), F.sum("n_base").alias("all_base"))
    def part(x):
        q, p = (F.greatest(F.coalesce(F.try_divide(x[c], F.col(a)), F.lit(0.0)), F.lit(FLOOR_SHARE))
                for c, a in (("n", "all"), ("n_base", "all_base")))
        return (q - p) * F.log(q / p)
    parts = F.transform(F.array_sort("bins"), part)
    return sums.select("window_start", "feature", F.round(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), 6).alias("psi"))
