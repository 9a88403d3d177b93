"""Score applications as they arrive: Structured Streaming over a folder.

The stream reuses the batch scoring plan unchanged (every step is
row-local and stateless, so no watermark or state store is involved).
Progress and output are exactly-once through the checkpoint folder; with
``availableNow`` the query drains what is there and stops.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import score_applications
from ..schemas import APPLICATION_SCHEMA


def start_scoring_stream(spark: SparkSession, model: PipelineModel, source_dir: str,
                         sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                         available_now: bool = True, completion_fn=None,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(APPLICATION_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    apps = reader.load(source_dir)
    out = score_applications(spark, model, apps, completion_fn)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()
