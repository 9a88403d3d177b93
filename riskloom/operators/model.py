"""Training and batch scoring with Spark ML boosted trees.

Training frame: completed loans encoded with the training-flow variants
into the canonical 36 features.  Pipeline: median ``Imputer`` (fitted on
the train fold only) -> ``VectorAssembler`` -> ``GBTClassifier``.
"""

from __future__ import annotations

import math
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..schemas import FEATURE_ORDER, HOME_VALUES, NULL_DEFAULT_COLUMNS, PURPOSE_VALUES
from ..session import parallelism, scratch_path
from .staging import completed_loans

PUBLISHED_SCHEMA = "run_ts string, path string, published_ns long"
#: Rows of the train fold that a task of a pass takes, at most.
ROWS_PER_TASK = 1_000_000
IMPUTED_SUFFIX = "__imp"
# features that can be null after encoding; the rest never are
NULLABLE_FEATURES = [
    "loan_amnt", "int_rate", "installment", "annual_inc", "dti", "fico_range_low",
    "fico_range_high", "open_acc", "revol_bal", "total_acc",
]


def imputed_name(c: str) -> str:
    return c + IMPUTED_SUFFIX if c in NULLABLE_FEATURES else c


MODEL_INPUTS = [imputed_name(c) for c in FEATURE_ORDER]


def training_features(raw: DataFrame) -> DataFrame:
    """loan_id, the 36 features (doubles, canonical order) and target."""
    df = completed_loans(raw)
    enc = {
        "term": E.term_contains("term"),
        "grade": E.grade_ordinal("grade"),
        "sub_grade": E.sub_grade_ordinal("sub_grade"),
        "emp_length": E.emp_length_map("emp_length"),
    }
    for c, v in NULL_DEFAULT_COLUMNS.items():
        enc[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
    for v in HOME_VALUES:
        enc[f"home_ownership_{v}"] = E.one_hot("home_ownership", v)
    for v in PURPOSE_VALUES:
        enc[f"purpose_{v}"] = E.one_hot("purpose", v)
    cols = [enc.get(c, F.col(c)).cast("double").alias(c) for c in FEATURE_ORDER]
    return df.select("loan_id", *cols, E.label_target("loan_status").alias("target"))


def gbt_estimator(max_iter: int = 100, max_depth: int = 5, step_size: float = 0.1,
                 seed: int = 42, max_bins: int = 32, cache_node_ids: bool = False,
                 checkpoint_interval: int = 10) -> Pipeline:
    imputer = Imputer(strategy="median", inputCols=NULLABLE_FEATURES,
                      outputCols=[imputed_name(c) for c in NULLABLE_FEATURES])
    assembler = VectorAssembler(inputCols=MODEL_INPUTS, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol="target", maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step_size, lossType="logistic", seed=seed,
                        maxBins=max_bins, cacheNodeIds=cache_node_ids,
                        checkpointInterval=checkpoint_interval)
    return Pipeline(stages=[imputer, assembler, gbt])


def train_gbt(train: DataFrame, **params) -> PipelineModel:
    """Fit on the train fold, which is written to the shared work folder first.

    Every tree level is one pass over the binned rows, which Spark's trainer keeps in memory itself; the fold
    is read for the medians, the splits and the bins only.  Kept in memory too, it would take more of it than
    the binned rows for all the passes.  It is spread round-robin over a file for each of the cluster's
    cores, or as many times that as keep ``ROWS_PER_TASK``: an upstream shuffle that AQE coalesced into a few
    partitions would otherwise leave most cores idle for all 100 x depth passes.  One task per core
    and pass is enough (the rows are uniform in cost); twice that only added scheduling overhead to
    each of the 500 passes (60 s -> 50 s at sf0.1).
    """
    spark = train.sparkSession
    cores = parallelism(spark)
    n_parts = cores * max(1, math.ceil(train.count() / (cores * ROWS_PER_TASK)))
    path = scratch_path(spark, "train")
    train.select(*FEATURE_ORDER, F.col("target").cast("double").alias("target")).repartition(n_parts).write.parquet(path)
    return gbt_estimator(**params).fit(spark.read.parquet(path))


def gbt_stage(model: PipelineModel) -> GBTClassificationModel:
    return [s for s in model.stages if isinstance(s, GBTClassificationModel)][0]


def score_batch(model: PipelineModel, features: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns + default_risk (probability of default)."""
    out = model.transform(features)
    return out.select(*keep, vector_to_array("probability")[1].alias("default_risk"))


def save_model(model: PipelineModel, model_dir: str, run_ts: str) -> str:
    """Save under the run's own folder, then publish it as the latest.

    What is published is one small record, appended: readers see the whole new model or the one
    before, never a folder that is being replaced.
    """
    path = f"{model_dir}/runs/{run_ts}"
    model.write().overwrite().save(path)
    spark = SparkSession.active()
    record = spark.range(1).select(F.lit(run_ts).alias("run_ts"), F.lit(path).alias("path"),
                                   F.lit(time.time_ns()).alias("published_ns"))
    record.coalesce(1).write.mode("append").json(f"{model_dir}/published")
    return path


def latest_path(model_dir: str) -> str:
    """Folder of the model that was published last."""
    published = SparkSession.active().read.schema(PUBLISHED_SCHEMA).json(f"{model_dir}/published")
    last = published.agg(F.max_by("path", "published_ns")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no model is published in {model_dir}")
    return last


def load_latest(model_dir: str) -> PipelineModel:
    return PipelineModel.load(latest_path(model_dir))


def assembled_features(features: DataFrame) -> DataFrame:
    """The assembler's vector of the encoded features, as the 36 columns again (null where the
    vector holds NaN), to check encoding and order end to end."""
    vector = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="_features", handleInvalid="keep").transform(features)
    values = vector.withColumn("_features", vector_to_array("_features"))
    return values.select("loan_id", *[F.nanvl(F.col("_features")[k], F.lit(None).cast("double")).alias(c)
                                      for k, c in enumerate(FEATURE_ORDER)], "target")
