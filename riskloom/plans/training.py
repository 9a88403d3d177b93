"""Training plan: load -> encode -> split -> fit -> evaluate -> gate -> save.

The split is written to the shared work folder so the train fold and the
test fold are cut from one materialised table (and a lost executor
recomputes from there, not from the raw scan).
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import auc_roc, gate_status
from ..operators.model import save_model, score_batch, train_gbt, training_features
from ..operators.split import stratified_split
from ..schemas import FEATURE_ORDER
from ..session import scratch_path
from ..sources.artifacts import write_metrics
from ..sources.files import assert_loaded


def fit_and_evaluate(spark: SparkSession, raw: DataFrame, **params) -> tuple[PipelineModel, dict]:
    assert_loaded(raw)
    path = scratch_path(spark, "split")  # sets a checkpoint folder, too
    stratified_split(training_features(raw)).write.parquet(path)
    split = spark.read.parquet(path)
    model = train_gbt(split.filter(F.col("fold") == "train"), **params)
    test = score_batch(model, split.filter(F.col("fold") == "test"), keep=["loan_id", "target"]).cache()
    auc = auc_roc(test, "default_risk", "target")
    acc, n_test = test.agg(
        F.avg(((F.col("default_risk") > 0.5).cast("int") == F.col("target")).cast("double")),
        F.count(F.lit(1))).first()
    n_train = split.filter(F.col("fold") == "train").count()
    test.unpersist()
    metrics = {
        "auc_roc": round(auc, 4),
        "accuracy": round(acc, 4) if acc is not None else None,
        "test_size": int(n_test),
        "train_size": int(n_train),
        "n_features": len(FEATURE_ORDER),
    }
    return model, metrics


def run_training(spark: SparkSession, raw: DataFrame, model_dir: str,
                      metrics_dir: str | None = None, **params) -> dict:
    """Returns {'status', 'metrics', 'model_path'}; saves nothing if the gate fails."""
    model, metrics = fit_and_evaluate(spark, raw, **params)
    status = gate_status(metrics["auc_roc"])
    if status != "SUCCESS":
        return {"status": "FAILED", "metrics": metrics}
    run_ts = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    path = save_model(model, model_dir, run_ts)
    write_metrics(spark, metrics, metrics_dir or f"{model_dir}/metrics", run_ts)
    return {"status": "SUCCESS", "metrics": metrics, "model_path": path}
