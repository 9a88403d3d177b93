"""Registered queries that need a trained model, a text pipeline or a stream.

A trained model is not SQL, so these return what must hold of its output for
every row (bounds, additivity, saved = in memory, stream = rules) next to the
row's key, which SQL can state; brute-force tests check the values.  One model
per (application, scale dir) is trained with the reference parameters and
reused by every query that needs it.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import grade_ordinal
from ..operators import applications as A
from ..operators.attribution import attribute, contribution_array, tree_tables
from ..operators.chunking import chunk_documents
from ..operators.embedding import embed_chunks, vector_entries
from ..operators.metrics import gate_status
from ..operators.model import (
    assembled_features, latest_path, load_latest, save_model, score_batch, training_features,
)
from ..operators.policy import offline_explanation, rule_hits
from ..operators.split import stratified_split
from ..plans.scoring import score_applications
from ..plans.training import fit_and_evaluate
from ..schemas import CHUNK_SIZE
from ..session import app_id, scratch_path, ship_package
from ..sources.artifacts import read_metrics, write_metrics
from ..sources.fixture import raw_loans
from ..sources.tables import read_table
from ..streaming.score_stream import start_scoring_stream

GBT_PARAMS = {"max_iter": 100, "max_depth": 5, "step_size": 0.1, "seed": 42}

_MODELS: dict[tuple[str, str], tuple[PipelineModel, dict, str]] = {}


def trained(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, dict, str]:
    """(model, metrics, saved path), trained once per application and scale."""
    key = (app_id(spark), os.path.abspath(sf_dir))
    if key not in _MODELS:
        model, metrics = fit_and_evaluate(spark, raw_loans(spark, sf_dir), **GBT_PARAMS)
        path = scratch_path(spark, "model")
        model.write().overwrite().save(path)
        _MODELS[key] = (PipelineModel.load(path), metrics, path)
    return _MODELS[key]


def _valid_apps(spark, sf_dir) -> DataFrame:
    valid, _ = A.split_rejects(A.applications_from_loans(raw_loans(spark, sf_dir)))
    return valid


def assemble_features_q(spark, sf_dir):
    return assembled_features(training_features(raw_loans(spark, sf_dir)))


def train_gbt_q(spark, sf_dir):
    _, metrics, _ = trained(spark, sf_dir)
    return spark.createDataFrame(
        [(metrics["train_size"], metrics["test_size"], metrics["n_features"], gate_status(metrics["auc_roc"]))],
        "train_size long, test_size long, n_features int, status string")


def score_batch_q(spark, sf_dir):
    model, _, _ = trained(spark, sf_dir)
    scored = A.with_decision(score_batch(model, A.serving_features(_valid_apps(spark, sf_dir)), keep=["app_id"]))
    p = F.col("default_risk")
    return scored.select("app_id", p.between(0, 1).alias("in_range"),
                         ((F.col("decision") == "DENIED") == (p > 0.5)).alias("decision_follows"))


def _attributed(spark, sf_dir) -> DataFrame:
    model, _, _ = trained(spark, sf_dir)
    feats = A.serving_features(_valid_apps(spark, sf_dir))
    transformed = model.transform(feats).withColumn("default_risk", vector_to_array("probability")[1])
    return attribute(spark, model, transformed, keep=["app_id", "default_risk"])


def contributions_q(spark, sf_dir):
    a = _attributed(spark, sf_dir).withColumn("c", contribution_array())
    total = F.aggregate("c", F.col("base_value"), lambda acc, x: acc + x["shap"])
    p = F.col("default_risk")
    return a.select("app_id", F.size("c").alias("n_features"),
                    (F.abs(total - F.log(p / (1 - p))) < 1e-9).alias("additive"))


def base_value_q(spark, sf_dir):
    """The base value is the mean logit over the rows the trees were grown on."""
    model, _, _ = trained(spark, sf_dir)
    base = tree_tables(spark, model).base_value
    train = stratified_split(training_features(raw_loans(spark, sf_dir))).filter("fold = 'train'")
    scored = model.transform(train).select((2 * vector_to_array("rawPrediction")[1]).alias("logit"))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"),
                      (F.abs(F.avg("logit") - F.lit(base)) < 1e-6).alias("is_mean_logit"))


def _result_facts(scored: DataFrame) -> DataFrame:
    """What must hold of each nested result, next to its key, status and reasons."""
    top = F.transform(F.col("result.top_features"), lambda x: -F.abs(x["shap"]))
    return scored.select(
        "app_id", "status", F.array_join("violations", ",").alias("violations"),
        F.col("result").isNotNull().alias("has_result"),
        F.when(F.col("result").isNotNull(), F.size(top)).alias("n_top"),
        (top == F.array_sort(top)).alias("top_in_order"),
        ((F.col("result.decision") == "DENIED") == F.col("result.explanation").isNotNull()).alias("explained_if_denied"))


def score_result_q(spark, sf_dir):
    model, _, _ = trained(spark, sf_dir)
    return _result_facts(score_applications(spark, model, A.applications_from_loans(raw_loans(spark, sf_dir))))


def metrics_sink_q(spark, sf_dir):
    """The rule score's metrics, written as a run's record and read back."""
    from .catalog import metrics_row
    d = scratch_path(spark, "metrics")
    write_metrics(spark, metrics_row(spark, sf_dir).first().asDict(), d, "run")
    return read_metrics(spark, d)


def _scores_equal(spark, sf_dir, other: PipelineModel) -> DataFrame:
    model, _, _ = trained(spark, sf_dir)
    feats = A.serving_features(_valid_apps(spark, sf_dir))
    again = score_batch(other, feats, keep=["app_id"]).withColumnsRenamed({"app_id": "id", "default_risk": "again"})
    return score_batch(model, feats, keep=["app_id"]).join(again, F.col("app_id") == F.col("id")).select(
        "app_id", (F.abs(F.col("default_risk") - F.col("again")) < 1e-12).alias("same_score"))


def model_sink_q(spark, sf_dir):
    """Scores of the model in the folder its run was saved to, against the one in memory."""
    model, _, _ = trained(spark, sf_dir)
    return _scores_equal(spark, sf_dir, PipelineModel.load(save_model(model, scratch_path(spark, "models"), "run")))


def model_source_q(spark, sf_dir):
    """Scores of the latest published model, of two that were published, against the one in memory."""
    model, _, _ = trained(spark, sf_dir)
    d = scratch_path(spark, "models")
    for run in ("second", "first"):  # the order of publishing counts, not the names
        save_model(model, d, run)
    assert latest_path(d).endswith("/first")
    return _scores_equal(spark, sf_dir, load_latest(d))


def score_stream_q(spark, sf_dir):
    model, _, _ = trained(spark, sf_dir)
    src, out, chk = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-chk"))
    apps = A.applications_from_loans(raw_loans(spark, sf_dir))
    # land the applications as files (the raw table's own layout, which grows with the data)
    apps.write.parquet(src)
    q = start_scoring_stream(spark, model, src, out, chk)
    q.awaitTermination()
    return _result_facts(spark.read.parquet(out))


def _documents(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _covered(text: str, chunks: list[str]) -> bool:
    """Whether each chunk stands where the text is covered so far, or before, and all of them leave
    out nothing but white space."""
    reach = 0
    for c in chunks:
        blank = len(text) - len(text[reach:].lstrip())  # the next character to cover
        at = text.rfind(c, 0, blank + len(c))
        if at < 0:
            return False
        reach = max(reach, at + len(c))
    return not text[reach:].strip()


def chunk_documents_q(spark, sf_dir):
    """For every document with any text: its chunks keep the size and cover the text in order."""
    docs = _documents(spark, sf_dir)
    chunks = chunk_documents(docs)
    ship_package(spark)

    @F.pandas_udf("boolean")
    def covered(texts: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([_covered(t, list(c)) for t, c in zip(texts, chunks)], dtype=bool)

    every = chunks.groupBy("doc_id").agg(
        (F.max(F.length("chunk")) <= CHUNK_SIZE).alias("within_size"),
        F.array_sort(F.collect_list(F.struct("chunk_id", "chunk"))).alias("chunks"))
    return docs.join(every, "doc_id").select("doc_id", "within_size", covered("text", F.col("chunks.chunk")).alias("covered"))


def embed_chunks_q(spark, sf_dir):
    """For every document with any text: its chunks' vectors are sparse, not wider than their tokens,
    and of length 1 (0 without a word that tells chunks apart)."""
    emb, _ = embed_chunks(chunk_documents(_documents(spark, sf_dir)), keep_tokens=True)
    ship_package(spark)

    @F.pandas_udf("struct<nonzeros:int,norm:double>")
    def facts(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"nonzeros": [int((v != 0).sum()) for v in values],
                             "norm": [float((v * v).sum()) ** 0.5 for v in values]})

    entries = vector_entries("embedding")
    rows = emb.select("doc_id", F.size("tokens").alias("n_tokens"),
                      facts(entries["indices"], entries["values"]).alias("f"))
    ok = (F.col("f.nonzeros") <= F.col("n_tokens")) & F.when(
        F.col("f.nonzeros") > 0, F.abs(F.col("f.norm") - 1) < 1e-9).otherwise(F.col("f.norm") == 0)
    return rows.groupBy("doc_id").agg(F.bool_and(ok).alias("vectors_ok"), (F.count(F.lit(1)) > 0).alias("has_chunks"))


def explain_denials_q(spark, sf_dir):
    """Every valid application's decision, the denied ones explained by the policies they hit."""
    valid = _valid_apps(spark, sf_dir)
    scored = A.with_decision(valid.withColumn(
        "default_risk", A.rule_score(grade_ordinal("grade"), F.col("dti"))))
    return scored.select("app_id", "decision", F.when(
        F.col("decision") == "DENIED", offline_explanation(rule_hits())).alias("explanation"))


def registry() -> dict:
    return {
        "assemble_features": assemble_features_q,
        "train_gbt": train_gbt_q,
        "score_batch": score_batch_q,
        "contributions": contributions_q,
        "base_value": base_value_q,
        "score_result": score_result_q,
        "metrics_sink": metrics_sink_q,
        "model_sink": model_sink_q,
        "model_source": model_source_q,
        "score_stream": score_stream_q,
        "chunk_documents": chunk_documents_q,
        "embed_chunks": embed_chunks_q,
        "explain_denials": explain_denials_q,
    }
