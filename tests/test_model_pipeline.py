"""Training, scoring, attribution and streaming on the sf0.001 fixture."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators.applications import applications_from_loans, split_rejects
from riskloom.operators.explain import explain_denials
from riskloom.operators.model import load_latest, save_model
from riskloom.plans.scoring import score_applications, score_valid
from riskloom.plans.training import fit_and_evaluate, run_training
from riskloom.sources.fixture import raw_loans
from riskloom.streaming.score_stream import start_scoring_stream

PARAMS = {"max_iter": 10, "max_depth": 3}


@pytest.fixture(scope="module")
def trained(spark):
    model, metrics = fit_and_evaluate(spark, raw_loans(spark, SF_SMALL), **PARAMS)
    return model, metrics


def test_metrics(trained):
    _, m = trained
    assert m["n_features"] == 36
    assert m["train_size"] + m["test_size"] == 1500 - 514  # completed loans
    assert 0.5 < m["auc_roc"] <= 1.0 and 0.0 <= m["accuracy"] <= 1.0


def test_scores_bounded_and_additive(spark, trained):
    model, _ = trained
    valid, _ = split_rejects(applications_from_loans(raw_loans(spark, SF_SMALL)))
    pdf = score_valid(spark, model, valid).toPandas()
    p = pdf["default_risk"].to_numpy()
    assert ((p >= 0) & (p <= 1)).all()
    shap = pdf[[c for c in pdf.columns if c.startswith("shap_")]].to_numpy()
    assert np.allclose(pdf["base_value"] + shap.sum(axis=1), np.log(p / (1 - p)), atol=1e-9)
    assert set(pdf["decision"]) <= {"APPROVED", "DENIED"}
    denied = pdf["decision"] == "DENIED"
    assert pdf.loc[denied, "explanation"].notna().all()
    assert pdf.loc[~denied, "explanation"].isna().all()


def test_result_shape(spark, trained):
    model, _ = trained
    res = score_applications(spark, model, applications_from_loans(raw_loans(spark, SF_SMALL)))
    rows = res.collect()
    assert len(rows) == 1500
    scored = [r for r in rows if r.status == "SCORED"]
    assert len(scored) == 736
    top = scored[0].result.top_features
    assert len(top) == 10
    mags = [abs(t.shap) for t in top]
    assert mags == sorted(mags, reverse=True)


def test_gate_blocks_save(spark, tmp_path):
    # a constant target has no ranking signal: the run must not save a model
    raw = raw_loans(spark, SF_SMALL).withColumn("loan_status", F.lit("Fully Paid"))
    out = run_training(spark, raw, str(tmp_path / "models"), **PARAMS)
    assert out["status"] == "FAILED" and not os.path.exists(tmp_path / "models")


def test_model_round_trip(spark, trained, tmp_path):
    model, _ = trained
    save_model(model, str(tmp_path), "r1")
    loaded = load_latest(str(tmp_path))
    valid, _ = split_rejects(applications_from_loans(raw_loans(spark, SF_SMALL)))
    a = score_valid(spark, model, valid).select("app_id", "default_risk").toPandas().sort_values("app_id")
    b = score_valid(spark, loaded, valid).select("app_id", "default_risk").toPandas().sort_values("app_id")
    assert np.allclose(a["default_risk"].to_numpy(), b["default_risk"].to_numpy())


def test_stream_equals_batch(spark, trained, tmp_path):
    model, _ = trained
    apps = applications_from_loans(raw_loans(spark, SF_SMALL))
    src = str(tmp_path / "in")
    apps.repartition(3).write.parquet(src)
    q = start_scoring_stream(spark, model, src, str(tmp_path / "out"), str(tmp_path / "chk"),
                             max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = score_applications(spark, model, apps)
    cols = ["app_id", "status", "result.decision", "result.default_risk"]
    s = streamed.select(*cols).toPandas().sort_values("app_id").reset_index(drop=True)
    b = batch.select(*cols).toPandas().sort_values("app_id").reset_index(drop=True)
    assert len(s) == len(b) == 1500
    assert (s["status"] == b["status"]).all() and (s["decision"].fillna("") == b["decision"].fillna("")).all()
    assert np.allclose(s["default_risk"].fillna(-1), b["default_risk"].fillna(-1))


def test_explanation_errors_are_isolated(spark):
    df = spark.createDataFrame(
        [(i, "sys", f"q{i}", i % 2 == 0) for i in range(6)],
        "id int, system_prompt string, question string, denied boolean")

    def flaky(prompts):
        out = []
        for p in prompts:
            if p[1]["content"] == "q4":
                raise RuntimeError("service unavailable")
            out.append("ok " + p[1]["content"])
        return out

    rows = {r.id: r for r in explain_denials(df, flaky, only_when="denied").collect()}
    assert rows[0].explanation == "ok q0" and rows[2].explanation == "ok q2"
    assert rows[4].explanation is None and rows[4].explanation_error == "service unavailable"
    assert rows[1].explanation is None and rows[1].explanation_error is None
