"""Scoring plan shared by batch and stream.

validate -> question text + policy hits -> serving features -> model ->
probability -> decision -> attributions -> explanation (denied only) ->
nested result.  All applications take the same path, so the source is read
once; those that break a rule carry every broken rule and a null result.
All steps are row-local: one stage per input partition (an input with fewer
splits than cores is spread first), so a micro-batch and a batch of the same
rows give the same results.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import question_text
from ..operators.applications import decide, serving_features, with_violations
from ..operators.attribution import attribute, contribution_array
from ..operators.explain import CompletionFn, explain_denials, with_prompt
from ..operators.policy import offline_explanation, rule_hits
from ..operators.ranking import top_features
from ..schemas import TOP_FEATURES

KEEP = ["app_id", "question", "policy_context"]


def score_valid(spark: SparkSession, model: PipelineModel, apps: DataFrame,
                completion_fn: CompletionFn | None = None, carry: tuple[str, ...] = (),
                explain_when: F.Column | None = None) -> DataFrame:
    """Flat scored rows: app_id, ``carry`` columns, decision, default_risk, base_value, logit,
    36 feature values, shap_* columns, explanation, explanation_error.  Denied rows are explained,
    and of these only those for which ``explain_when`` (if given) holds."""
    pre = apps.withColumns({
        "question": question_text(),
        "policy_context": offline_explanation(rule_hits()),
    })
    keep = [*KEEP, *carry]
    feats = serving_features(pre, keep=keep)
    transformed = model.transform(feats).withColumn(
        "default_risk", vector_to_array("probability")[1])
    scored = attribute(spark, model, transformed, keep=[*keep, "default_risk"])
    scored = scored.withColumn("decision", decide("default_risk"))
    denied = F.col("decision") == "DENIED"
    if explain_when is not None:
        denied = denied & explain_when
    if completion_fn is None:
        # offline: the policy rules the application hits are the explanation
        return scored.withColumns({
            "explanation": F.when(denied, F.col("policy_context")),
            "explanation_error": F.lit(None).cast("string"),
        })
    prompted = with_prompt(scored.withColumn("_denied", denied), context="policy_context")
    return explain_denials(prompted, completion_fn, only_when="_denied").drop("_denied", "system_prompt")


def result_struct(k: int = TOP_FEATURES) -> F.Column:
    return F.struct(
        F.col("decision"), F.col("default_risk"), F.col("base_value"),
        top_features(contribution_array(), k).alias("top_features"),
        F.col("explanation"), F.col("explanation_error"))


def score_applications(spark: SparkSession, model: PipelineModel, apps: DataFrame,
                       completion_fn: CompletionFn | None = None) -> DataFrame:
    """One row per application: app_id, status ('SCORED' / 'REJECTED'),
    violations (array<string>), result (null when rejected)."""
    ok = F.size("violations") == 0
    scored = score_valid(spark, model, with_violations(apps), completion_fn, carry=("violations",), explain_when=ok)
    return scored.select("app_id", F.when(ok, F.lit("SCORED")).otherwise(F.lit("REJECTED")).alias("status"),
                         "violations", F.when(ok, result_struct()).alias("result"))
