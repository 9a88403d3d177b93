"""Declarative data-quality checks and simple row accounting.

All 13 column checks are computed in ONE aggregation over the staging rows:
the features layer is a row-wise map of staging and the mart a filter of it,
so each check becomes a ``count_if`` with the layer's own condition.  One
scan, map-side partial aggregation, a single-row final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..schemas import COMPLETED_STATUSES, GRADE_CODES
from .staging import completed_loans, staging

# (model, column, check, accepted values or None)
CHECKS = [
    ("stg_loans", "loan_amnt", "not_null", None),
    ("stg_loans", "annual_inc", "not_null", None),
    ("stg_loans", "grade", "not_null", None),
    ("stg_loans", "grade", "accepted_values", list(GRADE_CODES)),
    ("stg_loans", "loan_status", "not_null", None),
    ("stg_loans", "loan_status", "accepted_values", list(COMPLETED_STATUSES)),
    ("int_loan_features", "target", "not_null", None),
    ("int_loan_features", "target", "accepted_values", [0, 1]),
    ("int_loan_features", "grade_encoded", "not_null", None),
    ("int_loan_features", "loan_amnt", "not_null", None),
    ("mart_training", "target", "not_null", None),
    ("mart_training", "loan_amnt", "not_null", None),
    ("mart_training", "dti", "not_null", None),
]


def _check_frame(raw: DataFrame) -> DataFrame:
    """Staging rows plus the derived columns the later layers check."""
    stg = staging(raw)
    return stg.select(
        "loan_amnt", "annual_inc", "grade", "loan_status", "dti",
        E.label_target("loan_status").alias("target"),
        E.grade_ordinal("grade").alias("grade_encoded"),
        ((F.col("loan_amnt") > 0) & (F.col("annual_inc") > 0) & (F.col("dti") >= 0))
        .alias("_in_mart"),
    )


def _failure(check) -> F.Column:
    model, column, kind, values = check
    c = F.col(column)
    bad = c.isNull() if kind == "not_null" else ~c.isin(*values)  # null stays null -> not counted
    if model == "mart_training":
        bad = F.col("_in_mart") & bad
    return F.count_if(bad)


def dq_report(raw: DataFrame, kinds: tuple[str, ...] = ("not_null", "accepted_values")) -> DataFrame:
    """One row per check: model, column_name, check, failures, passed."""
    checks = [c for c in CHECKS if c[2] in kinds]
    wide = _check_frame(raw).agg(*[_failure(c).alias(f"f{i}") for i, c in enumerate(checks)])
    stack_args = ", ".join(
        f"'{m}', '{col}', '{k}', f{i}" for i, (m, col, k, _) in enumerate(checks))
    long = wide.selectExpr(
        f"stack({len(checks)}, {stack_args}) AS (model, column_name, check, failures)")
    return long.select(
        "model", "column_name", "check",
        F.col("failures").cast("bigint").alias("failures"),
        (F.col("failures") == 0).alias("passed"),
    )


def dq_not_null(raw: DataFrame) -> DataFrame:
    return dq_report(raw, ("not_null",))


def dq_accepted_values(raw: DataFrame) -> DataFrame:
    return dq_report(raw, ("accepted_values",))


def rows_dropped(raw: DataFrame) -> DataFrame:
    """Rows before and after the completed-loan filter."""
    done = F.col("loan_status").isin(*COMPLETED_STATUSES)
    return raw.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(F.coalesce(done, F.lit(False))).alias("kept_rows"),
        F.count_if(~F.coalesce(done, F.lit(False))).alias("dropped_rows"),
    )


def target_distribution(raw: DataFrame) -> DataFrame:
    df = completed_loans(raw).select(E.label_target("loan_status").alias("target"))
    return df.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"))


def default_rate_by_grade(raw: DataFrame) -> DataFrame:
    """Flagship slice: staging filter -> grade code -> target -> default rate per grade."""
    df = staging(raw).select(
        E.grade_ordinal("grade").alias("grade_code"),
        E.label_target("loan_status").alias("target"),
    )
    return df.groupBy("grade_code").agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.sum("target").cast("bigint").alias("n_defaults"),
        F.round(F.avg("target"), 6).alias("default_rate"),
    )
