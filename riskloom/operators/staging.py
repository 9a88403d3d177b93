"""The layered SQL pipeline as DataFrame functions: staging -> features -> mart.

Every step is a narrow projection or filter, so Catalyst collapses the
three layers into one stage over the scan and pushes the filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..schemas import (
    COMPLETED_STATUSES, HOME_VALUES, MART_FEATURES, NULL_DEFAULT_COLUMNS, PURPOSE_VALUES,
)

STAGING_COLUMNS = [
    "loan_id", "loan_amnt", "term_months", "int_rate", "installment", "grade", "sub_grade",
    "annual_inc", "dti", "emp_length", "fico_range_low", "fico_range_high", "open_acc",
    "pub_rec", "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies",
    "home_ownership", "purpose", "loan_status",
]


def stg_project(raw: DataFrame) -> DataFrame:
    """Keep the staging columns and parse ``term`` into ``term_months``."""
    cols = [E.term_like("term").alias("term_months") if c == "term_months" else F.col(c)
            for c in STAGING_COLUMNS]
    return raw.select(*cols)


def stg_filter(df: DataFrame) -> DataFrame:
    """Amount and income present, income positive, loan completed."""
    return df.filter(
        F.col("loan_amnt").isNotNull()
        & F.col("annual_inc").isNotNull()
        & (F.col("annual_inc") > 0)
        & F.col("loan_status").isin(*COMPLETED_STATUSES)
    )


def staging(raw: DataFrame) -> DataFrame:
    return stg_filter(stg_project(raw))


def completed_loans(raw: DataFrame) -> DataFrame:
    """Training-flow filter: completed loans only, nothing else dropped."""
    return raw.filter(F.col("loan_status").isin(*COMPLETED_STATUSES))


def loan_features(stg: DataFrame) -> DataFrame:
    """Intermediate layer: SQL-pipeline encoders (term, grade, employment cascade,
    null defaults, fixed flags) and the target."""
    nd = NULL_DEFAULT_COLUMNS
    return stg.select(
        "loan_id",
        "loan_amnt",
        F.col("term_months").alias("term"),
        "int_rate",
        "installment",
        E.grade_ordinal("grade").alias("grade_encoded"),
        "annual_inc",
        "dti",
        E.emp_length_like("emp_length").alias("emp_length_years"),
        "fico_range_low",
        "fico_range_high",
        "open_acc",
        F.coalesce(F.col("pub_rec"), F.lit(nd["pub_rec"]).cast("bigint")).alias("pub_rec"),
        "revol_bal",
        F.coalesce(F.col("revol_util"), F.lit(nd["revol_util"])).alias("revol_util"),
        "total_acc",
        F.coalesce(F.col("mort_acc"), F.lit(nd["mort_acc"]).cast("bigint")).alias("mort_acc"),
        F.coalesce(F.col("pub_rec_bankruptcies"),
                   F.lit(nd["pub_rec_bankruptcies"]).cast("bigint")).alias("pub_rec_bankruptcies"),
        *[E.one_hot("home_ownership", v).alias(f"home_ownership_{v.lower()}") for v in HOME_VALUES],
        *[E.one_hot("purpose", v).alias(f"purpose_{v}") for v in PURPOSE_VALUES],
        E.label_target("loan_status").alias("target"),
    )


def mart_filter(df: DataFrame) -> DataFrame:
    """amount > 0, income > 0, dti >= 0; a null in any of them drops the row."""
    return df.filter((F.col("loan_amnt") > 0) & (F.col("annual_inc") > 0) & (F.col("dti") >= 0))


def mart_project(features: DataFrame) -> DataFrame:
    """Rename the two encoded columns and fix the mart's column order."""
    renames = {"grade": "grade_encoded", "emp_length": "emp_length_years"}
    return features.select(
        "loan_id",
        *[F.col(renames.get(c, c)).alias(c) for c in MART_FEATURES],
        "target",
    )


def mart(features: DataFrame) -> DataFrame:
    return mart_project(mart_filter(features))


def build_layers(raw: DataFrame) -> dict[str, DataFrame]:
    """All three layers from one raw frame (lazy; nothing runs here)."""
    stg = staging(raw)
    feats = loan_features(stg)
    return {"stg_loans": stg, "int_loan_features": feats, "mart_training": mart(feats)}


def materialize_layers(raw: DataFrame, path: str) -> dict[str, DataFrame]:
    """The layers by name: staging and features as views, the mart written and read back; all three
    are temporary views of the session afterwards."""
    layers = build_layers(raw)
    layers["mart_training"].write.mode("overwrite").parquet(path)
    layers["mart_training"] = raw.sparkSession.read.parquet(path)
    for name, df in layers.items():
        df.createOrReplaceTempView(name)
    return layers
