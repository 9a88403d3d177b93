"""Properties from the reference's own unit tests, checked on our operators."""

import math

from pyspark.sql import functions as F

from riskloom.functions import encoders as E
from riskloom.operators.applications import decide, prediction
from riskloom.operators.metrics import evaluation_gate, gate_status
from riskloom.schemas import (
    FEATURE_ORDER, GRADE_CODES, HOME_VALUES, MART_COLUMNS, PURPOSE_VALUES, sub_grade_codes,
)


def _one(spark, col, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"{col} {typ}")
    return [r[0] for r in df.select(fn(col)).collect()]


def test_grade_codes(spark):
    vals = list("ABCDEFG") + ["H", None]
    assert _one(spark, "g", vals, E.grade_ordinal) == [7, 6, 5, 4, 3, 2, 1, 4, 4]
    assert all(1 <= v <= 7 for v in GRADE_CODES.values())


def test_sub_grade_codes(spark):
    codes = sub_grade_codes()
    assert codes["A1"] == 35 and codes["G5"] == 1 and codes["C3"] == 23 and len(codes) == 35
    assert _one(spark, "s", ["A1", "G5", "H9", None], E.sub_grade_ordinal) == [35, 1, 18, 18]


def test_term_variants(spark):
    vals = [" 36 months", "36 months", " 60 months", "n/a", None]
    assert _one(spark, "t", vals, E.term_like) == [36, 36, 60, None, None]
    assert _one(spark, "t", vals, E.term_contains) == [36, 36, 60, 60, 60]
    assert _one(spark, "t", vals, E.term_exact) == [60, 36, 60, 60, 60]


def test_employment(spark):
    vals = ["< 1 year", "1 year", "2 years", "10+ years", "Unknown", "n/a", None]
    assert _one(spark, "e", vals, E.emp_length_map) == [0.5, 1.0, 2.0, 10.0, 0.0, 0.0, 0.0]
    assert _one(spark, "e", vals, E.emp_length_like) == [1, 1, 2, 10, 0, 0, 0]


def test_exactly_one_flag(spark):
    for values, extra in ((HOME_VALUES, "ANY"), (PURPOSE_VALUES, "car")):
        df = spark.createDataFrame([(v,) for v in values + [extra, None]], "c string")
        sums = df.select(sum(E.one_hot("c", v) for v in values).alias("s")).collect()
        assert [r.s for r in sums] == [1] * len(values) + [0, 0]


def test_feature_schema():
    assert len(FEATURE_ORDER) == 36 and len(set(FEATURE_ORDER)) == 36
    assert FEATURE_ORDER[:6] == ["loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade"]
    assert len(MART_COLUMNS) == 36 and "sub_grade" not in MART_COLUMNS


def test_strict_decision(spark):
    df = spark.createDataFrame([(p,) for p in [0.0, 0.25, 0.3, 0.5, 0.7, 0.8, 1.0]], "p double")
    rows = df.select(decide("p").alias("d"), prediction("p").alias("y")).collect()
    assert [r.y for r in rows] == [0, 0, 0, 0, 1, 1, 1]
    assert rows[3].d == "APPROVED" and rows[5].d == "DENIED"


def test_gate(spark):
    assert gate_status(0.85) == "SUCCESS" and gate_status(0.60) == "FAILED"
    assert gate_status(0.75) == "SUCCESS" and gate_status(0.74994) == "FAILED"
    assert gate_status(0.74996) == "SUCCESS"  # rounded to 4 places first
    assert gate_status(float("nan")) == "FAILED" and gate_status(None) == "FAILED"
    df = spark.createDataFrame([(0.75,), (0.7499,), (float("nan"),), (None,)], "auc_roc double")
    out = [r.status for r in evaluation_gate(df).collect()]
    assert out == ["SUCCESS", "FAILED", "FAILED", "FAILED"]
    assert not math.isnan(0.75)


def test_risk_display(spark):
    from riskloom.functions.display import money, risk_percent
    df = spark.createDataFrame([(0.5625, 10000.0), (0.123, 1234567.0)], "p double, x double")
    rows = df.select(risk_percent("p").alias("r"), money("x").alias("m")).collect()
    assert rows[0].r == "56.2%" and rows[1].r == "12.3%"
    assert rows[0].m == "10,000.0" and rows[1].m == "1,234,567.0"
    vals = [1234.5, 0.1, 1234567.891, 12345678.9, 99.99, 123456789012.25, 5.0, 60000.0]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select(money("x").alias("m")).collect()
    assert [r.m for r in got] == [f"{v:,}" for v in vals]


def test_question_text(spark):
    from riskloom.functions.display import question_text
    row = {"loan_amnt": 10000.0, "term": "36 months", "grade": "C", "sub_grade": "C3",
           "fico": 700, "annual_inc": 60000.0, "dti": 20.0, "emp_length": "3 years",
           "purpose": "debt_consolidation"}
    df = spark.createDataFrame([row])
    q = df.select(question_text().alias("q")).first().q
    assert q == ("A loan application has been DENIED. Applicant details: Loan amount: $10,000.0, "
                 "Term: 36 months, Credit grade: C (C3), FICO: 700, Annual income: $60,000.0, "
                 "DTI: 20.0%, Employment: 3 years, Purpose: debt_consolidation. "
                 "Why was this denied and how can the applicant improve?")
    assert F is not None


def test_policy_rules_on_example_application(spark):
    from riskloom.operators.policy import policy_reasons
    base = {"app_id": 1, "grade": "C", "fico": 700, "dti": 20.0, "term": "36 months",
            "purpose": "debt_consolidation", "emp_length": "3 years"}
    risky = dict(base, app_id=2, grade="A", fico=570, dti=47.5, term="60 months",
                 emp_length="< 1 year")
    df = spark.createDataFrame([base, risky])
    hits = {}
    for r in policy_reasons(df).collect():
        hits.setdefault(r.app_id, []).append(r.rule_id)
    assert hits[1] == ["dti_20_35"]
    assert hits[2] == ["dti_above_43", "fico_below_grade_minimum", "fico_below_580",
                       "term_60_months", "debt_consolidation_dti_40", "employment_under_1_year"]
