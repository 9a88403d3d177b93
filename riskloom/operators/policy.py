"""Lending-policy rules and the rules each application hits.

The policy documents are restated as a small literal rules table (our own
wording): DTI bands, minimum FICO by grade, a FICO floor, term, purpose
and employment flags.  Each rule is a SQL predicate over the application's
fields.  Matching compiles the table into one array expression per row --
a range "join" with no join at all: no shuffle, no nested-loop join, and the
table never leaves the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: policy bands and thresholds (restated from the policy documents).
POLICY_RULES = [
    # rule_id, policy, line of the policy, severity, predicate over application fields, reason
    ("dti_below_20", "dti", 4, "favourable", "dti >= 0 AND dti < 20",
     "Debt-to-income below 20% is excellent."),
    ("dti_20_35", "dti", 5, "standard", "dti >= 20 AND dti < 35",
     "Debt-to-income of 20-35% follows the standard process."),
    ("dti_35_43", "dti", 6, "review", "dti >= 35 AND dti <= 43",
     "Debt-to-income of 35-43% is elevated risk and needs extra scrutiny."),
    ("dti_above_43", "dti", 7, "adverse", "dti > 43 AND dti <= 50",
     "Debt-to-income above 43% is high risk and likely denied."),
    ("dti_above_50", "dti", 8, "adverse", "dti > 50",
     "Debt-to-income above 50% is denied in most cases."),
    ("fico_below_grade_minimum", "credit_score", 4, "adverse",
     "fico < CASE grade WHEN 'A' THEN 750 WHEN 'B' THEN 700 WHEN 'C' THEN 660 "
     "WHEN 'D' THEN 630 WHEN 'E' THEN 600 END",
     "FICO score is below the minimum for the credit grade (A 750, B 700, C 660, D 630, E 600)."),
    ("fico_below_600_grade_f_g", "credit_score", 9, "review", "grade IN ('F', 'G') AND fico < 600",
     "Grades F and G with FICO below 600 are high risk with limited approval."),
    ("fico_below_580", "credit_score", 11, "adverse", "fico < 580",
     "FICO below 580 is high risk and denied without compensating factors."),
    ("term_60_months", "purpose_term", 5, "review", "term = '60 months'",
     "A 60-month term carries higher risk than 36 months."),
    ("purpose_small_business", "purpose_term", 8, "review", "purpose = 'small_business'",
     "Small-business loans carry elevated default risk."),
    ("debt_consolidation_dti_40", "purpose_term", 9, "adverse",
     "purpose = 'debt_consolidation' AND dti >= 40",
     "Debt consolidation requires debt-to-income below 40%."),
    ("employment_under_1_year", "purpose_term", 13, "review", "emp_length = '< 1 year'",
     "Under one year of employment needs compensating factors."),
    ("employment_unknown", "purpose_term", 14, "review", "emp_length = 'Unknown'",
     "Unknown employment history increases the risk assessment."),
]


def rule_hits() -> F.Column:
    """array<struct<rule_id, policy, line, severity, reason>> of every rule the row hits."""
    hits = [F.when(F.coalesce(F.expr(pred), F.lit(False)), F.struct(
        F.lit(rid).alias("rule_id"), F.lit(pol).alias("policy"), F.lit(line).alias("line"),
        F.lit(sev).alias("severity"), F.lit(text).alias("reason")))
        for rid, pol, line, sev, pred, text in POLICY_RULES]
    return F.array_compact(F.array(*hits))


def policy_reasons(apps: DataFrame, id_col: str = "app_id") -> DataFrame:
    """One row per (application, rule hit)."""
    return apps.select(id_col, F.inline(rule_hits()))


def offline_explanation(hits: F.Column) -> F.Column:
    """A policy-grounded explanation without any external model: the adverse
    and review rules hit, in table order."""
    relevant = F.filter(hits, lambda h: h["severity"].isin("adverse", "review"))
    text = F.array_join(F.transform(relevant, lambda h: h["reason"]), " ")
    return F.when(F.size(relevant) > 0, F.concat(
        F.lit("The application was denied. Policies that apply: "), text)).otherwise(
        F.lit("The application was denied by the risk model; no specific policy rule applies."))
