"""Independent SQL statements of each registered query, for DuckDB.

These are the correctness oracle: written as plain SQL over the driver's
tables (views ``orders``, ``customer``, ``documents``, ``embeddings``,
``benchmark``), not generated from the Spark plans, with every constant
restated.  The fixture CTE is the one shared piece, so both sides start from
identical raw loans.  For a trained model and the text steps the SQL states
what must hold for every row's key.
"""

from __future__ import annotations

from ..sources.fixture import fixture_sql

# FIXED VALUES, restated here on purpose: a wrong constant in the engine must not pass on both sides.
GRADE_CODES = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2, "G": 1}
SUB_GRADES = [f"{letter}{step}" for letter in "ABCDEFG" for step in range(1, 6)]  # A1 is 35, G5 is 1
EMP_YEARS = {"Unknown": 0, "< 1 year": 0.5, "1 year": 1, "2 years": 2, "3 years": 3, "4 years": 4, "5 years": 5,
             "6 years": 6, "7 years": 7, "8 years": 8, "9 years": 9, "10+ years": 10}
HOME_VALUES = ["MORTGAGE", "NONE", "OTHER", "OWN", "RENT"]
PURPOSE_VALUES = ["credit_card", "debt_consolidation", "educational", "home_improvement", "house", "major_purchase",
                  "medical", "moving", "other", "renewable_energy", "small_business", "vacation", "wedding"]
FEATURE_ORDER = ["loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "annual_inc", "dti", "emp_length",
                 "fico_range_low", "fico_range_high", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
                 "mort_acc", "pub_rec_bankruptcies", *[f"home_ownership_{v}" for v in HOME_VALUES],
                 *[f"purpose_{v}" for v in PURPOSE_VALUES]]
REQUEST_FIELDS = ["loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "annual_inc", "dti", "emp_length",
                  "fico", "home_ownership", "purpose", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
                  "mort_acc", "pub_rec_bankruptcies"]
APPLICATION_BOUNDS = {"loan_amnt": (1000, 40000), "int_rate": (5.0, 30.0), "installment": (50, 1500),
                      "annual_inc": (10000, 300000), "dti": (0.0, 60.0), "fico": (580, 850), "open_acc": (0, 40),
                      "pub_rec": (0, 10), "revol_bal": (0, 100000), "revol_util": (0.0, 100.0), "total_acc": (0, 60),
                      "mort_acc": (0, 10), "pub_rec_bankruptcies": (0, 5)}
APPLICATION_ENUMS = {
    "term": ["36 months", "60 months"],
    "grade": ["A", "B", "C", "D", "E", "F", "G"],
    "emp_length": ["< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years", "6 years", "7 years", "8 years",
                   "9 years", "10+ years", "Unknown"],
    "home_ownership": ["RENT", "MORTGAGE", "OWN", "OTHER"],
    "purpose": ["debt_consolidation", "credit_card", "home_improvement", "other", "major_purchase", "small_business",
                "medical", "moving", "vacation", "wedding", "house", "renewable_energy", "educational"],
}
SYSTEM_HEAD = ("You are a loan officer assistant explaining why a loan application was denied. Use the following policy "
               "documents to explain the decision clearly and professionally to the applicant.\n\nPolicy context:\n")
SYSTEM_TAIL = ("\n\nProvide a clear, empathetic explanation referencing specific policies. Give the applicant actionable "
               "advice on how to improve their chances.")
# rule, policy, line, severity, condition, reason
POLICY_RULES = [
    ("dti_below_20", "dti", 4, "favourable", "dti >= 0 AND dti < 20", "Debt-to-income below 20% is excellent."),
    ("dti_20_35", "dti", 5, "standard", "dti >= 20 AND dti < 35", "Debt-to-income of 20-35% follows the standard process."),
    ("dti_35_43", "dti", 6, "review", "dti BETWEEN 35 AND 43",
     "Debt-to-income of 35-43% is elevated risk and needs extra scrutiny."),
    ("dti_above_43", "dti", 7, "adverse", "dti > 43 AND NOT dti > 50",
     "Debt-to-income above 43% is high risk and likely denied."),
    ("dti_above_50", "dti", 8, "adverse", "dti > 50", "Debt-to-income above 50% is denied in most cases."),
    ("fico_below_grade_minimum", "credit_score", 4, "adverse",
     "(grade = 'A' AND fico < 750) OR (grade = 'B' AND fico < 700) OR (grade = 'C' AND fico < 660) "
     "OR (grade = 'D' AND fico < 630) OR (grade = 'E' AND fico < 600)",
     "FICO score is below the minimum for the credit grade (A 750, B 700, C 660, D 630, E 600)."),
    ("fico_below_600_grade_f_g", "credit_score", 9, "review", "(grade = 'F' OR grade = 'G') AND fico < 600",
     "Grades F and G with FICO below 600 are high risk with limited approval."),
    ("fico_below_580", "credit_score", 11, "adverse", "fico < 580",
     "FICO below 580 is high risk and denied without compensating factors."),
    ("term_60_months", "purpose_term", 5, "review", "term = '60 months'",
     "A 60-month term carries higher risk than 36 months."),
    ("purpose_small_business", "purpose_term", 8, "review", "purpose = 'small_business'",
     "Small-business loans carry elevated default risk."),
    ("debt_consolidation_dti_40", "purpose_term", 9, "adverse", "purpose = 'debt_consolidation' AND NOT dti < 40",
     "Debt consolidation requires debt-to-income below 40%."),
    ("employment_under_1_year", "purpose_term", 13, "review", "emp_length = '< 1 year'",
     "Under one year of employment needs compensating factors."),
    ("employment_unknown", "purpose_term", 14, "review", "emp_length = 'Unknown'",
     "Unknown employment history increases the risk assessment."),
]


def _q(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _in_list(values) -> str:
    return ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values)


RAW = f"raw AS ({fixture_sql()})"

STG = """stg AS (
  SELECT loan_id, loan_amnt,
         CASE WHEN term LIKE '%36%' THEN 36 WHEN term LIKE '%60%' THEN 60 ELSE NULL END AS term_months,
         int_rate, installment, grade, sub_grade, annual_inc, dti, emp_length,
         fico_range_low, fico_range_high, open_acc, pub_rec, revol_bal, revol_util,
         total_acc, mort_acc, pub_rec_bankruptcies, home_ownership, purpose, loan_status
  FROM raw
  WHERE loan_amnt IS NOT NULL AND annual_inc IS NOT NULL AND annual_inc > 0
    AND loan_status IN ('Fully Paid', 'Charged Off'))"""

GRADE_CASE = ("CASE grade " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in GRADE_CODES.items())
              + " ELSE 4 END")

# FIXED VALUES: the substring cascade in order.
EMP_LIKE_CASE = """CASE WHEN emp_length LIKE '%10+%' THEN 10 WHEN emp_length LIKE '%9%' THEN 9
  WHEN emp_length LIKE '%8%' THEN 8 WHEN emp_length LIKE '%7%' THEN 7 WHEN emp_length LIKE '%6%' THEN 6
  WHEN emp_length LIKE '%5%' THEN 5 WHEN emp_length LIKE '%4%' THEN 4 WHEN emp_length LIKE '%3%' THEN 3
  WHEN emp_length LIKE '%2%' THEN 2 WHEN emp_length LIKE '%1%' THEN 1 ELSE 0 END"""


def _flags(col: str, values, prefix: str, lower: bool = False) -> str:
    return ",\n  ".join(
        f"CASE WHEN {col} = {_q(v)} THEN 1 ELSE 0 END AS {prefix}{v.lower() if lower else v}"
        for v in values)


FEAT = f"""feat AS (
  SELECT loan_id, loan_amnt, term_months AS term, int_rate, installment,
  {GRADE_CASE} AS grade_encoded,
  annual_inc, dti,
  {EMP_LIKE_CASE} AS emp_length_years,
  fico_range_low, fico_range_high, open_acc,
  coalesce(pub_rec, 0) AS pub_rec, revol_bal, coalesce(revol_util, 0.0) AS revol_util, total_acc,
  coalesce(mort_acc, 0) AS mort_acc, coalesce(pub_rec_bankruptcies, 0) AS pub_rec_bankruptcies,
  {_flags('home_ownership', HOME_VALUES, 'home_ownership_', True)},
  {_flags('purpose', PURPOSE_VALUES, 'purpose_')},
  CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target
  FROM stg)"""

# FIXED VALUES: the mart's columns in order.
_MART_COLS = """loan_amnt, term, int_rate, installment, grade_encoded AS grade, annual_inc, dti,
  emp_length_years AS emp_length, fico_range_low, fico_range_high, open_acc, pub_rec, revol_bal,
  revol_util, total_acc, mort_acc, pub_rec_bankruptcies, home_ownership_mortgage, home_ownership_none,
  home_ownership_other, home_ownership_own, home_ownership_rent, purpose_credit_card,
  purpose_debt_consolidation, purpose_educational, purpose_home_improvement, purpose_house,
  purpose_major_purchase, purpose_medical, purpose_moving, purpose_other, purpose_renewable_energy,
  purpose_small_business, purpose_vacation, purpose_wedding, target"""

MART = f"""mart AS (
  SELECT loan_id, {_MART_COLS}
  FROM feat WHERE loan_amnt > 0 AND annual_inc > 0 AND dti >= 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- application-side building blocks --------------------------------------

APPS = """apps AS (
  SELECT loan_id AS app_id, loan_amnt, trim(term) AS term, int_rate, installment, grade, sub_grade,
         annual_inc, dti, emp_length, fico_range_low AS fico, home_ownership, purpose, open_acc,
         pub_rec, revol_bal, revol_util, total_acc, mort_acc, pub_rec_bankruptcies
  FROM raw)"""

SUB_GRADE_CASE = ("CASE sub_grade " + " ".join(
    f"WHEN {_q(k)} THEN {35 - n}" for n, k in enumerate(SUB_GRADES)) + " ELSE 18 END")
EMP_MAP_CASE = ("CASE emp_length " + " ".join(
    f"WHEN {_q(k)} THEN {float(v)}" for k, v in EMP_YEARS.items()) + " ELSE 0.0 END")

# serving features (36, canonical order), from apps
SERVE = f"""serve AS (
  SELECT app_id,
  CAST(loan_amnt AS DOUBLE) AS loan_amnt,
  CAST(CASE WHEN term IS NOT DISTINCT FROM '36 months' THEN 36 ELSE 60 END AS DOUBLE) AS term,
  CAST(int_rate AS DOUBLE) AS int_rate, CAST(installment AS DOUBLE) AS installment,
  CAST({GRADE_CASE} AS DOUBLE) AS grade,
  CAST({SUB_GRADE_CASE} AS DOUBLE) AS sub_grade,
  CAST(annual_inc AS DOUBLE) AS annual_inc, CAST(dti AS DOUBLE) AS dti,
  CAST({EMP_MAP_CASE} AS DOUBLE) AS emp_length,
  CAST(fico AS DOUBLE) AS fico_range_low, CAST(fico + 4 AS DOUBLE) AS fico_range_high,
  CAST(open_acc AS DOUBLE) AS open_acc, CAST(pub_rec AS DOUBLE) AS pub_rec,
  CAST(revol_bal AS DOUBLE) AS revol_bal, CAST(revol_util AS DOUBLE) AS revol_util,
  CAST(total_acc AS DOUBLE) AS total_acc, CAST(mort_acc AS DOUBLE) AS mort_acc,
  CAST(pub_rec_bankruptcies AS DOUBLE) AS pub_rec_bankruptcies,
  {", ".join(f"CAST(CASE WHEN home_ownership = {_q(v)} THEN 1 ELSE 0 END AS DOUBLE) AS home_ownership_{v}" for v in HOME_VALUES)},
  {", ".join(f"CAST(CASE WHEN purpose = {_q(v)} THEN 1 ELSE 0 END AS DOUBLE) AS purpose_{v}" for v in PURPOSE_VALUES)}
  FROM apps)"""


def _violations_sql() -> str:
    parts = []
    for name in REQUEST_FIELDS:
        parts.append(f"CASE WHEN {name} IS NULL THEN '{name}:missing' END")
        if name in APPLICATION_BOUNDS:
            lo, hi = APPLICATION_BOUNDS[name]
            parts.append(f"CASE WHEN NOT ({name} BETWEEN {lo} AND {hi}) THEN '{name}:range' END")
        if name in APPLICATION_ENUMS:
            parts.append(
                f"CASE WHEN {name} NOT IN ({_in_list(APPLICATION_ENUMS[name])}) THEN '{name}:value' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


CHECKED = f"""checked AS (
  SELECT apps.*, {_violations_sql()} AS violations FROM apps)"""

QUESTION = """'A loan application has been DENIED. Applicant details: Loan amount: $' || format('{:,}', loan_amnt)
  || ', Term: ' || term || ', Credit grade: ' || grade || ' (' || sub_grade || '), FICO: ' || CAST(fico AS VARCHAR)
  || ', Annual income: $' || format('{:,}', annual_inc) || ', DTI: ' || CAST(dti AS VARCHAR)
  || '%, Employment: ' || emp_length || ', Purpose: ' || purpose
  || '. Why was this denied and how can the applicant improve?'"""

# deterministic stand-in for a model score, in [0, 1): exactly 0.5 is reachable
SCORE_EXPR = "((7 - ({grade})) * 10 + coalesce(dti, 0) + 1) / 122.0"


def _stmt_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["default_rate_by_grade"] = with_(RAW, STG) + f"""
SELECT {GRADE_CASE} AS grade_code, count(*) AS n_loans,
       CAST(sum(CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END) AS BIGINT) AS n_defaults,
       round(avg(CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END), 6) AS default_rate
FROM stg GROUP BY 1"""
    # sources
    q["scan_loans_csv"] = with_(RAW) + "SELECT * FROM raw"
    q["load_validation"] = with_(RAW) + """
SELECT count(*) AS n_rows, 23 AS n_columns, true AS has_loan_amnt, count(*) > 0 AS passed FROM raw"""
    q["load_profile"] = with_(RAW) + """
SELECT count(*) AS n_rows, 23 AS n_columns,
 'loan_id,loan_amnt,term,int_rate,installment,grade,sub_grade,annual_inc,dti,emp_length,fico_range_low,fico_range_high,open_acc,pub_rec,revol_bal,revol_util,total_acc,mort_acc,pub_rec_bankruptcies,home_ownership,purpose,loan_status,issue_d' AS columns
FROM raw"""
    q["scan_applications"] = with_(RAW, APPS) + "SELECT * FROM apps"
    q["scan_policies"] = "SELECT item_id, text, true AS has_path FROM benchmark"
    type_case = _violations_sql().replace("CASE WHEN fico IS NULL THEN 'fico:missing' END",
                                          "CASE WHEN fico IS NULL THEN 'fico:missing' WHEN odd THEN 'fico:type' END"
                                          ).replace("NOT (fico BETWEEN", "NOT odd AND NOT (fico BETWEEN")
    q["reject_records"] = with_(RAW, APPS, "f AS (SELECT *, app_id % 11 = 0 AS odd FROM apps)") + f"""
SELECT CASE WHEN app_id % 13 <> 0 THEN app_id END AS app_id,
       CASE WHEN app_id % 13 = 0 THEN 'record:malformed' ELSE array_to_string({type_case}, ',') END AS violations,
       true AS has_record
FROM f"""
    q["reject_loans"] = with_(RAW) + """
, p AS (SELECT loan_id, annual_inc, loan_id % 19 = 0 AS short,
               list_filter([CASE WHEN loan_id % 13 = 0 THEN 'annual_inc:type' END, CASE WHEN loan_id % 17 = 0 THEN 'issue_d:type' END],
                           lambda x: x IS NOT NULL) AS found FROM raw)
SELECT loan_id, CASE WHEN short THEN 'record:malformed' ELSE array_to_string(found, ',') END AS problems, short AS has_record,
       CASE WHEN NOT short AND len(found) = 0 THEN annual_inc END AS annual_inc FROM p"""
    # SQL pipeline
    q["stg_project"] = with_(RAW) + """
SELECT loan_id, loan_amnt,
       CASE WHEN term LIKE '%36%' THEN 36 WHEN term LIKE '%60%' THEN 60 END AS term_months,
       int_rate, installment, grade, sub_grade, annual_inc, dti, emp_length,
       fico_range_low, fico_range_high, open_acc, pub_rec, revol_bal, revol_util,
       total_acc, mort_acc, pub_rec_bankruptcies, home_ownership, purpose, loan_status
FROM raw"""
    q["stg_filter"] = with_(RAW) + """
SELECT * FROM raw WHERE loan_amnt IS NOT NULL AND annual_inc IS NOT NULL AND annual_inc > 0
  AND loan_status IN ('Fully Paid', 'Charged Off')"""
    q["completed_loans"] = with_(RAW) + """
SELECT * FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off')"""
    q["mart_filter"] = with_(RAW, STG, FEAT) + """
SELECT * FROM feat WHERE loan_amnt > 0 AND annual_inc > 0 AND dti >= 0"""
    q["mart_project"] = with_(RAW, STG, FEAT) + f"SELECT loan_id, {_MART_COLS} FROM feat"
    q["build_layers"] = with_(RAW, STG, FEAT, MART) + "SELECT * FROM mart"
    q["label_target"] = with_(RAW) + """
SELECT loan_id, loan_status, CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target FROM raw"""
    # encoders
    q["term_like"] = with_(RAW) + """
SELECT loan_id, term, CASE WHEN term LIKE '%36%' THEN 36 WHEN term LIKE '%60%' THEN 60 END AS term_months
FROM raw"""
    q["term_contains"] = with_(RAW) + """
SELECT loan_id, term, CASE WHEN coalesce(contains(term, '36'), false) THEN 36 ELSE 60 END AS term_months
FROM raw"""
    q["term_exact"] = with_(RAW, APPS) + """
SELECT app_id, term, CASE WHEN term IS NOT DISTINCT FROM '36 months' THEN 36 ELSE 60 END AS term_months
FROM apps"""
    q["grade_ordinal"] = with_(RAW) + f"SELECT loan_id, grade, {GRADE_CASE} AS grade_code FROM raw"
    q["sub_grade_ordinal"] = with_(RAW) + (
        f"SELECT loan_id, sub_grade, {SUB_GRADE_CASE} AS sub_grade_code FROM raw")
    q["emp_length_like"] = with_(RAW) + (
        f"SELECT loan_id, emp_length, {EMP_LIKE_CASE} AS emp_years FROM raw")
    q["emp_length_map"] = with_(RAW) + (
        f"SELECT loan_id, emp_length, CAST({EMP_MAP_CASE} AS DOUBLE) AS emp_years FROM raw")
    q["null_defaults"] = with_(RAW) + """
SELECT loan_id, coalesce(pub_rec, 0) AS pub_rec, coalesce(revol_util, 0.0) AS revol_util,
       coalesce(mort_acc, 0) AS mort_acc, coalesce(pub_rec_bankruptcies, 0) AS pub_rec_bankruptcies
FROM raw"""
    q["one_hot_home"] = with_(RAW) + (
        f"SELECT loan_id, home_ownership, {_flags('home_ownership', HOME_VALUES, 'home_ownership_')} FROM raw")
    q["one_hot_purpose"] = with_(RAW) + (
        f"SELECT loan_id, purpose, {_flags('purpose', PURPOSE_VALUES, 'purpose_')} FROM raw")
    # data quality
    dq_rows = """
SELECT 'stg_loans' AS model, 'loan_amnt' AS column_name, 'not_null' AS "check", count_if(loan_amnt IS NULL) AS failures FROM stg
UNION ALL SELECT 'stg_loans', 'annual_inc', 'not_null', count_if(annual_inc IS NULL) FROM stg
UNION ALL SELECT 'stg_loans', 'grade', 'not_null', count_if(grade IS NULL) FROM stg
UNION ALL SELECT 'stg_loans', 'grade', 'accepted_values', count(*) FROM stg WHERE grade NOT IN ('A','B','C','D','E','F','G')
UNION ALL SELECT 'stg_loans', 'loan_status', 'not_null', count_if(loan_status IS NULL) FROM stg
UNION ALL SELECT 'stg_loans', 'loan_status', 'accepted_values', count(*) FROM stg WHERE loan_status NOT IN ('Fully Paid', 'Charged Off')
UNION ALL SELECT 'int_loan_features', 'target', 'not_null', count_if(target IS NULL) FROM feat
UNION ALL SELECT 'int_loan_features', 'target', 'accepted_values', count(*) FROM feat WHERE target NOT IN (0, 1)
UNION ALL SELECT 'int_loan_features', 'grade_encoded', 'not_null', count_if(grade_encoded IS NULL) FROM feat
UNION ALL SELECT 'int_loan_features', 'loan_amnt', 'not_null', count_if(loan_amnt IS NULL) FROM feat
UNION ALL SELECT 'mart_training', 'target', 'not_null', count_if(target IS NULL) FROM mart
UNION ALL SELECT 'mart_training', 'loan_amnt', 'not_null', count_if(loan_amnt IS NULL) FROM mart
UNION ALL SELECT 'mart_training', 'dti', 'not_null', count_if(dti IS NULL) FROM mart"""
    dq = with_(RAW, STG, FEAT, MART, f"dq AS ({dq_rows})")
    sel = 'SELECT model, column_name, "check", CAST(failures AS BIGINT) AS failures, failures = 0 AS passed FROM dq'
    q["dq_report"] = dq + sel
    q["dq_not_null"] = dq + sel + " WHERE \"check\" = 'not_null'"
    q["dq_accepted_values"] = dq + sel + " WHERE \"check\" = 'accepted_values'"
    q["rows_dropped"] = with_(RAW) + """
SELECT count(*) AS initial_rows,
       CAST(count_if(coalesce(loan_status IN ('Fully Paid', 'Charged Off'), false)) AS BIGINT) AS kept_rows,
       CAST(count_if(NOT coalesce(loan_status IN ('Fully Paid', 'Charged Off'), false)) AS BIGINT) AS dropped_rows
FROM raw"""
    q["target_distribution"] = with_(RAW) + """
SELECT CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target, count(*) AS n_rows
FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off') GROUP BY 1"""
    # applications
    q["fico_range"] = with_(RAW, APPS) + (
        "SELECT app_id, fico AS fico_range_low, fico + 4 AS fico_range_high FROM apps")
    q["serving_project"] = with_(RAW, APPS, SERVE) + "SELECT * FROM serve"
    q["validate_ranges"] = with_(RAW, APPS) + "SELECT app_id, " + ", ".join(
        f"{n} BETWEEN {lo} AND {hi} AS ok_{n}" for n, (lo, hi) in APPLICATION_BOUNDS.items()
    ) + " FROM apps"
    q["validate_enums"] = with_(RAW, APPS) + "SELECT app_id, " + ", ".join(
        f"{n} IN ({_in_list(v)}) AS ok_{n}" for n, v in (APPLICATION_ENUMS | {"sub_grade": SUB_GRADES}).items()
    ) + " FROM apps"
    q["split_rejects"] = with_(RAW, APPS, CHECKED) + """
SELECT app_id, len(violations) = 0 AS is_valid, CAST(len(violations) AS INTEGER) AS n_violations,
       array_to_string(violations, ',') AS violations
FROM checked"""
    scored = f"""scored AS (
  SELECT apps.*, {SCORE_EXPR.format(grade=GRADE_CASE)} AS default_risk FROM apps)"""
    q["decision"] = with_(RAW, APPS, scored) + """
SELECT app_id, default_risk, CASE WHEN default_risk > 0.5 THEN 'DENIED' ELSE 'APPROVED' END AS decision,
       CAST(default_risk > 0.5 AS INTEGER) AS prediction
FROM scored"""
    q["denied_only"] = with_(RAW, APPS, scored) + """
SELECT app_id, default_risk, 'DENIED' AS decision FROM scored WHERE default_risk > 0.5"""
    q["risk_display"] = with_(RAW, APPS, scored) + """
SELECT app_id, default_risk, printf('%.1f%%', round_even(default_risk * 100, 1)) AS risk_text FROM scored"""
    q["money_display"] = with_(RAW, APPS) + """
SELECT app_id, format('{:,}', loan_amnt) AS loan_amnt_text, format('{:,}', annual_inc) AS annual_inc_text
FROM apps"""
    q["question_text"] = with_(RAW, APPS, CHECKED) + f"""
SELECT app_id, {QUESTION} AS question
FROM checked WHERE len(violations) = 0"""
    q.update(_model_side_queries())
    q.update(_text_queries(scored))
    return q


def _terms(table: str, id_col: str) -> str:
    return f"""SELECT {id_col}, term, count(*) AS tf FROM (
      SELECT {id_col}, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM {table})
    WHERE term <> '' GROUP BY {id_col}, term"""


TFIDF = f"""dt AS ({_terms('documents', 'doc_id')}),
nd AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
dw AS (SELECT doc_id, dt.term, tf * ln((n + 1.0) / (df + 1)) AS wd FROM dt JOIN dfq USING (term), nd),
dn AS (SELECT doc_id, sqrt(CAST(sum(CAST(wd * wd AS DECIMAL(38,15))) AS DOUBLE)) AS dnorm FROM dw GROUP BY doc_id),
qt AS ({_terms('benchmark', 'item_id')}),
qw AS (SELECT item_id, qt.term, tf * ln((n + 1.0) / (coalesce(df, 0) + 1)) AS wq
       FROM qt LEFT JOIN dfq USING (term), nd),
qn AS (SELECT item_id, sqrt(CAST(sum(CAST(wq * wq AS DECIMAL(38,15))) AS DOUBLE)) AS qnorm FROM qw GROUP BY item_id),
dots AS (SELECT item_id, doc_id, CAST(sum(CAST(wq * wd AS DECIMAL(38,15))) AS DOUBLE) AS dot
         FROM qw JOIN dw USING (term) GROUP BY item_id, doc_id),
sc AS (SELECT item_id, doc_id, CASE WHEN qnorm * dnorm > 0 THEN dot / (qnorm * dnorm) ELSE 0 END AS score
       FROM dots JOIN qn USING (item_id) JOIN dn USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc),
hits AS (SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 3),
ctx AS (SELECT item_id, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS context
        FROM hits JOIN documents d USING (doc_id) GROUP BY item_id)"""


def _text_queries(scored_cte: str) -> dict[str, str]:
    q: dict[str, str] = {}
    q["nearest_chunks"] = """
WITH p AS (
  SELECT a.vec_id AS vec_id, b.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(a.embedding, b.embedding),
               lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS d2
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbor_id) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d2, 4) AS d2 FROM r WHERE rank <= 3"""
    q["retrieve_tfidf"] = with_(TFIDF) + "SELECT * FROM hits"
    changed = """changed AS (
  SELECT doc_id, CASE WHEN n_chars % 2 = 1 THEN concat_ws(' ', text, lang) ELSE text END AS text
  FROM documents d WHERE doc_id = (SELECT min(e.doc_id) FROM documents e WHERE e.text = d.text)
  UNION ALL SELECT -1 - item_id, text FROM benchmark)"""
    q["index_deltas"] = with_(changed, TFIDF.replace("documents", "changed")) + "SELECT * FROM hits"
    letters = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")
    q["embedded_context"] = f"""
WITH d AS (SELECT doc_id, text, [{letters}] AS v FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT item_id, [{letters}] AS v FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
p AS (SELECT item_id, doc_id, text, list_sum(list_transform(list_zip(b.v, d.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM b, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d2, doc_id) AS rank FROM p QUALIFY rank <= 3)
SELECT item_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_sha256,
       string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS nearest FROM r GROUP BY item_id"""
    q["context_text"] = with_(TFIDF) + "SELECT item_id, context FROM ctx"
    q["prompt_messages"] = with_(TFIDF) + f"""
SELECT item_id, 0 AS position, 'system' AS role, {_q(SYSTEM_HEAD)} || coalesce(context, '') || {_q(SYSTEM_TAIL)} AS content
FROM benchmark LEFT JOIN ctx USING (item_id)
UNION ALL
SELECT item_id, 1 AS position, 'human' AS role, text AS content FROM benchmark"""
    rules = "\nUNION ALL\n".join(
        f"SELECT app_id, {_q(rid)} AS rule_id, {_q(pol)} AS policy, {line} AS line, {_q(sev)} AS severity, "
        f"{_q(text)} AS reason FROM denied WHERE {pred}"
        for rid, pol, line, sev, pred, text in POLICY_RULES)
    q["policy_reasons"] = with_(RAW, APPS, scored_cte, "denied AS (SELECT * FROM scored WHERE default_risk > 0.5)") + rules
    return q


SPLIT = """keyed AS (SELECT loan_id, target, grade, dti, (loan_id * 2654435761) % 1000003 AS k FROM mart),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY k, loan_id) AS rn,
                  count(*) OVER (PARTITION BY target) AS n FROM keyed),
split AS (SELECT loan_id, target, grade, dti,
                 CASE WHEN rn <= floor(0.2 * n) THEN 'test' ELSE 'train' END AS fold FROM ranked)"""
TEST = """test AS (SELECT loan_id, target, ((7 - grade) * 10 + coalesce(dti, 0) + 1) / 122.0 AS score
                  FROM split WHERE fold = 'test')"""
AUC = """ar AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk
        FROM test),
aa AS (SELECT sum(CASE WHEN target = 1 THEN rnk ELSE 0 END) AS rs, count_if(target = 1) AS n1,
              count_if(target = 0) AS n0 FROM ar),
auc AS (SELECT round(CAST((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS DOUBLE), 4) AS auc_roc FROM aa)"""
ACC = """acc AS (SELECT round(avg(CASE WHEN CAST(score > 0.5 AS INTEGER) = target THEN 1.0 ELSE 0.0 END), 4)
               AS accuracy FROM test)"""

DRIFT_FEATURES = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "fico", "open_acc",
                  "pub_rec", "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies"]


def _long_contributions() -> str:
    cols = ", ".join(FEATURE_ORDER)
    pos = ", ".join(f"({_q(n)}, {j})" for j, n in enumerate(FEATURE_ORDER))
    return f"""lc AS (SELECT * FROM serve UNPIVOT INCLUDE NULLS (value FOR feature IN ({cols}))),
posmap AS (SELECT * FROM (VALUES {pos}) t(feature, pos)),
c AS (SELECT app_id, pos, lc.feature, value,
             CAST(((app_id * (pos + 3)) % 17 - 8) AS DOUBLE) / 4.0 AS shap
      FROM lc JOIN posmap USING (feature)),
rk AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY abs(shap) DESC, pos) AS step FROM c)"""


def _model_side_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    base = with_(RAW, STG, FEAT, MART, SPLIT)
    q["stratified_split"] = base + "SELECT loan_id, target, fold FROM split"
    q["dataset_sizes"] = base + """
SELECT CAST(count_if(fold = 'train') AS BIGINT) AS train_size, CAST(count_if(fold = 'test') AS BIGINT) AS test_size,
       35 AS n_features FROM split"""
    q["auc_roc"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST, AUC) + "SELECT auc_roc FROM auc"
    q["accuracy"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST, ACC) + "SELECT accuracy FROM acc"
    q["confusion"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST) + """
SELECT tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall
FROM (SELECT CAST(count_if(score > 0.5 AND target = 1) AS BIGINT) AS tp,
             CAST(count_if(score > 0.5 AND target <> 1) AS BIGINT) AS fp,
             CAST(count_if(score <= 0.5 AND target <> 1) AS BIGINT) AS tn,
             CAST(count_if(score <= 0.5 AND target = 1) AS BIGINT) AS fn
      FROM test)"""
    q["evaluation_gate"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST, AUC, ACC) + """
SELECT auc_roc, accuracy, 0.75::DOUBLE AS auc_threshold, coalesce(auc_roc >= 0.75, false) AS passed,
       CASE WHEN auc_roc >= 0.75 THEN 'SUCCESS' ELSE 'FAILED' END AS status
FROM auc, acc"""
    curve = """, counted AS (SELECT score AS threshold, count_if(target = 1) AS pos, count_if(target <> 1) AS neg FROM test GROUP BY score),
summed AS (SELECT threshold, coalesce(sum(pos) OVER w, 0)::BIGINT AS tp, coalesce(sum(neg) OVER w, 0)::BIGINT AS fp,
                  (sum(pos) OVER ())::BIGINT AS p, (sum(neg) OVER ())::BIGINT AS n
           FROM counted WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
curve AS (SELECT threshold, tp, fp, n - fp AS tn, p - tp AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision,
                 round(tp / nullif(p, 0), 6) AS recall, round(fp / nullif(n, 0), 6) AS false_positive_rate FROM summed)
"""
    q["threshold_curve"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST) + curve + "SELECT * FROM curve"
    chosen = [f"(SELECT 'recall' AS rule, {r}::DOUBLE AS value, * FROM curve WHERE tp >= {r}::DOUBLE * (tp + fn) "
              "ORDER BY threshold DESC LIMIT 1)" for r in (0.5, 0.82, 0.95)]
    chosen += [f"(SELECT 'cost' AS rule, {c}::DOUBLE AS value, * FROM curve ORDER BY {c}::DOUBLE * fn + fp, threshold DESC LIMIT 1)"
               for c in (1, 5)]
    q["threshold_choice"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST) + curve + " UNION ALL ".join(chosen)
    q["threshold_sweep"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST) + """
, th AS (SELECT CAST(i * 0.05 AS DOUBLE) AS threshold FROM range(0, 21) t(i)),
cnt AS (SELECT threshold,
          CAST(count_if(score > threshold AND target = 1) AS BIGINT) AS tp,
          CAST(count_if(score > threshold AND target <> 1) AS BIGINT) AS fp,
          CAST(count_if(score <= threshold AND target <> 1) AS BIGINT) AS tn,
          CAST(count_if(score <= threshold AND target = 1) AS BIGINT) AS fn
        FROM th, test GROUP BY threshold)
SELECT threshold, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 4) AS precision,
       round(tp / nullif(tp + fn, 0), 4) AS recall FROM cnt"""
    bounds = ", ".join(f"({_q(f)}, {float(APPLICATION_BOUNDS[f][0])}::DOUBLE, {float(APPLICATION_BOUNDS[f][1])}::DOUBLE)"
                       for f in DRIFT_FEATURES)
    feats = ", ".join(f"CAST({'fico_range_low' if f == 'fico' else f} AS DOUBLE) AS {f}" for f in DRIFT_FEATURES)
    q["drift_sketches"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({_q(f)}, true, true, true)" for f in DRIFT_FEATURES) + ") t(feature, edges_in_bound, shares_whole, psi_not_negative)"
    streamed = ["loan_amnt", "int_rate", "annual_inc", "dti", "revol_util"]
    q["drift_stream"] = with_(RAW) + f"""
, d AS (SELECT DATE '1970-01-01' + CAST((issue_d - DATE '1970-01-01') // 28 * 28 AS INTEGER) AS window_start, issue_d,
               {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in streamed)} FROM raw WHERE issue_d IS NOT NULL),
closed AS (SELECT * EXCLUDE (issue_d) FROM d WHERE window_start + 28 <= (SELECT max(issue_d) - 14 FROM d)),
lg AS (SELECT * FROM closed UNPIVOT INCLUDE NULLS (x FOR feature IN ({", ".join(streamed)}))),
b AS (SELECT * FROM (VALUES {bounds}) t(feature, lo, hi))
SELECT window_start, lg.feature, CASE WHEN x IS NULL THEN -1 WHEN x < lo THEN -2 WHEN x > hi THEN 10
         ELSE CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INTEGER) END AS bin, count(*) AS n
FROM lg JOIN b USING (feature) GROUP BY ALL"""
    q["feature_drift"] = with_(RAW) + f"""
, d AS (SELECT CASE WHEN issue_d < DATE '1995-06-01' THEN 'base' ELSE 'current' END AS period, {feats} FROM raw),
lg AS (SELECT * FROM d UNPIVOT INCLUDE NULLS (x FOR feature IN ({", ".join(DRIFT_FEATURES)}))),
b AS (SELECT * FROM (VALUES {bounds}) t(feature, lo, hi)),
binned AS (SELECT lg.feature, period,
             CASE WHEN x IS NULL THEN -1 WHEN x < lo THEN -2 WHEN x > hi THEN 10
                  ELSE CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INTEGER) END AS bin
           FROM lg JOIN b USING (feature)),
cnt AS (SELECT feature, bin, count_if(period = 'base') AS n_base, count_if(period = 'current') AS n_cur
        FROM binned GROUP BY feature, bin),
sh AS (SELECT feature,
              greatest(n_base / sum(n_base) OVER (PARTITION BY feature), 1e-4) AS p,
              greatest(n_cur / sum(n_cur) OVER (PARTITION BY feature), 1e-4) AS q
       FROM cnt)
SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi, count(*) AS n_bins FROM sh GROUP BY feature"""
    homes = ["ANY", "MORTGAGE", "NONE", "OTHER", "OWN", "RENT"]
    purposes = sorted(PURPOSE_VALUES + ["car"])
    flags = ", ".join([f"coalesce(home_ownership = {_q(v)}, false) AS home_ownership_{v}" for v in homes]
                      + [f"coalesce(purpose = {_q(v)}, false) AS purpose_{v}" for v in purposes])
    q["one_hot_dynamic"] = with_(RAW) + f"""
SELECT loan_id, {flags} FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off')"""
    q["one_hot_sparse"] = with_(RAW) + """
, c AS (SELECT loan_id, home_ownership, purpose, CAST(issue_d AS VARCHAR) AS issue_d FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off')),
v AS (SELECT 0 AS k, home_ownership AS v FROM c UNION SELECT 1, purpose FROM c UNION SELECT 2, issue_d FROM c),
d AS (SELECT k, v, row_number() OVER (ORDER BY k, v) - 1 AS n FROM v WHERE v IS NOT NULL)
SELECT loan_id, array_to_string(list_sort(list_filter([h.n, p.n, i.n], lambda x: x IS NOT NULL)), ',') AS flags
FROM c LEFT JOIN d h ON h.k = 0 AND h.v = home_ownership LEFT JOIN d p ON p.k = 1 AND p.v = purpose
LEFT JOIN d i ON i.k = 2 AND i.v = issue_d"""
    q["numeric_columns"] = with_(RAW) + f"""
SELECT loan_id, loan_amnt,
  CASE WHEN coalesce(contains(term, '36'), false) THEN 36 ELSE 60 END AS term,
  int_rate, installment, CAST({GRADE_CASE} AS DOUBLE) AS grade, CAST({SUB_GRADE_CASE} AS DOUBLE) AS sub_grade,
  annual_inc, dti, CAST({EMP_MAP_CASE} AS DOUBLE) AS emp_length, fico_range_low, fico_range_high, open_acc,
  coalesce(pub_rec, 0) AS pub_rec, revol_bal, coalesce(revol_util, 0.0) AS revol_util, total_acc,
  coalesce(mort_acc, 0) AS mort_acc, coalesce(pub_rec_bankruptcies, 0) AS pub_rec_bankruptcies,
  CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target
FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off')"""
    contrib = with_(RAW, APPS, SERVE, _long_contributions())
    q["top_features"] = contrib + """
SELECT app_id, CAST(step AS INTEGER) AS rank, feature, value, shap FROM rk WHERE step <= 10"""
    q["waterfall_steps"] = contrib + """
, s AS (SELECT *, -0.5 + coalesce(sum(shap) OVER (PARTITION BY app_id ORDER BY step
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rk)
SELECT app_id, CAST(step AS INTEGER) AS step, feature, shap, round(start, 6) AS start,
       round(start + shap, 6) AS "end", CASE WHEN shap >= 0 THEN 'increase' ELSE 'decrease' END AS direction
FROM s"""
    return q


TRAINING = f"""training AS (
  SELECT loan_id, CAST(loan_amnt AS DOUBLE) AS loan_amnt,
  CAST(CASE WHEN coalesce(contains(term, '36'), false) THEN 36 ELSE 60 END AS DOUBLE) AS term,
  CAST(int_rate AS DOUBLE) AS int_rate, CAST(installment AS DOUBLE) AS installment,
  CAST({GRADE_CASE} AS DOUBLE) AS grade, CAST({SUB_GRADE_CASE} AS DOUBLE) AS sub_grade,
  CAST(annual_inc AS DOUBLE) AS annual_inc, CAST(dti AS DOUBLE) AS dti,
  CAST({EMP_MAP_CASE} AS DOUBLE) AS emp_length,
  CAST(fico_range_low AS DOUBLE) AS fico_range_low, CAST(fico_range_high AS DOUBLE) AS fico_range_high,
  CAST(open_acc AS DOUBLE) AS open_acc, CAST(coalesce(pub_rec, 0) AS DOUBLE) AS pub_rec,
  CAST(revol_bal AS DOUBLE) AS revol_bal, CAST(coalesce(revol_util, 0) AS DOUBLE) AS revol_util,
  CAST(total_acc AS DOUBLE) AS total_acc, CAST(coalesce(mort_acc, 0) AS DOUBLE) AS mort_acc,
  CAST(coalesce(pub_rec_bankruptcies, 0) AS DOUBLE) AS pub_rec_bankruptcies,
  {", ".join(f"CAST(CASE WHEN home_ownership = {_q(v)} THEN 1 ELSE 0 END AS DOUBLE) AS home_ownership_{v}" for v in HOME_VALUES)},
  {", ".join(f"CAST(CASE WHEN purpose = {_q(v)} THEN 1 ELSE 0 END AS DOUBLE) AS purpose_{v}" for v in PURPOSE_VALUES)},
  CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target
  FROM raw WHERE loan_status IN ('Fully Paid', 'Charged Off'))"""


def _stmt_question() -> str:
    """The valid applications with their question, as the CTE ``asked``."""
    return with_(RAW, APPS, CHECKED) + f", asked AS (SELECT *, {QUESTION} AS question FROM checked WHERE len(violations) = 0)"


def _invariant_queries() -> dict[str, str]:
    """What must hold of the model's and the text steps' output, for every row's key."""
    q: dict[str, str] = {}
    q["assemble_features"] = with_(RAW, TRAINING) + "SELECT * FROM training"
    sizes = with_(RAW, TRAINING, SPLIT.replace("FROM mart)", "FROM training)")) + """
, s AS (SELECT count_if(fold = 'train') AS train_size, count_if(fold = 'test') AS test_size FROM split)"""
    q["train_gbt"] = sizes + """
SELECT CAST(train_size AS BIGINT) AS train_size, CAST(test_size AS BIGINT) AS test_size, 36 AS n_features,
       'SUCCESS' AS status FROM s"""
    q["base_value"] = sizes + "SELECT CAST(train_size AS BIGINT) AS n_rows, true AS is_mean_logit FROM s"
    valid = with_(RAW, APPS, CHECKED)
    q["score_batch"] = valid + """
SELECT app_id, true AS in_range, true AS decision_follows FROM checked WHERE len(violations) = 0"""
    q["contributions"] = valid + """
SELECT app_id, 36 AS n_features, true AS additive FROM checked WHERE len(violations) = 0"""
    q["model_sink"] = q["model_source"] = valid + """
SELECT app_id, true AS same_score FROM checked WHERE len(violations) = 0"""
    q["denial_messages"] = _stmt_question() + f"""
, d AS (SELECT app_id, question FROM asked WHERE {SCORE_EXPR.format(grade=GRADE_CASE)} > 0.5)
SELECT app_id, 0 AS position, 'system' AS role, CAST(NULL AS VARCHAR) AS question, true AS grounded,
       3 AS n_chunks FROM d
UNION ALL SELECT app_id, 1, 'human', question, CAST(NULL AS BOOLEAN), CAST(NULL AS INTEGER) FROM d"""
    q["explain_calls"] = _stmt_question() + f"""
, d AS (SELECT app_id, question, {SCORE_EXPR.format(grade=GRADE_CASE)} > 0.5 AS denied, contains(question, 'Purpose: wedding') AS fails FROM asked)
SELECT app_id, CASE WHEN denied THEN 'DENIED' ELSE 'APPROVED' END AS decision,
       CASE WHEN denied AND NOT fails THEN 'system: ' || (length({_q(SYSTEM_HEAD)}) + length({_q(SYSTEM_TAIL)}) + 5) || ' characters; ' || question END AS explanation,
       CASE WHEN denied AND fails THEN 'no answer for this purpose' END AS explanation_error FROM d"""
    q["score_result"] = q["score_stream"] = valid + """
SELECT app_id, CASE WHEN ok THEN 'SCORED' ELSE 'REJECTED' END AS status, array_to_string(violations, ',') AS violations,
       ok AS has_result, CASE WHEN ok THEN 10 END AS n_top, CASE WHEN ok THEN true END AS top_in_order,
       CASE WHEN ok THEN true END AS explained_if_denied
FROM (SELECT *, len(violations) = 0 AS ok FROM checked)"""
    q["metrics_sink"] = with_(RAW, STG, FEAT, MART, SPLIT, TEST, AUC, ACC) + """
SELECT auc_roc, accuracy, 0.75::DOUBLE AS auc_threshold, coalesce(auc_roc >= 0.75, false) AS passed,
       CASE WHEN auc_roc >= 0.75 THEN 'SUCCESS' ELSE 'FAILED' END AS status, 'run' AS run_ts
FROM auc, acc"""
    with_text = "FROM documents WHERE regexp_matches(text, '\\S')"
    q["chunk_documents"] = f"SELECT doc_id, true AS within_size, true AS covered {with_text}"
    q["embed_chunks"] = f"SELECT doc_id, true AS vectors_ok, true AS has_chunks {with_text}"
    bad = [(pred, text) for _, _, _, sev, pred, text in POLICY_RULES if sev in ("adverse", "review")]
    reasons = ", ".join(f"CASE WHEN {pred} THEN {_q(text)} END" for pred, text in bad)
    q["explain_denials"] = valid + f"""
, s AS (SELECT *, {SCORE_EXPR.format(grade=GRADE_CASE)} AS default_risk,
               list_filter([{reasons}], lambda x: x IS NOT NULL) AS reasons
        FROM checked WHERE len(violations) = 0)
SELECT app_id, CASE WHEN default_risk > 0.5 THEN 'DENIED' ELSE 'APPROVED' END AS decision,
  CASE WHEN default_risk > 0.5 THEN CASE WHEN len(reasons) > 0
    THEN 'The application was denied. Policies that apply: ' || array_to_string(reasons, ' ')
    ELSE 'The application was denied by the risk model; no specific policy rule applies.' END END AS explanation
FROM s"""
    return q


def oracle_statements() -> dict[str, str]:
    return _stmt_queries() | _invariant_queries()
