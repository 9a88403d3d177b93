"""Schemas, feature order and the fixed values every encoder shares.

Everything in the block marked FIXED VALUES must stay equal to the
application being rebuilt: the scoring results depend on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference application's constants)
# ---------------------------------------------------------------------------

# Grade ordinal: A is best.  Unknown or null grade -> 4.
GRADE_CODES = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2, "G": 1}
GRADE_DEFAULT = 4

# Sub-grade ordinal: G5 = 1 ... A1 = 35 (rule below).  Unknown -> 18.
SUB_GRADE_LETTERS = "ABCDEFG"
SUB_GRADE_STEPS = 5
SUB_GRADE_DEFAULT = 18

# Employment length, exact map used by training and serving.
EMP_YEARS = {
    "Unknown": 0.0, "< 1 year": 0.5, "1 year": 1.0, "2 years": 2.0,
    "3 years": 3.0, "4 years": 4.0, "5 years": 5.0, "6 years": 6.0,
    "7 years": 7.0, "8 years": 8.0, "9 years": 9.0, "10+ years": 10.0,
}
EMP_DEFAULT = 0.0

# Employment length, substring cascade used by the SQL pipeline (order matters).
EMP_LIKE_CASCADE = [
    ("10+", 10), ("9", 9), ("8", 8), ("7", 7), ("6", 6),
    ("5", 5), ("4", 4), ("3", 3), ("2", 2), ("1", 1),
]

HOME_VALUES = ["MORTGAGE", "NONE", "OTHER", "OWN", "RENT"]
PURPOSE_VALUES = [
    "credit_card", "debt_consolidation", "educational", "home_improvement",
    "house", "major_purchase", "medical", "moving", "other",
    "renewable_energy", "small_business", "vacation", "wedding",
]

COMPLETED_STATUSES = ["Fully Paid", "Charged Off"]
DEFAULT_STATUS = "Charged Off"

# Serving feature order (36 columns).
NUMERIC_FEATURES = [
    "loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade",
    "annual_inc", "dti", "emp_length", "fico_range_low", "fico_range_high",
    "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
    "mort_acc", "pub_rec_bankruptcies",
]
HOME_FEATURES = [f"home_ownership_{v}" for v in HOME_VALUES]
PURPOSE_FEATURES = [f"purpose_{v}" for v in PURPOSE_VALUES]
FEATURE_ORDER = NUMERIC_FEATURES + HOME_FEATURES + PURPOSE_FEATURES

# Training mart: 35 features (no sub_grade, lower-case flags) + target.
MART_NUMERIC = [c for c in NUMERIC_FEATURES if c != "sub_grade"]
MART_FEATURES = (
    MART_NUMERIC
    + [f"home_ownership_{v.lower()}" for v in HOME_VALUES]
    + [f"purpose_{v}" for v in PURPOSE_VALUES]
)
MART_COLUMNS = MART_FEATURES + ["target"]

# Columns that get 0 for null in the SQL pipeline and in training.
NULL_DEFAULT_COLUMNS = {"pub_rec": 0, "revol_util": 0.0, "mort_acc": 0, "pub_rec_bankruptcies": 0}

# Application request: inclusive numeric bounds (13 rules).
APPLICATION_BOUNDS = {
    "loan_amnt": (1000, 40000),
    "int_rate": (5.0, 30.0),
    "installment": (50, 1500),
    "annual_inc": (10000, 300000),
    "dti": (0.0, 60.0),
    "fico": (580, 850),
    "open_acc": (0, 40),
    "pub_rec": (0, 10),
    "revol_bal": (0, 100000),
    "revol_util": (0.0, 100.0),
    "total_acc": (0, 60),
    "mort_acc": (0, 10),
    "pub_rec_bankruptcies": (0, 5),
}

# Application request: accepted values.  The form also offers 35 sub-grades (FORM_ENUMS below).
APPLICATION_ENUMS = {
    "term": ["36 months", "60 months"],
    "grade": ["A", "B", "C", "D", "E", "F", "G"],
    "emp_length": [
        "< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years",
        "6 years", "7 years", "8 years", "9 years", "10+ years", "Unknown",
    ],
    "home_ownership": ["RENT", "MORTGAGE", "OWN", "OTHER"],
    "purpose": [
        "debt_consolidation", "credit_card", "home_improvement", "other",
        "major_purchase", "small_business", "medical", "moving", "vacation",
        "wedding", "house", "renewable_energy", "educational",
    ],
}

DECISION_THRESHOLD = 0.5          # denied iff probability > 0.5 (strict)
AUC_THRESHOLD = 0.75              # gate passes iff round(auc, 4) >= 0.75
TOP_FEATURES = 10
RETRIEVAL_K = 3
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50

# Denial question put to the explanation model.
QUESTION_TEMPLATE = (
    "A loan application has been DENIED. Applicant details: "
    "Loan amount: ${loan_amnt}, Term: {term}, "
    "Credit grade: {grade} ({sub_grade}), "
    "FICO: {fico}, "
    "Annual income: ${annual_inc}, DTI: {dti}%, "
    "Employment: {emp_length}, Purpose: {purpose}. "
    "Why was this denied and how can the applicant improve?"
)

# System message of the explanation prompt; {context} is the retrieved text.
SYSTEM_TEMPLATE = (
    "You are a loan officer assistant explaining why a loan application "
    "was denied. Use the following policy documents to explain the decision "
    "clearly and professionally to the applicant.\n\n"
    "Policy context:\n{context}\n\n"
    "Provide a clear, empathetic explanation referencing specific policies. "
    "Give the applicant actionable advice on how to improve their chances."
)

# ---------------------------------------------------------------------------
# Derived tables
# ---------------------------------------------------------------------------


def sub_grade_codes() -> dict[str, int]:
    """A1 -> 35, A2 -> 34, ..., G5 -> 1."""
    total = len(SUB_GRADE_LETTERS) * SUB_GRADE_STEPS
    codes = {}
    for gi, letter in enumerate(SUB_GRADE_LETTERS):
        for step in range(1, SUB_GRADE_STEPS + 1):
            codes[f"{letter}{step}"] = total - (gi * SUB_GRADE_STEPS + step - 1)
    return codes


# Application form: it also checks the sub-grade against all 35.
FORM_ENUMS = {"sub_grade": sorted(sub_grade_codes())}


# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

LOAN_SCHEMA = T.StructType([
    T.StructField("loan_id", T.LongType()),
    T.StructField("loan_amnt", T.DoubleType()),
    T.StructField("term", T.StringType()),
    T.StructField("int_rate", T.DoubleType()),
    T.StructField("installment", T.DoubleType()),
    T.StructField("grade", T.StringType()),
    T.StructField("sub_grade", T.StringType()),
    T.StructField("annual_inc", T.DoubleType()),
    T.StructField("dti", T.DoubleType()),
    T.StructField("emp_length", T.StringType()),
    T.StructField("fico_range_low", T.LongType()),
    T.StructField("fico_range_high", T.LongType()),
    T.StructField("open_acc", T.LongType()),
    T.StructField("pub_rec", T.LongType()),
    T.StructField("revol_bal", T.DoubleType()),
    T.StructField("revol_util", T.DoubleType()),
    T.StructField("total_acc", T.LongType()),
    T.StructField("mort_acc", T.LongType()),
    T.StructField("pub_rec_bankruptcies", T.LongType()),
    T.StructField("home_ownership", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("loan_status", T.StringType()),
    T.StructField("issue_d", T.DateType()),
])

APPLICATION_FIELDS = [
    ("loan_amnt", T.DoubleType()), ("term", T.StringType()),
    ("int_rate", T.DoubleType()), ("installment", T.DoubleType()),
    ("grade", T.StringType()), ("sub_grade", T.StringType()),
    ("annual_inc", T.DoubleType()), ("dti", T.DoubleType()),
    ("emp_length", T.StringType()), ("fico", T.LongType()),
    ("home_ownership", T.StringType()), ("purpose", T.StringType()),
    ("open_acc", T.LongType()), ("pub_rec", T.LongType()),
    ("revol_bal", T.DoubleType()), ("revol_util", T.DoubleType()),
    ("total_acc", T.LongType()), ("mort_acc", T.LongType()),
    ("pub_rec_bankruptcies", T.LongType()),
]
APPLICATION_SCHEMA = T.StructType(
    [T.StructField("app_id", T.LongType())]
    + [T.StructField(n, t) for n, t in APPLICATION_FIELDS]
)
