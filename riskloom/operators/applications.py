"""Application records: validation, serving features and decisions.

One plan serves batch and stream: validate -> split valid / rejected ->
fico range -> serving encoders -> 36 features in canonical order.  All
narrow, one stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions.display import risk_percent
from ..schemas import (
    APPLICATION_BOUNDS, APPLICATION_ENUMS, APPLICATION_FIELDS, DECISION_THRESHOLD,
    FEATURE_ORDER, FORM_ENUMS, HOME_VALUES, PURPOSE_VALUES,
)


def applications_from_loans(raw: DataFrame) -> DataFrame:
    """Project raw loans into the 19-field request shape (plus ``app_id``)."""
    return raw.select(
        F.col("loan_id").alias("app_id"), "loan_amnt", F.trim("term").alias("term"), "int_rate",
        "installment", "grade", "sub_grade", "annual_inc", "dti", "emp_length",
        F.col("fico_range_low").alias("fico"), "home_ownership", "purpose", "open_acc", "pub_rec",
        "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies",
    )


# --- validation --------------------------------------------------------------

def range_checks(df: DataFrame) -> DataFrame:
    """One boolean per inclusive numeric bound (null when the field is missing)."""
    return df.select("app_id", *[
        F.col(n).between(lo, hi).alias(f"ok_{n}") for n, (lo, hi) in APPLICATION_BOUNDS.items()])


def enum_checks(df: DataFrame) -> DataFrame:
    """One boolean per accept-list, the form's sub-grades included (null when the field is missing)."""
    return df.select("app_id", *[
        F.col(n).isin(*vals).alias(f"ok_{n}") for n, vals in (APPLICATION_ENUMS | FORM_ENUMS).items()])


def violations(given: dict[str, Column] | None = None) -> Column:
    """Array of every broken rule, in field order: missing, type, range, value.

    ``given``: the fields as they came, if their types had to be tried: what was given but has no
    value after the cast has a wrong type.
    """
    rules = []
    for name, _ in APPLICATION_FIELDS:
        col = F.col(name)
        raw = (given or {}).get(name)
        if raw is None:
            rules.append(F.when(col.isNull(), F.lit(f"{name}:missing")))
        else:
            rules.append(F.when(raw.isNull(), F.lit(f"{name}:missing"))
                         .when(col.isNull(), F.lit(f"{name}:type")))
        if name in APPLICATION_BOUNDS:
            lo, hi = APPLICATION_BOUNDS[name]
            rules.append(F.when(~col.between(lo, hi), F.lit(f"{name}:range")))
        if name in APPLICATION_ENUMS:
            rules.append(F.when(~col.isin(*APPLICATION_ENUMS[name]), F.lit(f"{name}:value")))
    return F.array_compact(F.array(*rules))


MALFORMED = "record:malformed"


def checked_records(df: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    """app_id, the typed request fields, all violations and the record itself.

    ``df``: app_id and the fields as strings, ``record`` (the line as it came), and ``corrupt``, not
    null where the line could not be parsed at all.  A malformed record keeps its text and has the
    one reason ``record:malformed``.
    """
    given = [F.col(n).alias(f"_given_{n}") if n in df.columns else F.lit(None).cast("string").alias(f"_given_{n}")
             for n, _ in APPLICATION_FIELDS]
    raw = df.select(F.col("app_id").try_cast("long").alias("app_id"), "record", F.col(corrupt).isNotNull().alias("_bad"),
                    *given)
    typed = raw.withColumns({n: F.col(f"_given_{n}").try_cast(t) for n, t in APPLICATION_FIELDS})
    reasons = violations({n: F.col(f"_given_{n}") for n, _ in APPLICATION_FIELDS})
    return typed.select("app_id", *[n for n, _ in APPLICATION_FIELDS],
                        F.when(F.col("_bad"), F.array(F.lit(MALFORMED))).otherwise(reasons).alias("violations"), "record")


def with_violations(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", violations())


def is_valid() -> Column:
    """Whether no rule is broken: a plain conjunction of null, range and list tests, which reaches the
    scan as a filter.  Never null."""
    tests = [F.col(n).isNotNull() for n, _ in APPLICATION_FIELDS]
    tests += [F.col(n).between(lo, hi) for n, (lo, hi) in APPLICATION_BOUNDS.items()]
    tests += [F.col(n).isin(*vals) for n, vals in APPLICATION_ENUMS.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid by plain filters; only rejects get the array of all their reasons."""
    return df.filter(is_valid()), with_violations(df.filter(~is_valid()))


# --- serving features --------------------------------------------------------

def fico_range(df: DataFrame) -> DataFrame:
    """fico -> fico_range_low = fico, fico_range_high = fico + 4; drop fico."""
    return df.withColumns({
        "fico_range_low": F.col("fico"),
        "fico_range_high": F.col("fico") + F.lit(4),
    }).drop("fico")


def serving_features(apps: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 36 model features (doubles) in canonical order; raw categoricals dropped."""
    d = fico_range(apps)
    enc = {
        "term": E.term_exact("term"),
        "grade": E.grade_ordinal("grade"),
        "sub_grade": E.sub_grade_ordinal("sub_grade"),
        "emp_length": E.emp_length_map("emp_length"),
    }
    for v in HOME_VALUES:
        enc[f"home_ownership_{v}"] = E.one_hot("home_ownership", v)
    for v in PURPOSE_VALUES:
        enc[f"purpose_{v}"] = E.one_hot("purpose", v)
    cols = [enc.get(c, F.col(c)).cast("double").alias(c) for c in FEATURE_ORDER]
    return d.select(*(keep or ["app_id"]), *cols)


# --- decisions ---------------------------------------------------------------

def decide(p) -> Column:
    """'DENIED' iff probability > 0.5 (strict), else 'APPROVED'; without a probability (null or NaN)
    there is no decision."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p.isNull() | F.isnan(p), F.lit(None).cast("string"))
            .when(p > F.lit(DECISION_THRESHOLD), F.lit("DENIED")).otherwise(F.lit("APPROVED")))


def prediction(p) -> Column:
    """1 iff probability > 0.5, null without a probability."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(~F.isnan(p), (p > F.lit(DECISION_THRESHOLD)).cast("int"))


def with_decision(df: DataFrame, prob_col: str = "default_risk") -> DataFrame:
    return df.withColumns({
        "decision": decide(prob_col),
        "prediction": prediction(prob_col),
        "risk_text": risk_percent(prob_col),
    })


def denied_only(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("decision") == "DENIED")


def rule_score(grade_code: Column, dti: Column) -> Column:
    """Deterministic stand-in score in [0, 1) used where a trained model is not
    the point (oracle checks of metrics, decisions, displays)."""
    return ((F.lit(7) - grade_code) * 10 + F.coalesce(dti, F.lit(0.0)) + 1) / F.lit(122.0)


