"""Display formats and the denial question, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import QUESTION_TEMPLATE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_percent(p) -> Column:
    """Probability as a percent with one decimal, e.g. 0.5625 -> '56.2%'.

    Rounds half to even on the value, as Python's percent format does for
    values whose decimal form is exact (Java's own formatter rounds half up).
    """
    return F.format_string("%.1f%%", F.bround(_col(p) * 100, 1))


def money(x) -> Column:
    """Thousands separators for a double, like Python's ``f"{x:,}"``:
    the shortest decimal digits of the value, at least one decimal
    ('10,000.0', '1,234.5', '1,234,567.891').  (Python switches to scientific
    notation below 1e-4, which amounts never reach.)"""
    x = _col(x)
    text = x.cast("string")                      # shortest repr, maybe with an exponent
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.instr(text, "E") > 0,
                      F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    fraction = F.when(F.instr(mantissa, ".") > 0,
                      F.length(F.substring_index(mantissa, ".", -1))).otherwise(F.lit(0))
    return F.call_function("format_number", x, F.greatest(F.lit(1), fraction - exponent))


def question_text(df_cols: dict[str, Column] | None = None) -> Column:
    """The denial question from nine applicant fields (template in schemas)."""
    c = df_cols or {}

    def g(name):
        return c.get(name, F.col(name))

    pieces = {
        "loan_amnt": money(g("loan_amnt")),
        "term": g("term"),
        "grade": g("grade"),
        "sub_grade": g("sub_grade"),
        "fico": g("fico").cast("string"),
        "annual_inc": money(g("annual_inc")),
        "dti": g("dti").cast("string"),
        "emp_length": g("emp_length"),
        "purpose": g("purpose"),
    }
    # split the template on its placeholders and concat literal and column parts
    parts: list[Column] = []
    rest = QUESTION_TEMPLATE
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        if head:
            parts.append(F.lit(head))
        parts.append(pieces[key])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)
