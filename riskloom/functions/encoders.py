"""Column expressions for the scalar encodings (all JVM-side, no UDFs).

Each function takes a column (name or ``Column``) and returns a
``Column``; they compose into one narrow projection that whole-stage
codegen compiles into a single stage.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (
    EMP_DEFAULT, EMP_LIKE_CASCADE, EMP_YEARS, GRADE_CODES, GRADE_DEFAULT,
    SUB_GRADE_DEFAULT, sub_grade_codes,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(c: Column, table: dict, default, cast: str) -> Column:
    """Exact-match lookup with a default (null -> default).

    Small tables become a CASE chain; larger ones a literal map that
    Catalyst folds into one constant, so the generated code stays small when
    many encoders are fused into one whole-stage-codegen function.
    """
    if len(table) > 8:
        m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(m[c], F.lit(default)).cast(cast)
    items = list(table.items())
    first_k, first_v = items[0]
    expr = F.when(c == F.lit(first_k), F.lit(first_v))
    for k, v in items[1:]:
        expr = expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)).cast(cast)


# --- term (three variants, see SURVEY D1) ---------------------------------

def term_like(c) -> Column:
    """SQL pipeline: contains 36 -> 36, else contains 60 -> 60, else null."""
    c = _col(c)
    return F.when(c.contains("36"), F.lit(36)).when(c.contains("60"), F.lit(60)).cast("int")


def term_contains(c) -> Column:
    """Training: contains 36 -> 36, anything else (null too) -> 60."""
    c = _col(c)
    return F.when(F.coalesce(c.contains("36"), F.lit(False)), F.lit(36)).otherwise(F.lit(60)).cast("int")


def term_exact(c) -> Column:
    """Serving: exactly '36 months' -> 36, anything else -> 60."""
    c = _col(c)
    return F.when(c.eqNullSafe("36 months"), F.lit(36)).otherwise(F.lit(60)).cast("int")


# --- ordinals --------------------------------------------------------------

def grade_ordinal(c) -> Column:
    return _lookup(_col(c), GRADE_CODES, GRADE_DEFAULT, "int")


def sub_grade_ordinal(c) -> Column:
    return _lookup(_col(c), sub_grade_codes(), SUB_GRADE_DEFAULT, "int")


def emp_length_like(c) -> Column:
    """SQL pipeline cascade: first matching substring wins, else 0.

    '< 1 year' contains '1' and so maps to 1 here (SURVEY D2).
    """
    c = _col(c)
    (k0, v0), rest = EMP_LIKE_CASCADE[0], EMP_LIKE_CASCADE[1:]
    expr = F.when(c.contains(k0), F.lit(v0))
    for k, v in rest:
        expr = expr.when(c.contains(k), F.lit(v))
    return expr.otherwise(F.lit(0)).cast("int")


def emp_length_map(c) -> Column:
    """Exact map: '< 1 year' -> 0.5, 'Unknown' and anything else -> 0."""
    return _lookup(_col(c), EMP_YEARS, EMP_DEFAULT, "double")


# --- flags -----------------------------------------------------------------

def one_hot(c, value: str) -> Column:
    """1 when equal, 0 otherwise (null and unknown values give 0)."""
    return F.when(_col(c) == F.lit(value), F.lit(1)).otherwise(F.lit(0)).cast("int")


def one_hot_columns(c, values: list[str], prefix: str) -> list[Column]:
    return [one_hot(c, v).alias(f"{prefix}{v}") for v in values]


def label_target(c) -> Column:
    return F.when(_col(c) == F.lit("Charged Off"), F.lit(1)).otherwise(F.lit(0)).cast("int")

