"""Per-application ranking of feature contributions: top-k and waterfall steps.

Both work inside each row's own contribution array (36 structs): no
explode-and-regroup, no shuffle.  The sort key (-|shap|, feature position)
is carried as the leading struct fields, so ``sort_array`` orders by the
type's natural ordering.  The sorted array is worked out once per row: an expression that
names it several times would sort as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TOP_FEATURES


def keyed_contribution(pos: int, feature: str, value: Column, shap: Column) -> Column:
    """One element of a keyed contribution array: (neg_abs, pos, feature, value, shap).
    A null shap sorts last."""
    return F.struct(
        F.coalesce(-F.abs(shap), F.lit(float("inf"))).alias("neg_abs"),
        F.lit(pos).alias("pos"), F.lit(feature).alias("feature"),
        value.cast("double").alias("value"), shap.cast("double").alias("shap"))


def keyed_contributions(features: list[str], value_of=None, shap_of=None) -> Column:
    """Keyed array over ``features`` in order, from value and shap columns."""
    value_of = value_of or (lambda c: F.col(c))
    shap_of = shap_of or (lambda c: F.col(f"shap_{c}"))
    return F.array(*[keyed_contribution(i, c, value_of(c), shap_of(c)) for i, c in enumerate(features)])


def ranked_contributions(keyed: Column) -> Column:
    """|shap| descending; equal |shap| keeps feature order (stable)."""
    return F.sort_array(keyed, asc=True)


def plain(arr: Column) -> Column:
    """Drop the sort keys: array<struct<feature, value, shap>>."""
    return F.transform(arr, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["shap"].alias("shap")))


def top_features(keyed: Column, k: int = TOP_FEATURES) -> Column:
    """The k largest contributions by absolute value, as feature/value/shap structs."""
    return plain(F.slice(ranked_contributions(keyed), 1, k))


def waterfall_steps(df: DataFrame, id_col: str, keyed: str = "contributions",
                    base: str = "base_value") -> DataFrame:
    """One row per step from the base value to the final margin, in the order
    of |shap| desc: step, feature, value, shap, start, end, direction.

    The order comes from the compiled sort; the running totals are one
    ``aggregate`` over the row's own sorted array, accumulated left to right
    (start_k = base + s_1 + ... + s_(k-1)).  Row-local and JVM-side: a
    window would shuffle 36 rows per application, a Python stage would move
    every array through Arrow.
    """
    df = df.select(id_col, F.col(base).cast("double").alias("_base"), ranked_contributions(F.col(keyed)).alias("_r"))
    r = F.col("_r")
    init = F.struct(F.col("_base").alias("acc"),
                    F.array().cast("array<double>").alias("starts"))
    totals = F.aggregate(r, init, lambda st, x: F.struct(
        (st["acc"] + x["shap"]).alias("acc"),
        F.array_append(st["starts"], st["acc"]).alias("starts")))
    steps = F.arrays_zip(r["feature"].alias("feature"), r["value"].alias("value"),
                         r["shap"].alias("shap"), totals["starts"].alias("start"))
    out = df.select(id_col, F.posexplode(steps).alias("_i", "_x"))
    return out.select(
        id_col, (F.col("_i") + 1).cast("int").alias("step"), "_x.feature", "_x.value", "_x.shap",
        "_x.start", (F.col("_x.start") + F.col("_x.shap")).alias("end"),
        F.when(F.col("_x.shap") >= 0, F.lit("increase")).otherwise(F.lit("decrease")).alias("direction"))
