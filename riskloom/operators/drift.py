"""Population stability index (PSI) per feature between two periods.

Bins are fixed: ten equal-width bins over each feature's request bounds,
one below and one above them, plus one for nulls, so a shift beyond a bound
shows.  One pass: unpivot to (feature, value) inside the scan stage, bin, and
aggregate with map-side partial counts; the result has at most features x 13
rows before the final sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import APPLICATION_BOUNDS

N_BINS = 10
FLOOR_SHARE = 1e-4
NULL_BIN, BELOW_BIN, ABOVE_BIN = -1, -2, N_BINS


def binned_features(df: DataFrame, keep: list[str], feats: list[str],
                    bounds: dict[str, tuple[float, float]] = APPLICATION_BOUNDS) -> DataFrame:
    """``keep`` columns, feature and bin of every row and feature."""
    long = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in feats]).unpivot(keep, feats, "feature", "x")
    lo = F.col("_lo")
    hi = F.col("_hi")
    lo_map = F.create_map(*[a for f in feats for a in (F.lit(f), F.lit(float(bounds[f][0])))])
    hi_map = F.create_map(*[a for f in feats for a in (F.lit(f), F.lit(float(bounds[f][1])))])
    binned = long.withColumns({"_lo": lo_map[F.col("feature")], "_hi": hi_map[F.col("feature")]})
    raw_bin = F.floor((F.col("x") - lo) / (hi - lo) * N_BINS)
    return binned.withColumn(
        "bin", F.when(F.col("x").isNull(), F.lit(NULL_BIN)).when(F.col("x") < lo, F.lit(BELOW_BIN))
                .when(F.col("x") > hi, F.lit(ABOVE_BIN))
                .otherwise(F.least(raw_bin, F.lit(N_BINS - 1))).cast("int")).drop("_lo", "_hi", "x")


def feature_drift(df: DataFrame, period_col: str, base_value: str, current_value: str,
                  bounds: dict[str, tuple[float, float]] = APPLICATION_BOUNDS) -> DataFrame:
    feats = [f for f in bounds if f in df.columns]
    binned = binned_features(df, [period_col], feats, bounds)
    counts = binned.groupBy("feature", "bin").agg(
        F.count_if(F.col(period_col) == base_value).alias("n_base"),
        F.count_if(F.col(period_col) == current_value).alias("n_cur"))
    per_feature = Window.partitionBy("feature")
    shares = counts.select(
        "feature",
        F.greatest(F.try_divide(F.col("n_base"), F.sum("n_base").over(per_feature)),
                   F.lit(FLOOR_SHARE)).alias("p"),
        F.greatest(F.try_divide(F.col("n_cur"), F.sum("n_cur").over(per_feature)),
                   F.lit(FLOOR_SHARE)).alias("q"))
    return shares.groupBy("feature").agg(
        F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 6).alias("psi"),
        F.count(F.lit(1)).alias("n_bins"))
