"""Drift with bins from the data, by quantile sketches that can be merged.

Every period keeps one KLL sketch for each feature (some kB, whatever the rows), from one pass
with map-side partial sketches.  Periods are compared by merging and reading
sketches; the rows are not read again, and a new period adds its own sketch.

Bins are the base period's quantiles.  A bin's share is the difference of two
ranks in a period's sketch.  With ``K`` a rank is off by at most ``RANK_ERROR`` of the
rows (99 % confidence of a single rank; exact while a sketch has seen fewer than K values), a share by twice that.

Defined results: nulls and NaN are no values; they are a bin of their own, by their exact
share; equal quantiles make one bin; a period without rows has no row; a feature without values
in the base has the bin of nulls and that of all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 4096
#: Rank error of one quantile for that K, as a share of the rows.
RANK_ERROR = 2.296 / K**0.9021
BINS, FLOOR_SHARE = 10, 1e-4


def feature_sketches(df: DataFrame, period: Column, features: list[str]) -> DataFrame:
    """(feature, period, sketch, n, n_null) of each feature in each period."""
    long = df.select(period.alias("period"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        "period", features, "feature", "x")
    x = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy("feature", "period").agg(
        F.kll_sketch_agg_double(x, F.lit(K)).alias("sketch"), F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count(x)).alias("n_null"))


def merged(sketches: DataFrame, group: Column) -> DataFrame:
    """The sketches of the periods of each group, as one (feature, period, sketch, n, n_null)."""
    return sketches.groupBy("feature", group.alias("period")).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("n_null").alias("n_null"))


def edges_of(sketches: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """The distinct inner quantiles of each feature's sketch, ascending: features x bins numbers."""
    ranks = F.array(*[F.lit(j / bins) for j in range(1, bins)])
    quantiles = F.when(F.col("n_null") < F.col("n"), F.array_distinct(F.kll_sketch_get_quantile_double("sketch", ranks)))
    return {r["feature"]: list(r["q"] or []) for r in sketches.select("feature", quantiles.alias("q")).collect()}


def _shares(edges: dict[str, list[float]]) -> Column:
    """Shares of a period: nulls, then up to each edge, then above the last."""
    missing, out = F.col("n_null") / F.col("n"), None
    for feature, cuts in edges.items():
        ranks = F.concat(F.array(F.lit(0.0)), F.kll_sketch_get_rank_double("sketch", F.array(*[F.lit(c) for c in cuts])),
                         F.array(F.lit(1.0))) if cuts else F.array(F.lit(0.0), F.lit(1.0))
        steps = F.transform(F.arrays_zip(F.slice(ranks, 2, len(cuts) + 1).alias("b"), F.slice(ranks, 1, len(cuts) + 1).alias("a")),
                            lambda r: (r["b"] - r["a"]) * (1 - missing))
        nothing = F.array_repeat(F.lit(0.0), len(cuts) + 1)
        mine = F.concat(F.array(missing), F.when(F.col("n_null") < F.col("n"), steps).otherwise(nothing))
        out = F.when(F.col("feature") == feature, mine) if out is None else out.when(F.col("feature") == feature, mine)
    return out


def drift_between(sketches: DataFrame, base: str, current: str, bins: int = BINS) -> DataFrame:
    """(feature, base_shares, current_shares, psi) of two periods."""
    edges = edges_of(sketches.filter(F.col("period") == base), bins)
    if not edges:
        return sketches.sparkSession.createDataFrame(
            [], "feature string, base_shares array<double>, current_shares array<double>, psi double")
    shares = sketches.filter(F.col("period").isin(base, current)).select("feature", "period", _shares(edges).alias("shares"))
    both = shares.groupBy("feature").agg(F.max(F.when(F.col("period") == base, F.col("shares"))).alias("base_shares"),
                                         F.max(F.when(F.col("period") == current, F.col("shares"))).alias("current_shares"))
    both = both.filter("base_shares IS NOT NULL AND current_shares IS NOT NULL")
    return both.withColumn("psi", psi(F.col("base_shares"), F.col("current_shares")))


def psi(p: Column, q: Column) -> Column:
    """The stability index of two arrays of shares; bins that both lack add nothing."""
    def part(a: Column, b: Column) -> Column:
        x, y = F.greatest(a, F.lit(FLOOR_SHARE)), F.greatest(b, F.lit(FLOOR_SHARE))
        return F.when((a <= 0) & (b <= 0), F.lit(0.0)).otherwise((y - x) * F.log(y / x))
    return F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda acc, v: acc + v)


def rank_errors(df: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, error): how far the exact rank of any edge is from its quantile's, at most.

    ``df`` (feature, x), ``edges`` (feature, edges, quantiles): a few numbers for each feature.
    """
    inside = df.filter(F.col("x").isNotNull() & ~F.isnan("x")).join(F.broadcast(edges), "feature")
    each = inside.select("feature", "x", F.explode(F.arrays_zip("edges", "quantiles")).alias("e")).select(
        "feature", "x", F.col("e.edges").alias("edge"), F.col("e.quantiles").alias("quantile"))
    counts = each.groupBy("feature", "edge", "quantile").agg(
        (F.count_if(F.col("x") < F.col("edge")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col("x") <= F.col("edge")) / F.count(F.lit(1))).alias("upto"))
    off = F.greatest(F.col("below") - F.col("quantile"), F.col("quantile") - F.col("upto"), F.lit(0.0))
    return counts.groupBy("feature").agg(F.max(off).alias("error"))
