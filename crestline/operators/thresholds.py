"""Quantile thresholds of the training rows, global or by regime, and the exceedances over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators.series import not_nan, quantiles

#: Digits that fitted thresholds are rounded to, so that a tie doesn't hang on the last bits.
DIGITS = 6


#: A regime with fewer finite training values than this takes the global threshold.
LEAST = 100


def fit_global(df: DataFrame, value: str, quantile: float) -> DataFrame:
    """One row: threshold (linear interpolation between order statistics) and n of the finite values."""
    return quantiles(df, F.col(value), [quantile], []).select(F.round(F.col("q")[0], DIGITS).alias("threshold"), "n")


def fit_regimes(df: DataFrame, value: str, regime: str, quantile: float, least: int = LEAST) -> DataFrame:
    """(regime, threshold, n, own) with a row <NA> for rows without a regime and a row <ANY>: the global threshold, for regimes with fewer than least finite values and those that no training row has."""
    named = df.withColumn("_regime", regime_name(F.col(regime)))
    each = quantiles(named, F.col(value), [quantile], ["_regime"]).select(F.col("_regime").alias("regime"), F.round(F.col("q")[0], DIGITS).alias("own_threshold"), "n")
    whole = fit_global(df, value, quantile)
    own = F.col("n") >= least
    fitted = each.crossJoin(F.broadcast(whole.select(F.col("threshold").alias("fallback")))).select("regime", F.when(own, F.col("own_threshold")).otherwise(F.col("fallback")).alias("threshold"), "n", own.alias("own"))
    return fitted.unionByName(whole.select(F.lit(ANY).alias("regime"), "threshold", "n", F.lit(False).alias("own")))


#: Names of rows without a regime, and of what holds for regimes that weren't fitted.
MISSING, ANY = "<NA>", "<ANY>"


def regime_name(regime: Column) -> Column:
    return F.coalesce(regime.cast("string"), F.lit(MISSING))


def apply_regimes(df: DataFrame, thresholds: DataFrame, value: str, regime: str) -> DataFrame:
    """df with threshold and exceeds (strictly above; null and NaN don't exceed). Regimes that weren't fitted, null among them, take the global threshold.

    thresholds: one row a regime, by fit_regimes(); Spark broadcasts it if it is small.
    """
    side = thresholds.where(F.col("regime") != ANY).select(F.col("regime").alias("_regime"), "threshold")
    rest = thresholds.where(F.col("regime") == ANY).agg(F.max("threshold").alias("_fallback"))
    out = df.join(side, regime_name(df[regime]) == F.col("_regime"), "left").crossJoin(F.broadcast(rest))
    return out.withColumn("threshold", F.coalesce("threshold", "_fallback")).drop("_regime", "_fallback").withColumn("exceeds", exceeds(F.col(value), F.col("threshold")))


def exceeds(value: Column, threshold: Column) -> Column:
    return F.coalesce(not_nan(value) > threshold, F.lit(False))


def fit_components(df: DataFrame, components: list[str], regime: str, quantile: float, least: int = LEAST, train: str | Column | None = None) -> DataFrame:
    """(component, regime, threshold, n) of several measures at once, from the rows that train admits; regime <ANY> holds where a regime wasn't fitted."""
    rows = df if train is None else df.where(train)
    long = rows.select(regime_name(F.col(regime)).alias("regime"), F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("x")) for c in components])).alias("e")).select("regime", "e.*")
    each = quantiles(long, F.col("x"), [quantile], ["component", "regime"]).select("component", "regime", F.round(F.col("q")[0], DIGITS).alias("own_threshold"), "n")
    whole = quantiles(long, F.col("x"), [quantile], ["component"]).select("component", F.round(F.col("q")[0], DIGITS).alias("fallback"), "n")
    fitted = each.join(F.broadcast(whole.select("component", "fallback")), "component").select("component", "regime", F.when(F.col("n") >= least, F.col("own_threshold")).otherwise(F.col("fallback")).alias("threshold"), "n")
    return fitted.unionByName(whole.select("component", F.lit(ANY).alias("regime"), F.col("fallback").alias("threshold"), "n"))


def apply_components(df: DataFrame, thresholds: DataFrame, components: list[str], regime: str) -> DataFrame:
    """df with exceeds_<component> for each: above the threshold of its regime, or of the component over all regimes where the regime wasn't fitted.

    thresholds: by fit_components(), a few rows for each regime, met as one map a regime.
    """
    by = thresholds.groupBy("regime").agg(F.map_from_entries(F.collect_list(F.struct("component", "threshold"))).alias("_cuts")).withColumnRenamed("regime", "_regime")
    rest = thresholds.where(F.col("regime") == ANY).agg(F.map_from_entries(F.collect_list(F.struct("component", "threshold"))).alias("_rest"))
    met = df.join(by, regime_name(df[regime]) == F.col("_regime"), "left").crossJoin(F.broadcast(rest))
    flags = [exceeds(F.col(c).cast("double"), F.coalesce(F.col("_cuts")[c], F.col("_rest")[c])).alias(f"exceeds_{c}") for c in components]
    return met.select(*[df[c] for c in df.columns], *flags)


def shrunk(df: DataFrame, value: str, regime: str, quantile: float, strength: float) -> DataFrame:
    """(regime, regime_threshold, global_threshold, shrunk_threshold, gap): (1 - strength) regime + strength global."""
    each = quantiles(df, F.col(value), [quantile], [regime]).select(F.col(regime).alias("regime"), F.col("q")[0].alias("r"))
    both = each.crossJoin(F.broadcast(quantiles(df, F.col(value), [quantile], []).select(F.col("q")[0].alias("g"))))
    return both.select("regime", F.round("r", DIGITS).alias("regime_threshold"), F.round("g", DIGITS).alias("global_threshold"), F.round((1 - strength) * F.col("r") + strength * F.col("g"), DIGITS).alias("shrunk_threshold"), F.round(F.col("r") - F.col("g"), DIGITS).alias("gap"))
