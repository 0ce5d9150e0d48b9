"""How far one data set's features carry over to another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators.series import finite


def histogram_overlap(df: DataFrame, value: str, side: str, bins: int = 50) -> DataFrame:
    """(overlap): sum over shared bins of the smaller of both sides' shares. side: boolean, the source."""
    rows = df.select(F.col(side).alias("s"), finite(F.col(value)).alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if("s").alias("n_s"), F.count_if(~F.col("s")).alias("n_d"))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).otherwise(0))
    counts = placed.groupBy("bin", "n_s", "n_d").agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))
    return counts.agg(F.coalesce(F.sum(F.least(F.col("a") / F.greatest("n_s", F.lit(1)), F.col("b") / F.greatest("n_d", F.lit(1)))), F.lit(0.0)).alias("overlap"))


LEVELS = [k / 20 for k in range(1, 20)]


def quantile_shift(df: DataFrame, value: str, side: str) -> DataFrame:
    """(shift, scaled_shift): mean absolute difference of 19 quantiles, and the same in interquartile ranges of the source."""
    x, levels = finite(F.col(value)), F.array(*map(F.lit, LEVELS))
    q = df.agg(F.percentile(F.when(F.col(side), x), levels).alias("a"), F.percentile(F.when(~F.col(side), x), levels).alias("b"))
    shift = F.aggregate(F.zip_with("a", "b", lambda p, r: F.abs(p - r)), F.lit(0.0), lambda s, v: s + v) / len(LEVELS)
    spread = F.col("a")[14] - F.col("a")[4]
    return q.select(shift.alias("shift"), (shift / F.when(spread > 0, spread).otherwise(F.lit(1.0))).alias("scaled_shift"))


def compatibility(df: DataFrame, value: str, side: str, most_shift: float = 3.0, least_overlap: float = 0.3, most_missing: float = 0.25) -> DataFrame:
    """One row: overlap, scaled shift, difference of missing shares, and whether the feature may be transferred."""
    missing = df.agg(F.abs(F.avg(F.when(F.col(side), finite(F.col(value)).isNull().cast("double"))) - F.avg(F.when(~F.col(side), finite(F.col(value)).isNull().cast("double")))).alias("missing_difference"))
    both = histogram_overlap(df, value, side).crossJoin(quantile_shift(df, value, side)).crossJoin(missing)
    return both.withColumn("compatible", (F.col("scaled_shift") <= most_shift) & (F.col("overlap") >= least_overlap) & (F.col("missing_difference") <= most_missing))
