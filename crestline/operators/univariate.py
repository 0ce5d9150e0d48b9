"""What a single measure's extremes look like: excesses over candidate thresholds, and all index estimators side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators import extremal
from crestline.operators.series import finite

LEAST_RUN, MOST_RUN = 1, 600


def threshold_diagnostics(df: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """(quantile, threshold, exceedances, mean_excess) of candidate thresholds; without an exceedance the mean is null."""
    x = finite(F.col(value))
    cuts = extremal.cuts_at(df, x, levels)
    over = df.select(x.alias("_x")).crossJoin(F.broadcast(cuts)).where("_x > threshold").groupBy("quantile").agg(F.count("*").alias("exceedances"), F.avg(F.col("_x") - F.col("threshold")).alias("mean_excess"))
    return cuts.join(over, "quantile", "left").select("quantile", "threshold", F.coalesce("exceedances", F.lit(0)).alias("exceedances"), "mean_excess")


def derived_run_length(theta: Column) -> Column:
    """Run length that an extremal index implies: 1 / theta, rounded, from 1 to 600; 1 without an estimate."""
    length = F.when(theta > 0, F.bround(1 / theta))
    return F.coalesce(F.least(F.lit(MOST_RUN), F.greatest(F.lit(LEAST_RUN), length)), F.lit(LEAST_RUN)).cast("int")


def mean_cluster_size(theta: Column) -> Column:
    return F.when(theta > 0, 1 / theta)


def estimates(hits: DataFrame, sizes: DataFrame, entity: list[str], run_length: int, block: int, position: str = "i") -> DataFrame:
    """(entity, estimator, estimate, status, mean_cluster_size, derived_run_length): every estimator for every series that has an exceedance.

    An estimator that has no answer gives a row of status failed, so that none goes missing.
    """
    series = hits.select(*entity).distinct()
    found = {
        "none": series.withColumn("theta", F.lit(1.0)),
        "runs": extremal.runs_index(hits, entity, run_length, position),
        "intervals": extremal.intervals_index(hits, entity, position),
        "k_gaps": extremal.k_gaps_index(hits, sizes, entity, position=position),
        "blocks": extremal.blocks_index(hits, sizes, entity, block, position),
        "reciprocal_blocks": extremal.reciprocal_index(hits, sizes, entity, block, position),
    }
    long = reduce(DataFrame.unionByName, [df.select(*entity, F.lit(name).alias("estimator"), F.col("theta").alias("estimate")) for name, df in found.items()])
    asked = series.withColumn("estimator", F.explode(F.array(*map(F.lit, found))))
    out = asked.join(long, [*entity, "estimator"], "left")
    theta = F.col("estimate")
    return out.select(*entity, "estimator", theta, F.when(theta.isNull(), "failed").otherwise("succeeded").alias("status"), mean_cluster_size(theta).alias("mean_cluster_size"), derived_run_length(theta).alias("derived_run_length"))


def pivoted(stability: DataFrame, run_lengths: list[int]) -> DataFrame:
    """A stability grid as one row a quantile and one column a run length, run_<k>."""
    wide = stability.groupBy("quantile").pivot("run_length", run_lengths).agg(F.avg("theta"))
    return wide.select("quantile", *[F.col(str(k)).alias(f"run_{k}") for k in run_lengths])
