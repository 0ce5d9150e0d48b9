"""Extremal index estimators: closed forms over gaps of exceedance positions, one row for each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators.episodes import spaced
from crestline.operators.series import finite, quantiles


def gaps(hits: DataFrame, entity: list[str], position: str = "i") -> DataFrame:
    """Exceedances with the distance to the one before (null at the first)."""
    return spaced(hits, entity, position)


def runs_index(hits: DataFrame, entity: list[str], run_length: int, position: str = "i") -> DataFrame:
    """theta: clusters over exceedances."""
    opens = F.when(F.col("distance").isNull() | (F.col("distance") - 1 > run_length), 1).otherwise(0)
    return gaps(hits, entity, position).groupBy(*entity).agg((F.sum(opens) / F.count("*")).alias("theta"), F.count("*").alias("n_hits"))


def intervals_index(hits: DataFrame, entity: list[str], position: str = "i") -> DataFrame:
    """theta of the interexceedance-times estimator, at most 1; 1 if no distance exceeds 2, no row with fewer than two exceedances."""
    t = F.col("distance")
    sums = gaps(hits, entity, position).where(t.isNotNull()).groupBy(*entity).agg(F.count("*").alias("n_gaps"), F.max(t).alias("longest"), F.sum(t - 1).alias("d1"), F.sum((t - 1) * (t - 2)).alias("d2"))
    spread = 2 * F.col("d1") * F.col("d1") / (F.col("n_gaps") * F.when(F.col("d2") != 0, F.col("d2")))
    return sums.select(*entity, F.when(F.col("longest") <= 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), spread)).alias("theta"), "n_gaps")


def k_gaps_index(hits: DataFrame, sizes: DataFrame, entity: list[str], k: int = 1, position: str = "i") -> DataFrame:
    """theta of the K-gaps likelihood: the smaller root of its quadratic; null where no gap lies between clusters, as there is no estimate. sizes: (entity, n) samples of each series."""
    t = F.when(F.col("distance").isNotNull(), F.greatest(F.col("distance") - 1 - k, F.lit(0)))
    sums = gaps(hits, entity, position).groupBy(*entity).agg(F.count("*").alias("_hits"), F.count_if(t == 0).alias("n0"), F.count_if(t > 0).alias("n1"), F.coalesce(F.sum(t), F.lit(0)).alias("_s"))
    a = F.col("_hits") / F.col("n") * F.col("_s")
    b = F.col("n0") + 2 * F.col("n1") + a
    root = (b - F.sqrt(b * b - 8 * F.col("n1") * a)) / (2 * a)
    theta = F.when(F.col("n0") + F.col("n1") == 0, None).when(F.col("n1") == 0, None).when(F.col("n0") == 0, F.least(F.lit(1.0), 2 * F.col("n1") / a)).otherwise(F.least(F.lit(1.0), root))
    return sums.join(sizes, list(entity)).select(*entity, theta.alias("theta"), "n0", "n1")


def _occupied(hits: DataFrame, sizes: DataFrame, entity: list[str], block: int, position: str) -> DataFrame:
    """(entity, n, hits, blocks, occupied, inside): whole blocks, those with an exceedance, and exceedances in them."""
    placed = hits.join(sizes, list(entity)).withColumn("blocks", F.floor(F.col("n") / block)).withColumn("_b", F.floor(F.col(position) / block))
    per = placed.groupBy(*entity, "n", "blocks", "_b").agg(F.count("*").alias("_c"))
    whole = F.col("_b") < F.col("blocks")
    return per.groupBy(*entity, "n", "blocks").agg(F.sum("_c").alias("hits"), F.count_if(whole).alias("occupied"), F.coalesce(F.sum(F.when(whole, F.col("_c"))), F.lit(0)).alias("inside")).where("blocks > 0")


def blocks_index(hits: DataFrame, sizes: DataFrame, entity: list[str], block: int, position: str = "i") -> DataFrame:
    """theta of disjoint blocks: -ln P(no exceedance in a whole block) / (block * rate), at most 1; 1 if every block has one."""
    empty = 1 - F.col("occupied") / F.col("blocks")
    theta = F.when(F.col("occupied") >= F.col("blocks"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), -F.log(F.when(empty > 0, empty)) / (block * F.col("hits") / F.col("n"))))
    return _occupied(hits, sizes, entity, block, position).select(*entity, theta.alias("theta"), "occupied", "blocks")


def reciprocal_index(hits: DataFrame, sizes: DataFrame, entity: list[str], block: int, position: str = "i") -> DataFrame:
    """theta: the reciprocal of the mean number of exceedances in an occupied whole block."""
    return _occupied(hits, sizes, entity, block, position).where("occupied > 0").select(*entity, (F.col("occupied") / F.col("inside")).alias("theta"))


def cuts_at(values: DataFrame, x: Column, levels: list[float]) -> DataFrame:
    """(quantile, threshold) for each level."""
    found = quantiles(values, x, levels, []).select(F.posexplode("q").alias("k", "threshold"))
    return found.select(F.element_at(F.array(*map(F.lit, levels)), F.col("k") + 1).alias("quantile"), F.round("threshold", 6).alias("threshold"))


def stability(values: DataFrame, levels: list[float], run_lengths: list[int], value: str = "value", position: str = "i") -> DataFrame:
    """(quantile, run_length, threshold, hits, clusters, theta): the runs estimate over a grid, as one plan."""
    x = finite(F.col(value))
    cuts = cuts_at(values, x, levels)
    hits = values.crossJoin(F.broadcast(cuts)).where(x > F.col("threshold")).select("quantile", "threshold", position)
    spaced = gaps(hits, ["quantile", "threshold"], position).select("quantile", "threshold", "distance", F.explode(F.array(*map(F.lit, run_lengths))).alias("run_length"))
    opens = F.when(F.col("distance").isNull() | (F.col("distance") - 1 > F.col("run_length")), 1).otherwise(0)
    return spaced.groupBy("quantile", "threshold", "run_length").agg(F.count("*").alias("hits"), F.sum(opens).alias("clusters"), (F.sum(opens) / F.count("*")).alias("theta"))
