"""Regimes: labels of a series' state, and what they look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_rules(df: DataFrame, load: str, level: str, entity: list[str], on: float, rise: float, position: str = "i") -> DataFrame:
    """off at or below the load threshold, recovery where the level rises by at least rise, else loaded. The first row doesn't rise."""
    order = Window.partitionBy(*entity).orderBy(position)
    step = F.coalesce(F.col(level) - F.lag(level).over(order), F.lit(0.0))
    return df.withColumn("regime", F.when(F.col(load) <= on, "off").when(step >= rise, "recovery").otherwise("loaded"))


def by_changepoint(df: DataFrame, value: str, entity: list[str], window: int, z: float, position: str = "i") -> DataFrame:
    """high_shift or low_shift where a value leaves the mean of the window before it by z standard deviations; stable else and while the window fills."""
    before = Window.partitionBy(*entity).orderBy(position).rowsBetween(-window, -1)
    full = F.count(value).over(before) == window
    out = df.withColumn("_m", F.when(full, F.avg(value).over(before))).withColumn("_s", F.when(full, F.stddev_pop(value).over(before)))
    x, m, s = F.col(value), F.col("_m"), F.col("_s")
    score = (x - m) / F.when(s > 0, s)
    label = F.when((s == 0) & (x > m), "high_shift").when((s == 0) & (x < m), "low_shift").when(score >= z, "high_shift").when(score <= -z, "low_shift").otherwise("stable")
    return out.withColumn("regime", label).drop("_m", "_s")


def by_quantiles(df: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """regime: number of the fitted inner quantiles at or below the value."""
    cuts = df.agg(F.percentile(value, F.array(*map(F.lit, levels))).alias("_cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("regime", F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c <= F.col(value)).cast("int"))).drop("_cuts")


def occupancy(df: DataFrame, regime: str = "regime") -> DataFrame:
    """(regime, n, share)."""
    counts = df.groupBy(F.col(regime).alias("regime")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("regime", "n", (F.col("n") / F.col("_all")).alias("share"))


def transitions(df: DataFrame, entity: list[str], regime: str = "regime", position: str = "i") -> DataFrame:
    """(previous, current, n) over consecutive rows."""
    order = Window.partitionBy(*entity).orderBy(position)
    pairs = df.select(F.lag(regime).over(order).alias("previous"), F.col(regime).alias("current"))
    return pairs.where("previous is not null").groupBy("previous", "current").agg(F.count("*").alias("n"))


def durations(df: DataFrame, entity: list[str], regime: str = "regime", position: str = "i") -> DataFrame:
    """One row for each maximal run of a regime: start and duration in samples."""
    order = Window.partitionBy(*entity).orderBy(position)
    begins = F.when(F.col(regime).eqNullSafe(F.lag(regime).over(order)) & F.lag(position).over(order).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    return runs.groupBy(*entity, F.col(regime).alias("regime"), "_run").agg(F.min(position).alias("start"), F.count("*").alias("duration")).drop("_run")


def pooled(df: DataFrame, least_share: float, fallback: str, regime: str = "regime") -> DataFrame:
    """df with regimes of less than least_share of the rows renamed to the fallback."""
    tiny = occupancy(df, regime).where(F.col("share") < least_share).select(F.col("regime").alias("_tiny"))
    out = df.join(F.broadcast(tiny), df[regime] == F.col("_tiny"), "left")
    return out.withColumn(regime, F.when(F.col("_tiny").isNotNull(), F.lit(fallback)).otherwise(F.col(regime))).drop("_tiny")


def label_of(edges: list[float], value: Column) -> Column:
    """Place of a value among frozen edges."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
