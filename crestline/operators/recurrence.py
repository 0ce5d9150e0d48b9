"""Return times, first hits and outcomes within a horizon, from the next hit after each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def return_times(hits: DataFrame, entity: list[str], position: str = "i") -> DataFrame:
    """Distances between consecutive hits of a series."""
    order = Window.partitionBy(*entity).orderBy(position)
    return hits.withColumn("return_time", F.col(position) - F.lag(position).over(order)).where("return_time is not null")


def next_hit(hit: Column, entity: list[str], position: str = "i", inclusive: bool = False) -> Column:
    """Position of the next hit: after the row, or from the row on. A running minimum in descending order: its cost doesn't depend on the horizon."""
    back = Window.partitionBy(*entity).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.min(F.when(hit, F.col(position))).over(back)


def horizon_outcome(df: DataFrame, hit: str, entity: list[str], horizon: int, inclusive: bool = False, position: str = "i") -> DataFrame:
    """df with outcome: a hit in (i, i + horizon], or in [i, i + horizon]; at the end of a series the horizon is cut."""
    out = df.withColumn("_next", next_hit(F.col(hit), entity, position, inclusive))
    return out.withColumn("outcome", F.coalesce(F.col("_next") - F.col(position) <= horizon, F.lit(False))).drop("_next")


def hit_probability(df: DataFrame, hit: str, entity: list[str], horizon: int, position: str = "i") -> DataFrame:
    """(entity, starts, probability): share of rows with a full horizon that are followed by a hit within it."""
    sized = horizon_outcome(df, hit, entity, horizon, position=position).withColumn("_n", F.count("*").over(Window.partitionBy(*entity)))
    return sized.where(F.col(position) < F.col("_n") - horizon).groupBy(*entity).agg(F.count("*").alias("starts"), F.avg(F.col("outcome").cast("double")).alias("probability"))


def first_hit(df: DataFrame, hit: str, entity: list[str], start: int, position: str = "i") -> DataFrame:
    """(entity, wait): samples from start to the first hit from there on; null if there is none."""
    return df.groupBy(*entity).agg((F.min(F.when(F.col(hit) & (F.col(position) >= start), F.col(position))) - start).alias("wait"))


def forward_rate(df: DataFrame, hit: str, entity: list[str], horizon: int, position: str = "i") -> DataFrame:
    """df with rate: hits over samples in (i, i + horizon], from running sums at both ends of the frame."""
    ahead = Window.partitionBy(*entity).orderBy(position).rowsBetween(1, horizon)
    one = F.col(hit).cast("int")
    return df.withColumn("rate", F.coalesce(F.sum(one).over(ahead), F.lit(0)) / F.greatest(F.lit(1), F.count(F.lit(1)).over(ahead)))
