"""Episodes: exceedances that lie close together, and intervals of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.series import SPAN, carried
from crestline.session import written


def spaced(hits: DataFrame, entity: list[str], position: str = "i", span: int = SPAN) -> DataFrame:
    """hits with distance, to the hit before in the series (null at the first).

    Series are worked through in ranges of span positions; a range knows the last hit of those before.
    """
    hits = written(hits, "hits")  # they are met twice, and are few beside the rows that they come from
    dealt = carried(hits.withColumn("_range", F.floor(F.col(position) / span)), entity, "_range", "_last", F.max(position), F.max)
    before = F.lag(position).over(Window.partitionBy(*entity, "_range").orderBy(position))
    return dealt.withColumn("distance", F.col(position) - F.coalesce(before, "_last")).drop("_last", "_range")


def clustered(hits: DataFrame, run_length: int, entity: list[str], position: str = "i", span: int = SPAN) -> DataFrame:
    """Exceedance rows with cluster_id (0-based in each series): a gap of at most run_length samples keeps a cluster together."""
    opens = F.when(F.col("distance") - 1 <= run_length, 0).otherwise(1)
    dealt = spaced(hits, entity, position, span).withColumn("_range", F.floor(F.col(position) / span)).withColumn("_opens", opens)
    dealt = carried(dealt, entity, "_range", "_opened", F.sum("_opens"), F.sum)
    inside = F.sum("_opens").over(Window.partitionBy(*entity, "_range").orderBy(position))
    return dealt.withColumn("cluster_id", inside + F.coalesce("_opened", F.lit(0)) - 1).select(*hits.columns, "cluster_id")


def clusters(hits: DataFrame, run_length: int, entity: list[str], position: str = "i", value: str | None = None) -> DataFrame:
    """One row for each cluster: start, end, duration, size and, given a value, its maximum. Only exceedances are shuffled."""
    more = [F.max(value).alias("max_value")] if value else []
    out = clustered(hits, run_length, entity, position).groupBy(*entity, "cluster_id")
    return out.agg(F.min(position).alias("start"), F.max(position).alias("end"), (F.max(position) - F.min(position) + 1).alias("duration"), F.count("*").alias("size"), *more)


def onsets(hits: DataFrame, run_length: int, entity: list[str], position: str = "i") -> DataFrame:
    """The first exceedance of each cluster."""
    return spaced(hits, entity, position).where(F.col("distance").isNull() | (F.col("distance") - 1 > run_length)).select(*hits.columns)


def merged(intervals: DataFrame, merge_gap: int, entity: list[str], span: int = SPAN) -> DataFrame:
    """(entity, start, end) of intervals merged while at most merge_gap samples lie between; overlaps and nesting merge too."""
    dealt = written(intervals.select(*entity, "start", "end", F.floor(F.col("start") / span).alias("_range")), "intervals")
    dealt = carried(dealt, entity, "_range", "_reach", F.max("end"), F.max)
    order = Window.partitionBy(*entity, "_range").orderBy("start", "end")
    reach = F.greatest(F.col("_reach"), F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opened = dealt.withColumn("_at", F.when(F.col("start") - reach - 1 <= merge_gap, None).otherwise(F.col("start")))
    # a merged interval goes by the start that opened it
    known = carried(opened, entity, "_range", "_open", F.max("_at"), F.max)
    group = F.coalesce(F.max("_at").over(order), "_open")
    return known.withColumn("_group", group).groupBy(*entity, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def covered(intervals: DataFrame, entity: list[str]) -> DataFrame:
    """Samples under the union of the intervals of each entity."""
    return merged(intervals, 0, entity).groupBy(*entity).agg(F.sum(F.col("end") - F.col("start") + 1).alias("samples"))


def shifted(intervals: DataFrame, n: int | Column, offset: int) -> DataFrame:
    """Intervals rolled around a series of n samples, or of as many as a column says; one that wraps gives two pieces."""
    n = F.lit(n) if isinstance(n, int) else n
    a, b = (F.col("start") + offset) % n, (F.col("end") + offset) % n
    piece = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    pieces = F.when(a <= b, F.array(piece(a, b))).otherwise(F.array(piece(F.lit(0).cast("long"), b), piece(a, (n - 1).cast("long"))))
    others = [c for c in intervals.columns if c not in ("start", "end")]
    return intervals.select(*others, F.explode(pieces).alias("_p")).select(*others, "_p.start", "_p.end")


def within(df: DataFrame, intervals: DataFrame, name: str, position: str = "i", span: int = 1_000) -> DataFrame:
    """df with a boolean: does one of the intervals (start, end), which don't overlap, hold the row's position?

    Both sides are dealt into cells of span samples, so the join is on equal keys.
    """
    cells = intervals.select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))).alias("_cell"))
    spans = cells.groupBy("_cell").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    met = df.withColumn("_cell", F.floor(F.col(position) / span)).join(spans, "_cell", "left")
    return met.withColumn(name, F.coalesce(F.exists("_spans", lambda s: F.col(position).between(s["start"], s["end"])), F.lit(False))).drop("_cell", "_spans")
