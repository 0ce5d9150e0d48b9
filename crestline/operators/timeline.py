"""Timelines: what happened when, in bins of positions and near a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.series import SPAN, carried


def overview(n: int, alarms: DataFrame, failures: DataFrame, exceedances: DataFrame, bins: int = 240) -> DataFrame:
    """(bin, first, last, alarm_episodes, under_warning, exceedances, failure_onset, reset) over bins of a series of n samples.

    alarms: disjoint (start, end). An interval gives its share to each bin it crosses, so no sample is a row.
    """
    bins = min(bins, n)
    # bin k holds the samples from n * k // bins up to the next bin's first
    frame = alarms.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).select("bin", F.expr(f"bin * {n}L div {bins}").alias("first"), F.expr(f"(bin + 1) * {n}L div {bins} - 1").alias("last"))
    at = lambda x: F.least(F.lit(bins - 1), F.floor((bins * (x + 1) - 1) / n)).cast("int")
    crossed = alarms.select("start", "end", F.explode(F.sequence(at(F.col("start")), at(F.col("end")))).alias("bin")).join(F.broadcast(frame), "bin")
    inside = F.least("end", "last") - F.greatest("start", "first") + 1
    warned = crossed.groupBy("bin").agg(F.count_if(F.col("start") >= F.col("first")).alias("alarm_episodes"), F.sum(inside).alias("under_warning"))
    hits = exceedances.groupBy(at(F.col("i")).alias("bin")).agg(F.count("*").alias("exceedances"))
    onset = failures.select(at(F.col("start")).alias("bin")).distinct().withColumn("failure_onset", F.lit(True))
    reset = failures.select(at(F.col("end")).alias("bin")).distinct().withColumn("reset", F.lit(True))
    out = frame
    for part in (warned, hits, onset, reset):
        out = out.join(part, "bin", "left")
    return out.na.fill(0, ["alarm_episodes", "under_warning", "exceedances"]).na.fill(False, ["failure_onset", "reset"])


def local_trace(rows: DataFrame, alarms: DataFrame, onset: int, before: int, after: int, horizon: int, position: str = "i") -> DataFrame:
    """Rows near a failure's onset with the start of the alarm that holds them (null: none) and whether they lie in its warning window."""
    near = rows.where(F.col(position).between(onset - before, onset + after))
    held = F.broadcast(alarms.where((F.col("end") >= onset - before) & (F.col("start") <= onset + after)).agg(F.collect_list(F.struct("start", "end")).alias("_held")))
    return near.crossJoin(held).withColumn("alarm_start", F.get(F.filter("_held", lambda a: F.col(position).between(a["start"], a["end"])), F.lit(0))["start"]).drop("_held").withColumn("in_window", F.col(position).between(onset - horizon, onset))


def last_before(alarms: DataFrame, failures: DataFrame) -> DataFrame:
    """(failure_id, alarm_start, alarm_end): each failure's last alarm that starts at or before its onset, by one pass over both in ranges of their starts."""
    both = alarms.select(F.col("start").alias("at"), F.lit(0).alias("turn"), F.struct("start", "end").alias("alarm"), F.lit(None).cast("long").alias("failure_id")).unionByName(failures.select(F.col("start").alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("alarm"), "failure_id"))
    dealt = carried(both.withColumn("_range", F.floor(F.col("at") / SPAN)), [], "_range", "_before", F.max("alarm"), F.max)
    here = F.last("alarm", ignorenulls=True).over(Window.partitionBy("_range").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_latest", F.coalesce(here, "_before")).where("turn = 1").select("failure_id", F.col("_latest.start").alias("alarm_start"), F.col("_latest.end").alias("alarm_end"))


def reconciled(bins: DataFrame, trace: DataFrame, known: dict[str, float], table_alarms: int, table_rate: float, position: str = "i") -> DataFrame:
    """(check, agrees, here, there) of a timeline: do its bins, its local trace, what it says of itself and the event table agree?

    bins: by overview(); trace: by local_trace(), with the threshold of each row; known: alarm_episodes,
    local_alarm_episodes, false_alarms_per_day and threshold as the timeline states them; table_alarms
    and table_rate: alarms and false alarms a day of the event table. Checks of a trace or of bins
    without rows hold.
    """
    whole = bins.agg(F.coalesce(F.sum("alarm_episodes"), F.lit(0)).alias("binned"), F.max("last").alias("last"))
    near = trace.agg(F.min(position).alias("low"), F.max(position).alias("high"), F.count_distinct("threshold").alias("cuts"), F.max("threshold").alias("cut"))
    stated = {k: F.lit(float(v)) for k, v in known.items()}
    number = lambda x: (x if not isinstance(x, (int, float)) else F.lit(x)).cast("double")
    check = lambda name, holds, here, there: F.struct(F.lit(name).alias("check"), F.coalesce(holds, F.lit(True)).alias("agrees"), number(here).alias("here"), number(there).alias("there"))
    rows = [
        check("alarms_in_bins", F.col("binned") == stated["alarm_episodes"], F.col("binned"), stated["alarm_episodes"]),
        check("alarms_in_event_table", stated["alarm_episodes"] == F.lit(float(table_alarms)), stated["alarm_episodes"], table_alarms),
        check("local_alarms_within_all", stated["local_alarm_episodes"] <= stated["alarm_episodes"], stated["local_alarm_episodes"], stated["alarm_episodes"]),
        check("trace_within_bins", (F.col("low") >= 0) & (F.col("high") <= F.col("last")), F.col("high"), F.col("last")),
        check("false_alarms_per_day", F.abs(stated["false_alarms_per_day"] - F.lit(float(table_rate))) <= 1e-6, stated["false_alarms_per_day"], table_rate),
        check("one_threshold_in_trace", F.when(F.col("low").isNotNull(), F.col("cuts") == 1), F.col("cuts"), F.lit(1)),
        check("threshold_of_trace", F.abs(F.col("cut") - stated["threshold"]) <= 1e-9, F.col("cut"), stated["threshold"]),
    ]
    return whole.crossJoin(near).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
