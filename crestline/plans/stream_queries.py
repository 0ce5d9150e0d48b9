"""Streams over the events table, run until all of it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from crestline.operators import tails
from crestline.operators.series import placed_in, ranges_of
from crestline.plans.episode_queries import by_user
from crestline.plans.registry import query, table
from crestline.session import scratch, written
from crestline.streaming import operators


#: Rows of a batch of an ordered stream, about.
BATCH_ROWS = 1_000_000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str, place: str | None = None, path: str | None = None) -> DataFrame:
    """What a streaming query has given when its input is read: a table in the shared folder.

    Each batch has a folder of its own and overwrites it, so one that is repeated after a loss leaves its rows once.
    """
    spark = stream.sparkSession
    path, place = path or scratch(spark, name), place or scratch(spark, f"{name}-state")
    write = lambda df, batch: df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch-{batch:09d}")
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def drained_in_order(rows: DataFrame, number: Column, query_of: Callable[[DataFrame], DataFrame], name: str, mode: str) -> DataFrame:
    """drained() over rows in ranges of a number, whatever files they came in: a batch holds a range, and no row is before those of earlier batches."""
    spark = rows.sparkSession
    cuts = ranges_of(rows, number, BATCH_ROWS)
    dealt, feed = scratch(spark, f"{name}-ranges"), scratch(spark, f"{name}-feed")
    rows.withColumn("_range", placed_in(cuts, number)).write.partitionBy("_range").parquet(dealt)
    ranges = spark.read.schema(StructType([*rows.schema.fields, StructField("_range", IntegerType())])).parquet(dealt)
    path, place, out = scratch(spark, name), scratch(spark, f"{name}-state"), None
    for k in range(len(cuts) + 1):
        ranges.where(F.col("_range") == k).drop("_range").write.mode("append").parquet(feed)
        out = drained(query_of(spark.readStream.schema(rows.schema).parquet(feed)), name, mode, place, path)
    return out


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_window_statistics",
    """SELECT epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS window_start, event_type, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS missing, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY ALL""",
)
def stream_window_statistics(spark, sf_dir):
    stats = operators.windowed_statistics(event_stream(spark, sf_dir), "ts", "value", ["event_type"], "1 day", "1 day")
    return drained(stats, "stream-stats", "complete").withColumn("mean", F.round("mean", 6)).withColumn("window_start", F.unix_micros("window_start"))


@query(
    "stream_exceedance_sessions",
    """WITH h AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS o FROM events WHERE value > 100), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM h)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL '12 hours') AS "end", count(*) AS size, max(value) AS max_value FROM g GROUP BY user_id, g""",
)
def stream_exceedance_sessions(spark, sf_dir):
    sessions = lambda events: operators.exceedance_sessions(events, "ts", "value", ["user_id"], 100.0, "12 hours", "1 day")
    return drained_in_order(event_rows(spark, sf_dir), F.unix_micros("ts"), sessions, "stream-sessions", "complete").withColumns({c: F.unix_micros(c) for c in ("start", "end")})


@query(
    "stream_counter_increments",
    """WITH s AS (SELECT user_id, event_id::DOUBLE AS event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id, event_id, CASE WHEN s >= 0 THEN round(s, 6) END AS increment, coalesce(s < 0, false) AS reset FROM s""",
)
def stream_counter_increments(spark, sf_dir):
    increments = lambda events: operators.counter_increments(events, "user_id", "event_id", "value")
    return drained_in_order(event_rows(spark, sf_dir), F.col("event_id"), increments, "stream-increments", "append").withColumn("increment", F.round("increment", 6))


@query(
    "stream_time_quality",
    """WITH s AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS s FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (s = 0) AS duplicates, count(*) FILTER (s < 0) AS backward, count(*) FILTER (s > 3600) AS gaps FROM s GROUP BY user_id""",
)
def stream_time_quality(spark, sf_dir):
    steps = drained_in_order(event_rows(spark, sf_dir), F.col("event_id"), lambda events: operators.time_steps(events, "user_id", "event_id", "ts"), "stream-steps", "append")
    return steps.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("step") == 0).alias("duplicates"), F.count_if(F.col("step") < 0).alias("backward"), F.count_if(F.col("step") > 3600).alias("gaps"))


@query(
    "stream_lag_features",
    """SELECT user_id, event_id::DOUBLE AS event_id, value, lag(value, 1) OVER w AS value__lag_1, lag(value, 3) OVER w AS value__lag_3, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS value__mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def stream_lag_features(spark, sf_dir):
    features = lambda events: operators.lag_features(events, "user_id", "event_id", "value", [1, 3], 5)
    return drained_in_order(event_rows(spark, sf_dir), F.col("event_id"), features, "stream-lags", "append").withColumn("value__mean", F.round("value__mean", 6))


#: Puts a training row before every live one.
BEFORE = 1 << 40


@query("stream_adaptive_thresholds")
def stream_adaptive_thresholds(spark, sf_dir):
    # the first share of each user's events is what the thresholds start from; then all of them are judged in turn
    rows = by_user(spark, sf_dir).where("value is not null").select("user_id", F.col("i").cast("double").alias("i"), "value")
    n = rows.groupBy("user_id").agg(F.greatest(F.lit(1), F.floor(0.6 * F.count("*"))).alias("n"))
    first = rows.join(n, "user_id").where("i < n").select("user_id", (F.col("i") - BEFORE).alias("i"), "value", F.lit(True).alias("train"))
    fitted = written(tails.adaptive_bases(first, "value", ["user_id"]), "bases")
    adaptive = lambda stream: operators.adaptive_thresholds(stream, "user_id", "i", "value", fitted)
    return drained_in_order(written(first.unionByName(rows.withColumn("train", F.lit(False))), "turns"), F.col("i"), adaptive, "stream-thresholds", "append")
