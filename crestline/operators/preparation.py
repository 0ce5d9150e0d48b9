"""Preparation and quality of telemetry and fleet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ContractError(ValueError):
    """A table doesn't have what an operator needs."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def validate(df: DataFrame, columns: list[str], timestamp: str) -> DataFrame:
    """df, if it has the columns, rows, and no row without a timestamp; else ContractError."""
    require_columns(df, [*columns, timestamp])
    seen = df.agg(F.count("*").alias("n"), F.count_if(F.col(timestamp).isNull()).alias("nulls")).first()
    if not seen["n"]:
        raise ContractError("no rows")
    if seen["nulls"]:
        raise ContractError(f"{seen['nulls']} rows without {timestamp}")
    return df


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """df with canonical copies of source columns, where the source is there and the canonical name isn't."""
    return df.withColumns({new: F.col(old) for old, new in aliases.items() if old in df.columns and new not in df.columns})


def label_intervals(df: DataFrame, intervals: DataFrame, timestamp: str, most_broadcast: int = 10_000) -> DataFrame:
    """df with is_failure and failure_type: the interval (start, end, kind, rank) of the highest rank that holds the timestamp.

    Intervals are labelled failures: a table kept by people, whose size is checked before it is broadcast.
    """
    few = intervals.count() <= most_broadcast
    side = intervals.select(F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("kind").alias("_kind"), F.col("rank").alias("_rank"))
    if few:
        table = side.agg(F.collect_list(F.struct("_rank", "_s", "_e", "_kind")).alias("_all"))
        best = F.array_max(F.filter("_all", lambda x: F.col(timestamp).between(x["_s"], x["_e"])))
        return df.crossJoin(F.broadcast(table)).withColumn("_best", best).withColumn("is_failure", F.col("_best").isNotNull()).withColumn("failure_type", F.col("_best._kind")).drop("_all", "_best")
    day = lambda c: F.date_trunc("day", F.col(c))
    dealt = side.withColumn("_day", F.explode(F.sequence(day("_s"), day("_e"), F.expr("interval 1 day"))))
    keyed = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_day", day(timestamp))
    best = keyed.select("_id", "_day", timestamp).join(dealt, "_day").where(F.col(timestamp).between(F.col("_s"), F.col("_e"))).groupBy("_id").agg(F.max_by("_kind", "_rank").alias("failure_type"), F.lit(True).alias("is_failure"))
    return keyed.join(best, "_id", "left").select(*df.columns, F.coalesce("is_failure", F.lit(False)).alias("is_failure"), "failure_type")


def increments(df: DataFrame, counters: list[str], entity: list[str], order: list[str]) -> DataFrame:
    """df with counter__increment (null at the first row and where a counter falls) and counter_reset (any fell)."""
    w = Window.partitionBy(*entity).orderBy(*order)
    steps = {c: F.col(c) - F.lag(c).over(w) for c in counters}
    out = df.withColumns({f"{c}__increment": F.when(s >= 0, s) for c, s in steps.items()})
    fell = F.lit(False)
    for s in steps.values():
        fell = fell | F.coalesce(s < 0, F.lit(False))
    return out.withColumn("counter_reset", fell)


def time_quality(df: DataFrame, timestamp: str, entity: list[str], order: list[str], gap_seconds: float = 1.5) -> DataFrame:
    """(entity, n, duplicates, backward, gaps, cadence): steps of 0, below 0 and beyond gap_seconds in file order, and the median positive step."""
    w = Window.partitionBy(*entity).orderBy(*order)
    at = F.unix_micros(F.col(timestamp).cast("timestamp"))
    step = df.select(*entity, ((at - F.lag(at).over(w)) / 1e6).alias("step"))
    return step.groupBy(*entity).agg(F.count("*").alias("n"), F.count_if(F.col("step") == 0).alias("duplicates"), F.count_if(F.col("step") < 0).alias("backward"), F.count_if(F.col("step") > gap_seconds).alias("gaps"), F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)).alias("cadence"))


def column_statistics(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(column, kind, n, missing, low, high, distinct): one pass over the table; distinct is estimated unless exact."""
    kinds = dict(df.dtypes)
    parts, count = [], F.count_distinct if exact else F.approx_count_distinct
    for c in columns:
        x = F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        parts += [F.count_if(x.isNull()).alias(f"{c}|missing"), F.min(x).cast("string").alias(f"{c}|low"), F.max(x).cast("string").alias(f"{c}|high"), count(x).alias(f"{c}|distinct")]
    one = df.agg(F.count("*").alias("n"), *parts)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col("n"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("missing", "low", "high", "distinct")]) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def leaked_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that two splits share; a clean split has none."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def check_no_leak(splits: dict[str, DataFrame], key: str) -> None:
    """ContractError if any two splits share an id."""
    names = list(splits)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if not leaked_ids(splits[a], splits[b], key).isEmpty():
                raise ContractError(f"{a} and {b} share values of {key}")


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a side that must have each key once."""
    if not right.groupBy(key).count().where("count > 1").isEmpty():
        raise ContractError(f"{key} is not unique")
    return left.join(right, key, "left")


def trace_summary(df: DataFrame, trace: str) -> DataFrame:
    """df with mean, sample standard deviation, least, largest and last value of an array column."""
    x, n = F.col(trace), F.size(trace)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return df.withColumns({f"{trace}_mean": mean, f"{trace}_std": F.when(n > 1, F.sqrt(squares / (n - 1))), f"{trace}_min": F.array_min(x), f"{trace}_max": F.array_max(x), f"{trace}_last": F.element_at(x, -1)})


def families(columns: list[str]) -> dict[str, list[str]]:
    """Columns by their prefix before the first underscore."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(c.split("_", 1)[0], []).append(c)
    return out


def deviates(expected: dict[str, object]) -> Column:
    """Does any column differ from its expected constant? A missing value differs."""
    from functools import reduce

    return reduce(Column.__or__, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in expected.items()])


def unique_columns(df: DataFrame) -> DataFrame:
    """df, if no column name (whatever its case) is there twice; else ContractError."""
    names = [c.lower() for c in df.columns]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ContractError(f"repeated columns: {', '.join(twice)}")
    return df


def lag_features(df: DataFrame, columns: list[str], lags: list[int], train: str, entity: list[str], position: str = "i") -> DataFrame:
    """df with column__lag_k: earlier values of the series; where there is none, the training median."""
    from crestline.operators.series import quantiles

    w, out = Window.partitionBy(*entity).orderBy(position), df
    for c in columns:
        median = quantiles(df.where(train), F.col(c), [0.5], []).select(F.col("q")[0].alias("_median"))
        out = out.crossJoin(F.broadcast(median)).withColumns({f"{c}__lag_{k}": F.coalesce(F.lag(c, k).over(w).cast("double"), "_median") for k in lags}).drop("_median")
    return out
