"""Choosing: thresholds and run lengths by what they do on validation rows, sensors by what they tell apart, methods by their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions.draws import number
from crestline.operators.detectors import suffix_rate, train_share
from crestline.operators.episodes import clustered, merged, spaced, within
from crestline.operators.series import column_quantiles, quantiles
from crestline.session import written

#: Share of alarms that is aimed at where there is no target to score against.
WANTED_RATE = 0.02


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def objectives(df: DataFrame, score: str, candidates: list[float], target: str | None = None) -> DataFrame:
    """(place, threshold, n, objective) of candidate thresholds, alarms being scores at or over them: F1 against the target, or nearness of the alarm rate to WANTED_RATE.

    Rows are counted for all candidates in one pass; a row meets only the candidates it reaches.
    """
    x, hit = F.col(score), F.coalesce(F.col(target), F.lit(False)) if target else F.lit(False)
    counts = df.agg(F.count("*").alias("n"), F.count_if(hit).alias("positives"))
    reached = F.filter(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(float(c)).alias("threshold")) for k, c in enumerate(candidates)]), lambda c: F.coalesce(x >= c["threshold"], F.lit(False)))
    met = df.select(hit.alias("_hit"), F.explode(reached).alias("c")).groupBy("c.place").agg(F.count("*").alias("alarms"), F.count_if("_hit").alias("tp"))
    every = df.sparkSession.createDataFrame([(k, float(c)) for k, c in enumerate(candidates)], "place int, threshold double")
    both = every.join(met, "place", "left").na.fill(0, ["alarms", "tp"]).crossJoin(F.broadcast(counts))
    goal = f1(F.col("tp"), F.col("alarms") - F.col("tp"), F.col("positives") - F.col("tp")) if target else -F.abs(F.col("alarms") / F.greatest(F.lit(1), F.col("n")) - WANTED_RATE)
    return both.select("place", "threshold", "n", F.round(goal, 9).alias("objective"))


def selected(table: DataFrame, objective: str = "objective", place: str = "place") -> DataFrame:
    """The row of the largest objective; of equals the first. table: one row a candidate."""
    return table.agg(F.max_by(F.struct(*table.columns), F.struct(F.col(objective), -F.col(place))).alias("best")).select("best.*")


def sensor_separation(train: DataFrame, columns: list[str], label: str, quantile: float = 0.98) -> DataFrame:
    """(place, sensor, eligible, separation): how far the median magnitude of labelled rows lies from that of the others, in their standard deviations.

    A sensor is eligible if its magnitude's operating quantile lies above its median. Missing readings count as 0.
    """
    value = lambda c: F.abs(F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)))
    rows = train.select(F.coalesce(F.col(label), F.lit(False)).alias("_label"), *[value(c).alias(f"_x{k}") for k, c in enumerate(columns)])
    x = {k: F.col(f"_x{k}") for k in range(len(columns))}
    size = rows.agg(F.count("*").alias("n"), *[F.stddev_pop(F.when(~F.col("_label"), x[k])).alias(f"s{k}") for k in x]).first()
    asked = {f"{kind} {k}": part for k in x for kind, part in (("all", (x[k], [0.5, quantile])), ("failing", (F.when(F.col("_label"), x[k]), [0.5])), ("healthy", (F.when(~F.col("_label"), x[k]), [0.5])))}
    q = column_quantiles(rows, asked) if size["n"] else {}
    each = [(k, columns[k], *q[f"all {k}"], q[f"failing {k}"][0], q[f"healthy {k}"][0], size[f"s{k}"]) for k in x if q]
    table = train.sparkSession.createDataFrame(each, "place int, sensor string, _median double, _high double, failing double, healthy double, s double")
    out = table.withColumn("eligible", F.col("_high") > F.col("_median"))
    return out.select("place", "sensor", "eligible", F.round((F.col("failing") - F.col("healthy")) / F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)), 6).alias("separation"))


def best_sensor(separations: DataFrame) -> DataFrame:
    """The eligible sensor that separates best, the first of equals; where none is eligible all are."""
    any_ = F.broadcast(separations.agg(F.coalesce(F.bool_or("eligible"), F.lit(False)).alias("_any")))
    usable = separations.crossJoin(any_).where(F.col("eligible") | ~F.col("_any")).where("separation is not null")
    return selected(usable.select("place", "sensor", "separation"), "separation")


def single_sensor_score(df: DataFrame, sensor: str, name: str = "sensor_score") -> DataFrame:
    """df with the magnitude of one sensor; missing counts as 0."""
    x = F.col(sensor).cast("double")
    return df.withColumn(name, F.abs(F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))))


def best_of_category(metrics: DataFrame, category: Column, keys: list[str] | None = None, f1_col: str = "f1", burden: str = "false_alarms_per_day", degenerate: str = "degenerate", tie: str = "method") -> DataFrame:
    """Of each category (and keys) the method of the largest F1, then the least burden, then the first name; one that is always on wins only where there is no other."""
    rows = metrics.withColumn("category", category).where("category is not null")
    order = Window.partitionBy(*(keys or []), "category").orderBy(F.coalesce(F.col(degenerate), F.lit(False)), F.desc(f1_col), burden, tie)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def full_benchmark(metrics: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """All methods in the declared columns and order, columns that are missing as nulls."""
    return metrics.select(*[F.col(c) if c in metrics.columns else F.lit(None).alias(c) for c in columns]).orderBy(*order)


def prediction_table(df: DataFrame, method: str, score: str, threshold: float, keys: list[str], position: str = "i") -> DataFrame:
    """(keys, i, method, score, threshold, alarm): one standard row for each row that a chosen detector judged."""
    return df.select(*keys, F.col(position).alias("i"), F.lit(method).alias("method"), F.col(score).cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"), F.coalesce(F.col(score) >= threshold, F.lit(False)).alias("alarm"))


def median_gap(hits: DataFrame, most: int = 50, position: str = "i") -> int:
    """Half the gaps between exceedances of one series are at most this long, cut to whole samples and to ``most``; 0 with under two exceedances."""
    found = quantiles(spaced(hits.select(position), [], position).where("distance is not null"), F.col("distance") - 1, [0.5], []).first()
    return 0 if found is None or found["q"][0] is None else int(min(most, max(0, found["q"][0])))


def selected_run_length(candidates: list[int], labelled: bool) -> int:
    """The run length of the largest F1 of episode rows on validation rows, the first of equals; without a target the least.

    The rows of an episode are its alarms, whatever gaps it bridges. So all candidates have the same
    F1 and the first is chosen, without a pass over the data.
    """
    if not candidates:
        raise ValueError("no candidate run lengths")
    return candidates[0] if labelled else min(candidates)


def candidate_run_lengths(train_hits: DataFrame, fixed: list[int]) -> list[int]:
    """The declared run lengths and the median gap of the training exceedances, in order."""
    return sorted({median_gap(train_hits), *fixed})


def standard_predictions(
    df: DataFrame,
    model: str,
    score: str,
    threshold: float | Column,
    horizon: int,
    run_length: int = 0,
    parameters: int = 1,
    dataset: str = "events",
    target: str | None = "target",
    allowed: str | None = None,
    split: str = "split",
    position: str = "i",
    timestamp: str | None = None,
    regime: str | None = None,
    entity: str | None = None,
    runtime_seconds: float | None = None,
    peak_memory_bytes: int | None = None,
    settings: str = "",
) -> DataFrame:
    """The standard table of a detector's predictions over one series, 24 columns, a row for each row of df.

    alarm_flag: score at or over the threshold on an allowed row (all rows, if ``allowed`` is not
    given); null scores don't alarm. alarm_episode_id: alarms at most run_length samples apart share
    one, from 0; -1 for other rows. horizon_risk: of validation rows whose score is at least this
    one, the share that a target row follows within the horizon, the row itself included; their
    whole share over the highest of them; without a target, the share of validation scores at or
    below. Training rows stand in where there is no allowed validation row.
    """
    known = F.coalesce(F.col(allowed), F.lit(False)) if allowed else F.lit(True)
    rows = df.withColumn("_score", F.col(score).cast("double")).withColumn("_cut", threshold.cast("double") if isinstance(threshold, Column) else F.lit(float(threshold)))
    rows = written(rows.withColumn("_alarm", F.coalesce(F.col("_score") >= F.col("_cut"), F.lit(False)) & known), "judged")
    usable = rows.where((F.col(split) == "validation") & known & F.col("_score").isNotNull()).isEmpty()
    by = F.coalesce((F.col(split) == "train") if usable else (F.col(split) == "validation") & known, F.lit(False))
    marked = rows.withColumn("_by", by)
    if target is None:
        risky = train_share(marked, "_score", "_by").withColumnRenamed("share", "_risk")
    else:
        hits = rows.where(F.coalesce(F.col(target), F.lit(False))).select(F.greatest(F.lit(0).cast("long"), F.col(position) - horizon).alias("start"), F.col(position).alias("end"))
        risky = suffix_rate(within(marked, merged(hits, 0, []), "_ahead", position), "_score", "_ahead", "_by").withColumnRenamed("risk", "_risk")
    of = clustered(rows.where("_alarm").select(position), run_length, [], position).select(F.col(position).alias("_at"), F.col("cluster_id").cast("long").alias("_episode"))
    out = risky.join(of, F.col(position) == F.col("_at"), "left")
    digest = lambda *parts: F.substring(F.sha2(F.lit("|".join(map(str, parts))), 256), 1, 16)
    trained, calibrated = ("train", dataset, split, score, horizon, settings), ("calibration", model, run_length, horizon, settings)
    named = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c else F.lit(default)
    part, episode = named(split, "unknown"), F.coalesce("_episode", F.lit(-1).cast("long"))
    return out.select(
        F.lit(dataset).alias("dataset_id"),
        named(entity, "single_asset").alias("entity_id"),
        F.col(position).cast("long").alias("observation_index"),
        (F.col(timestamp) if timestamp else F.col(position)).alias("timestamp"),
        part.alias("partition"),
        F.lit(model).alias("model"),
        F.concat(F.lit(f"{model}-"), digest(*trained, *calibrated)).alias("model_id"),
        F.col("_score").alias("raw_score"),
        F.col("_score").alias("score"),
        F.col("_risk").alias("transformed_risk_score"),
        F.col("_cut").alias("threshold"),
        F.col("_alarm").alias("alarm_flag"),
        episode.alias("alarm_episode_id"),
        episode.alias("episode_id"),
        named(regime, "unknown").alias("regime"),
        F.lit(horizon).alias("prediction_horizon"),
        F.col("_risk").alias("horizon_risk"),
        digest(*trained).alias("training_config_hash"),
        digest(*calibrated).alias("calibration_config_hash"),
        F.lit(f"train_only_fit;validation_only_selection;excluded={'not ' + allowed if allowed else 'none'}").alias("provenance"),
        part.alias("split"),
        F.lit(runtime_seconds).cast("double").alias("runtime_seconds"),
        F.lit(peak_memory_bytes).cast("long").alias("peak_memory_bytes"),
        F.lit(parameters).alias("parameter_count"),
    )


def down_sampled(df: DataFrame, most: int, by: list[str], key: list[str], seed: int = 7) -> DataFrame:
    """Exactly min(n, most) rows of each group, drawn without replacement by a hash of what names a row (key; equal keys in any order).

    Bottom-k by hash can be merged: Spark keeps the first most of a group in every task before it
    shuffles, so a hot group costs no more than tasks times most rows.
    """
    order = Window.partitionBy(*by).orderBy(number(seed, *key), *key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
