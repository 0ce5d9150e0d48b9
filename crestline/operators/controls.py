"""Negative controls: alarms of the same number and durations that know nothing, drawn as rows and judged like the observed ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.draws import number
from crestline.operators.episodes import merged, shifted
from crestline.operators.evaluation import Policy
from crestline.operators.resampling import spread

@dataclass(frozen=True)
class Family:
    """A kind of control: which alarms it takes and how it places them.

    rare: the alarms of a rarer score in place of the observed ones, where there are any.
    place: anywhere (each alarm on its own), together (all by one random offset), in_turn (all by
    offsets that share the series out evenly among the draws).
    """

    name: str
    place: str = "anywhere"
    rare: bool = False


#: Controls that differ in one thing each.
FAMILIES = (Family("scattered"), Family("turned", "together"), Family("stepped", "in_turn"), Family("scattered_rare", rare=True), Family("turned_rare", "together", True))


def drawn(observed: DataFrame, rare: DataFrame, n: int, draws: int, seed: int = 7, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """(family, draw, start, end) of all draws of all families; alarms that are moved together are merged where they meet, those placed anywhere keep their lengths and never do.

    observed, rare: (start, end) alarms of a series of n samples; without a rare alarm the observed
    ones serve. Random places are hashes of (seed, family, draw, alarm), so a lost task draws the
    same again.
    """
    rare = observed if rare.isEmpty() else rare
    sources = observed.select(F.lit(False).alias("rare"), "start", "end").unionByName(rare.select(F.lit(True).alias("rare"), "start", "end"))
    plan = F.explode(F.array(*[F.struct(F.lit(f.name).alias("family"), F.lit(f.place).alias("place"), F.lit(f.rare).alias("of")) for f in families]))
    rows = sources.withColumn("p", plan).where("rare = p.of").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("p.family", "p.place", "draw", "start", "end")
    alone = sources.withColumn("p", plan).where("rare = p.of and p.place = 'anywhere'").select(F.col("p.family").alias("family"), "start", "end")
    alone = spread(alone, n, draws, ["family"], seed).select("family", (F.col("replicate") - 1).alias("draw"), "start", "end")
    offset = F.when(F.col("place") == "in_turn", (F.col("draw") + 1) * max(1, n // draws) % n).otherwise(1 + number(seed, "family", "draw") % max(1, n - 1))
    moved = rows.where("place <> 'anywhere'").select("family", "draw", *[(F.col(c) + offset).alias(c) for c in ("start", "end")])
    return merged(shifted(moved, n, 0), 0, ["family", "draw"]).unionByName(alone)


def judged(alarms: DataFrame, failures: DataFrame, keys: list[str], policy: Policy, n: int, per_day: int) -> DataFrame:
    """(keys, alarms, detected, false_alarms, recall, false_alarms_per_day, time_under_warning, occupancy) of many sets of alarms at once."""
    size = policy.horizon + policy.before + policy.after + 1
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    windows = failures.select("failure_id", F.greatest(F.lit(0).cast("long"), F.col("start") - policy.horizon - policy.before).alias("w_start"), (F.col("start") + policy.after).alias("w_end"))
    met = alarms.withColumn("_c", span("start", "end")).join(windows.withColumn("_c", span("w_start", "w_end")), "_c").where((F.col("start") <= F.col("w_end")) & (F.col("w_start") <= F.col("end")))
    of = met.groupBy(*keys).agg(F.count_distinct("failure_id").alias("detected"), F.count_distinct("start").alias("_met"))
    sums = alarms.groupBy(*keys).agg(F.count("*").alias("alarms"), F.sum(F.col("end") - F.col("start") + 1).alias("time_under_warning"))
    total = F.broadcast(failures.agg(F.count("*").alias("_failures")))
    both = sums.join(of, keys, "left").crossJoin(total).withColumn("detected", F.coalesce("detected", F.lit(0))).withColumn("false_alarms", F.col("alarms") - F.coalesce("_met", F.lit(0)))
    recall = F.when(F.col("_failures") > 0, F.col("detected") / F.col("_failures")).otherwise(F.lit(0.0))
    return both.select(*keys, "alarms", "detected", "false_alarms", recall.alias("recall"), (F.col("false_alarms") * per_day / n).alias("false_alarms_per_day"), "time_under_warning", (F.col("time_under_warning") / n).alias("occupancy"))


METRICS = ("recall", "false_alarms_per_day", "time_under_warning")


def summary(draws: DataFrame, observed: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(family, metric, observed_value, median, low, high, percentile, p, draws): where the observed value stands among its controls."""
    long = lambda df, name: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]))
    seen = observed.select(long(observed, "observed_value").alias("o")).select("o.*")
    each = draws.select("family", long(draws, "value").alias("d")).select("family", "d.*").join(F.broadcast(seen), "metric")
    v, o = F.col("value"), F.col("observed_value")
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = each.groupBy("family", "metric", "observed_value").agg(q.alias("q"), F.avg((v <= o).cast("double")).alias("percentile"), ((1 + F.count_if(v >= o)) / (F.count("*") + 1)).alias("p"), F.count("*").alias("draws"))
    return out.select("family", "metric", "observed_value", F.col("q")[1].alias("median"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"), "percentile", "p", "draws")


def conditions(draws: DataFrame, observed: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """draws once for each condition that admits them: all_draws, detecting_draws, recall_matched, occupancy_matched."""
    seen = observed.select(F.col("recall").alias("_recall"), F.col("occupancy").alias("_occupancy"))
    near = F.when(F.col("_occupancy") > 0, (F.col("occupancy") / F.col("_occupancy")).between(1 - tolerance, 1 + tolerance)).otherwise(F.col("occupancy") <= tolerance)
    admitted = F.array(F.lit("all_draws"), F.when(F.col("detected") > 0, F.lit("detecting_draws")), F.when(F.abs(F.col("recall") - F.col("_recall")) <= 1e-9, F.lit("recall_matched")), F.when(near, F.lit("occupancy_matched")))
    return draws.crossJoin(F.broadcast(seen)).withColumn("condition", F.explode(F.filter(admitted, lambda c: c.isNotNull()))).drop("_recall", "_occupancy")
