"""Alarms against labelled failures: windows, matches, and what they are worth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.episodes import covered
from crestline.operators.series import SPAN, carried, placed_in, running_sum
from crestline.session import written


@dataclass(frozen=True)
class Policy:
    """Samples that an alarm may come before and after a failure's onset."""

    horizon: int = 3_600
    before: int = 0
    after: int = 300


@dataclass(frozen=True)
class Costs:
    """What outcomes are worth."""

    detection: float = 1.0
    false_alarm: float = 0.2
    missed: float = 2.0
    duplicate: float = 0.1
    late: float = 0.05
    warning_time: float = 0.0


def windows(failures: DataFrame, policy: Policy) -> DataFrame:
    """failures with w_start and w_end, the samples at which an alarm is a warning."""
    return failures.withColumn("w_start", F.greatest(F.lit(0).cast("long"), F.col("start") - policy.horizon - policy.before)).withColumn("w_end", F.col("start") + policy.after)


def eligible(alarms: DataFrame, failures: DataFrame, policy: Policy, cell: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, alarm_id, a_start, a_end, failure_id, f_start, lead, cost) of alarms that overlap a failure's window; by: columns of the alarms that name a method.

    Both sides are dealt into cells of the window's width, so the range join is an equi-join;
    cost prefers the earliest alarm inside the window.
    """
    size = cell or max(1, policy.horizon + policy.before + policy.after + 1)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    left = alarms.select(*(by or []), "alarm_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), span("start", "end").alias("cell"))
    right = windows(failures, policy).select("failure_id", F.col("start").alias("f_start"), "w_start", "w_end", span("w_start", "w_end").alias("cell"))
    met = left.join(right, "cell").where((F.col("a_start") <= F.col("w_end")) & (F.col("w_start") <= F.col("a_end")))
    met = met.where(F.col("cell") == F.greatest(F.floor(F.col("a_start") / size), F.floor(F.col("w_start") / size)))
    inside = F.col("a_start").between(F.col("w_start"), F.col("w_end"))
    lead = F.col("f_start") - F.col("a_start")
    cost = F.when(inside, -lead).otherwise(F.least(F.abs(F.col("a_start") - F.col("w_start")), F.abs(F.col("a_start") - F.col("w_end"))) + 10_000)
    return met.select(*(by or []), "alarm_id", "a_start", "a_end", "failure_id", "f_start", lead.alias("lead"), cost.alias("cost"))


def best_of(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each failure's cheapest eligible alarm; what an optimal matching is when no alarm is eligible for two failures."""
    order = Window.partitionBy(*(by or []), "failure_id").orderBy("cost", "a_start", "alarm_id")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def matched(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Minimum-cost one-to-one matching. Failures that share alarms form groups, and each group is solved on its own.

    Groups are those of failures whose windows overlap; they are small because failures are. A failure
    on its own takes its cheapest alarm, so only larger groups are solved in Python, each as one row
    and many in a call.
    """
    by = by or []
    spans = pairs.groupBy(*by, "failure_id").agg(F.min("a_start").alias("lo"), F.max("a_end").alias("hi"))
    order = Window.partitionBy(*by).orderBy("lo", "failure_id")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = spans.withColumn("_open", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("_group", F.sum("_open").over(order))
    groups = groups.select(*by, "failure_id", "_group", F.count("*").over(Window.partitionBy(*by, "_group")).alias("_failures"))
    kept = [*by, "alarm_id", "failure_id", "lead", "cost"]
    met = written(pairs.join(groups, [*by, "failure_id"]).select(*kept, "_group", "_failures"), "met")
    cheapest = F.row_number().over(Window.partitionBy(*by, "failure_id").orderBy("cost", "alarm_id"))
    alone = met.where("_failures = 1").withColumn("_r", cheapest).where("_r = 1").select(*kept)
    tables = met.where("_failures > 1").groupBy(*by, "_group").agg(F.collect_list(F.struct("failure_id", "alarm_id", "cost", "lead")).alias("_p"))
    solve = F.pandas_udf(_solve, "array<int>")
    solved = tables.select(*by, "_p", solve(F.col("_p.failure_id"), F.col("_p.alarm_id"), F.col("_p.cost")).alias("_taken"))
    pair = F.explode(F.transform("_taken", lambda k: F.get("_p", k))).alias("_one")
    return alone.unionByName(solved.select(*by, pair).select(*by, "_one.alarm_id", "_one.failure_id", "_one.lead", "_one.cost"))


def _solve(failures: pd.Series, alarms: pd.Series, costs: pd.Series) -> pd.Series:
    """Places of the pairs that are taken, of each row's group."""
    return pd.Series([_assign(f, a, c) for f, a, c in zip(failures, alarms, costs, strict=True)], dtype=object)


def _assign(failures: np.ndarray, alarms: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Shortest augmenting paths over one group's cost table."""
    rows, row = np.unique(failures, return_inverse=True)
    cols, col = np.unique(alarms, return_inverse=True)
    big = 10**9
    cost = np.full((len(rows), max(len(cols), len(rows))), big, dtype=np.int64)
    cost[row, col] = costs
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for r in range(1, n + 1):
        owner[0], j, least, way, used = r, 0, np.full(m + 1, 4 * big), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            free = np.flatnonzero(~used[1:]) + 1
            k = free[least[free].argmin()]
            delta = least[k]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
        while j:
            owner[j], j = owner[way[j]], way[j]
    return np.flatnonzero((owner[col + 1] == row + 1) & (costs < big)).astype(np.int32)


def outcomes(alarms: DataFrame, failures: DataFrame, policy: Policy, assigned: DataFrame | None = None) -> DataFrame:
    """(kind, id): true_positive (failure), false_alarm and duplicate (alarm), missed (failure)."""
    pairs = eligible(alarms, failures, policy)
    assigned = best_of(pairs) if assigned is None else assigned
    taken = assigned.select("alarm_id", "failure_id")
    false = alarms.join(pairs.select("alarm_id").distinct(), "alarm_id", "left_anti").select(F.lit("false_alarm").alias("kind"), F.col("alarm_id").alias("id"))
    missed = failures.join(taken, "failure_id", "left_anti").select(F.lit("missed").alias("kind"), F.col("failure_id").alias("id"))
    # eligible for a failure that another alarm is assigned to
    double = pairs.join(taken.select("failure_id", F.col("alarm_id").alias("_a")), "failure_id").where(F.col("alarm_id") != F.col("_a")).select("alarm_id").distinct().select(F.lit("duplicate").alias("kind"), F.col("alarm_id").alias("id"))
    return taken.select(F.lit("true_positive").alias("kind"), F.col("failure_id").alias("id")).unionByName(false).unionByName(double).unionByName(missed)


def normalised_lead(lead: Column, policy: Policy) -> Column:
    """Lead over the length of the warning window, from -1 to 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), lead / max(1, policy.horizon + policy.before + policy.after)))


def _rates(policy_costs: Costs, n: int, per_day: int) -> list[Column]:
    """What follows from the counts tp, false_alarms, duplicates, missed, and from late and time_under_warning."""
    tp, fa, dup, miss = (F.col(c) for c in ("tp", "false_alarms", "duplicates", "missed"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = share(tp, tp + fa + dup), share(tp, tp + miss)
    c = policy_costs
    utility = c.detection * tp - c.late * F.col("late") - c.false_alarm * fa - c.missed * miss - c.duplicate * dup - c.warning_time * F.col("time_under_warning")
    per = (fa * per_day / n) if n else F.lit(None).cast("double")
    return [precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"), per.alias("false_alarms_per_day"), share(dup, tp + miss).alias("duplicates_per_failure"), utility.alias("utility")]


def evaluated_by(alarms: DataFrame, failures: DataFrame, by: list[str], groups: DataFrame, policy: Policy, n: int, per_day: int, costs: Costs = Costs()) -> DataFrame:
    """One row of event metrics for each of the groups (by), those without an alarm among them, against the same failures; alarms are assigned one to one at least cost.

    alarms: (by, alarm_id, start, end), alarm_id different within a group.
    """
    pairs = written(eligible(alarms, failures, policy, by=by), "pairs")
    taken = written(matched(pairs, by), "taken")
    leads = taken.groupBy(*by).agg(F.count("*").alias("tp"), F.max("lead").cast("double").alias("earliest_lead"), F.percentile("lead", F.lit(0.5)).alias("median_lead"), F.sum(F.greatest(F.lit(0), -F.col("lead"))).alias("late"), F.avg(normalised_lead(F.col("lead"), policy)).alias("normalised_lead"))
    made = alarms.groupBy(*by).agg(F.count("*").alias("predicted_alarm_events"))
    near = pairs.select(*by, "alarm_id").distinct().groupBy(*by).agg(F.count("*").alias("_near"))
    double = pairs.join(taken.select(*by, "failure_id", F.col("alarm_id").alias("_a")), [*by, "failure_id"]).where(F.col("alarm_id") != F.col("_a")).select(*by, "alarm_id").distinct()
    twice = double.groupBy(*by).agg(F.count("*").alias("duplicates"))
    out = groups
    for part in (made, near, leads, twice, covered(alarms, by).withColumnRenamed("samples", "time_under_warning")):
        out = out.join(part, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = out.crossJoin(F.broadcast(failures.agg(F.count("*").alias("target_events"))))
    out = out.select(*by, "target_events", zero("predicted_alarm_events"), zero("_near"), zero("tp"), zero("duplicates"), zero("late"), zero("time_under_warning"), "earliest_lead", "median_lead", "normalised_lead")
    out = out.withColumn("false_alarms", F.col("predicted_alarm_events") - F.col("_near")).withColumn("missed", F.col("target_events") - F.col("tp"))
    return out.select("*", *_rates(costs, n, per_day)).drop("_near", "late")


def evaluated(alarms: DataFrame, failures: DataFrame, policy: Policy, n: int, per_day: int, costs: Costs = Costs(), assigned: DataFrame | None = None, risk: DataFrame | None = None, bins: int = 10) -> DataFrame:
    """One row of event metrics.

    risk: (probability, outcome) rows of a horizon risk; with it come horizon_brier and
    calibration_bins (bin, n, mean_probability, event_rate, low, high), else both are null.
    """
    assigned = best_of(eligible(alarms, failures, policy)) if assigned is None else assigned
    count = lambda k: F.count_if(F.col("kind") == k)
    sums = outcomes(alarms, failures, policy, assigned).agg(count("true_positive").alias("tp"), count("false_alarm").alias("false_alarms"), count("duplicate").alias("duplicates"), count("missed").alias("missed"))
    leads = assigned.agg(F.max("lead").cast("double").alias("earliest_lead"), F.percentile("lead", F.lit(0.5)).alias("median_lead"), F.coalesce(F.sum(F.greatest(F.lit(0), -F.col("lead"))), F.lit(0)).alias("late"), F.avg(normalised_lead(F.col("lead"), policy)).alias("normalised_lead"))
    under = covered(alarms, []).agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("time_under_warning"))
    both = sums.crossJoin(leads).crossJoin(under)
    each = both.select("tp", "false_alarms", "duplicates", "missed", "earliest_lead", "median_lead", "time_under_warning", "normalised_lead", *_rates(costs, n, per_day))
    shape = "array<struct<bin:int,n:bigint,mean_probability:double,event_rate:double,low:double,high:double>>"
    if risk is None:
        return each.withColumn("horizon_brier", F.lit(None).cast("double")).withColumn("calibration_bins", F.lit(None).cast(shape))
    table = reliability(risk, "probability", "outcome", bins).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "mean_probability", "event_rate", "low", "high"))).cast(shape).alias("calibration_bins"))
    return each.crossJoin(brier(risk, "probability", "outcome").select(F.col("brier").alias("horizon_brier"))).crossJoin(table)


def brier(df: DataFrame, probability: str, outcome: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(probability) - F.col(outcome).cast("double"), F.lit(2))).alias("brier"), F.count("*").alias("n"))


def bin_of(probability: Column, bins: int) -> Column:
    """Equal-width bin by its edges: right-open, the last one closed."""
    return F.least(F.lit(bins - 1), sum((F.when(probability >= k / bins, 1).otherwise(0) for k in range(1, bins)), F.lit(0)))


def reliability(df: DataFrame, probability: str, outcome: str, bins: int) -> DataFrame:
    """(bin, n, mean_probability, event_rate) and the Wilson interval of the rate; bins without rows are absent."""
    out = df.groupBy(bin_of(F.col(probability), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(outcome).cast("double")).alias("event_rate"))
    low, high = wilson(F.col("event_rate"), F.col("n"))
    return out.withColumn("low", low).withColumn("high", high)


def wilson(rate: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    base = 1 + z * z / n
    middle = (rate + z * z / (2 * n)) / base
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / base
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def separation(df: DataFrame, score: str, inside: str) -> DataFrame:
    """auc: P(score inside > score outside) by mid-ranks. Equal scores are counted first, so ranks run over distinct values."""
    values = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(score).agg(F.count("*").alias("c"), F.count_if(F.col(inside)).alias("k"))
    ranked = running_sum(values, score, F.col("c"), "below").withColumn("mid", F.col("below") + (F.col("c") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("mid") * F.col("k")).alias("r"), F.sum("k").alias("a"), F.sum(F.col("c") - F.col("k")).alias("b"))
    return sums.select(F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))).alias("auc"), F.col("a").alias("n_inside"), F.col("b").alias("n_outside"))


def separations(df: DataFrame, scores: list[str], inside: str, span: int = SPAN) -> DataFrame:
    """(score_kind, auc) of several scores, each as separation() has it: values of all of them are counted in one pass, and ranks run within ranges of each score."""
    spark = df.sparkSession
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.col(c).cast("double").alias("x")) for k, c in enumerate(scores)])
    long = df.select(F.col(inside).alias("_in"), F.explode(each).alias("e")).select("_in", "e.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    values = written(long.groupBy("place", "x").agg(F.count("*").alias("c"), F.count_if("_in").alias("k")), "values")
    most = max([r["count"] for r in values.groupBy("place").count().collect()], default=0)
    ranges = -(-most // span)
    cuts = values.groupBy("place").agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)], max(10_000, 50 * ranges)).alias("q")).collect() if ranges > 1 else []
    at = F.coalesce(*[F.when(F.col("place") == r["place"], placed_in(sorted({*r["q"]}), F.col("x"))) for r in cuts], F.lit(0))
    order = Window.partitionBy("place", "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    dealt = values.withColumn("_range", at.cast("int")).withColumn("_inside", F.sum("c").over(order))
    ranked = carried(dealt, ["place"], "_range", "_before", F.sum("c"), F.sum)
    mid = F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0)) + (F.col("c") + 1) / 2
    a, b = F.col("a"), F.col("b")
    sums = ranked.groupBy("place").agg(F.sum(mid * F.col("k")).alias("r"), F.sum("k").alias("a"), F.sum(F.col("c") - F.col("k")).alias("b"))
    auc = sums.select("place", F.when((a > 0) & (b > 0), (F.col("r") - a * (a + 1) / 2) / (a * b)).alias("auc"))
    return spark.createDataFrame([*enumerate(scores)], "place int, score_kind string").join(F.broadcast(auc), "place", "left").select("score_kind", "auc")


def chance_match(alarms: Column, failures: Column, policy: Policy, n: Column) -> Column:
    """Probability that as many alarms placed at random match a failure."""
    return 1 - F.exp(-alarms * failures * (policy.horizon + policy.after + 1) / n)


def joint_utility(detected: Column, false_alarms_per_day: Column, coverage: Column, lead: Column, detection: float = 100.0, per_false_alarm: float = 1.0, under_warning: float = 10.0, lead_reward: float = 5.0, cap: float = 7_200.0) -> Column:
    reward = F.when(detected & lead.isNotNull(), lead_reward * F.least(F.greatest(lead, F.lit(0.0)), F.lit(cap)) / cap).otherwise(F.lit(0.0))
    return F.when(detected, F.lit(detection)).otherwise(F.lit(0.0)) - per_false_alarm * F.coalesce(false_alarms_per_day, F.lit(0.0)) - under_warning * F.coalesce(coverage, F.lit(0.0)) + reward


def split_summary(df: DataFrame, split: str, target: str, regime: str) -> DataFrame:
    """(split, n, positives, regimes): rows, positives and different regimes (a missing one counts as one) of each split."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(target), F.lit(False))).alias("positives"), (F.count_distinct(regime) + F.max(F.col(regime).isNull().cast("int"))).alias("regimes"))


def split_calibration(df: DataFrame, split: str, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """(split, bin, n, mean_probability, event_rate, low, high) of each split, and its Brier score as the row of bin -1."""
    rows = df.where(F.col(probability).isNotNull())
    hit = F.col(outcome).cast("double")
    each = rows.groupBy(split, bin_of(F.col(probability), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(hit).alias("event_rate"))
    low, high = wilson(F.col("event_rate"), F.col("n"))
    whole = rows.groupBy(split).agg(F.lit(-1).alias("bin"), F.count("*").alias("n"), F.avg(F.pow(F.col(probability) - hit, F.lit(2))).alias("mean_probability"), F.avg(hit).alias("event_rate"))
    none = F.lit(None).cast("double")
    return each.withColumn("low", low).withColumn("high", high).unionByName(whole.withColumn("low", none).withColumn("high", none))


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))
