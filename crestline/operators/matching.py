"""One-to-one matching of alarms to failures by an order of preference, and the plain overlap metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.evaluation import best_of, matched, normalised_lead  # noqa: F401
from crestline.session import written


def in_order(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The pairs that are taken when all are gone through in the order, skipping alarms and failures already taken.

    A pair that comes first among the rest for both its alarm and its failure is taken whatever
    happens elsewhere, so each round takes all of those at once; a chain of conflicts sets the
    number of rounds. The order must be total.
    """
    left, taken = written(pairs, "pairs"), None
    while True:
        first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
        now = written(left.withColumn("_a", first("alarm_id")).withColumn("_f", first("failure_id")).where("_a and _f").drop("_a", "_f"), "taken")
        if now.isEmpty():
            return now if taken is None else taken
        taken = now if taken is None else taken.unionByName(now)
        left = written(left.join(now.select("alarm_id"), "alarm_id", "left_anti").join(now.select("failure_id"), "failure_id", "left_anti").select(*pairs.columns), "pairs")


def greedy(pairs: DataFrame) -> DataFrame:
    """Cheapest pairs first, then earlier failures, then earlier alarms."""
    return in_order(pairs, ["cost", "f_start", "a_start", "failure_id", "alarm_id"])


def matches(pairs: DataFrame, method: str = "greedy", reuse: bool = False) -> DataFrame:
    """Eligible pairs -> assignments: each failure's best alarm if alarms may serve twice, else one to one, greedy or at least total cost."""
    if method not in ("greedy", "optimal"):
        raise ValueError("method must be greedy or optimal")
    if reuse:
        return best_of(pairs)
    return greedy(pairs) if method == "greedy" else matched(pairs)


def assignment_utility(lead: Column, reward: float = 1.0, late: float = 1.0) -> Column:
    return reward - late * F.greatest(F.lit(0), -lead)


def overlaps(alarms: DataFrame, failures: DataFrame, span: int = 1_000) -> DataFrame:
    """(alarm_id, a_start, failure_id, f_start, apart) of alarms and failures that share a sample; met in cells of span samples."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / span), F.floor(F.col(b) / span)))
    left = alarms.select("alarm_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), cells("start", "end").alias("cell"))
    right = failures.select("failure_id", F.col("start").alias("f_start"), F.col("end").alias("f_end"), cells("start", "end").alias("cell"))
    met = left.join(right, "cell").where((F.col("a_start") <= F.col("f_end")) & (F.col("f_start") <= F.col("a_end")))
    return met.select("alarm_id", "a_start", "failure_id", "f_start", F.abs(F.col("a_start") - F.col("f_start")).alias("apart")).distinct()


def overlap_metrics(alarms: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: precision, recall, f1, false_alarms, missed, duplicate_rate, mean_lead of overlap matching, where each failure in turn takes the nearest free alarm."""
    pairs = written(overlaps(alarms, failures), "overlaps")
    tp = in_order(pairs, ["f_start", "failure_id", "apart", "a_start", "alarm_id"]).agg(F.count("*").alias("tp"))
    each = pairs.groupBy("failure_id", "f_start").agg(F.count("*").alias("n"), F.min("a_start").alias("first"))
    sums = each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("double"), F.avg((F.col("f_start") - F.col("first")).cast("double")).alias("mean_lead"))
    counts = alarms.agg(F.count("*").alias("alarms")).crossJoin(failures.agg(F.count("*").alias("failures")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("alarms")), share(F.col("tp"), F.col("failures"))
    return tp.crossJoin(sums).crossJoin(counts).select(p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"), (F.col("alarms") - F.col("tp")).alias("false_alarms"), (F.col("failures") - F.col("tp")).alias("missed"), share(F.col("double"), F.col("failures")).alias("duplicate_rate"), "mean_lead")
