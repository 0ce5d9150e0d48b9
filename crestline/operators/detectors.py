"""Detectors: scores of rows, their thresholds, and the policies that make alarms of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.episodes import merged, onsets
from crestline.operators.series import SPAN, carried, finite, placed_in, quantiles, ranges_of, running_sum
from crestline.session import written


def difference_score(df: DataFrame, value: str, entity: list[str], position: str = "i", span: int = SPAN) -> DataFrame:
    """Absolute first difference, 0 at the first row. Ranges of a series know the last row of those before."""
    dealt = carried(df.withColumn("_range", F.floor(F.col(position) / span)), entity, "_range", "_last", F.max(F.struct(position, value)), F.max)
    order = Window.partitionBy(*entity, "_range").orderBy(position)
    before = F.when(F.row_number().over(order) == 1, F.col(f"_last.{value}")).otherwise(F.lag(value).over(order))
    return dealt.withColumn("difference_score", F.coalesce(F.abs(F.col(value) - before), F.lit(0.0))).drop("_last", "_range")


def running_excess(df: DataFrame, value: str, entity: list[str], position: str = "i", span: int = SPAN) -> DataFrame:
    """Excess over the largest value so far, 0 at the first row. Ranges of a series know the maximum of those before."""
    dealt = carried(df.withColumn("_range", F.floor(F.col(position) / span)), entity, "_range", "_most", F.max(value), F.max)
    before = F.max(value).over(Window.partitionBy(*entity, "_range").orderBy(position).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("excess_score", F.coalesce(F.col(value) - F.greatest(before, F.col("_most")), F.lit(0.0))).drop("_most", "_range")


def changepoint_score(df: DataFrame, value: str, entity: list[str], window: int, position: str = "i") -> DataFrame:
    """Absolute difference of the medians of the last window and the one before, 0 while either has under half its rows."""
    w, least = Window.partitionBy(*entity).orderBy(position), max(2, window // 2)
    now, then = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(2 * window - 1), -window)
    median = lambda frame: F.when(F.count(value).over(frame) >= least, F.percentile(value, F.lit(0.5)).over(frame))
    return df.withColumn("changepoint_score", F.coalesce(F.abs(median(now) - median(then)), F.lit(0.0)))


def conformal_score(df: DataFrame, score: str, train: str) -> DataFrame:
    """df with tail: the share of training scores at or above each score, (1 + count) / (n + 1); null for a null score. Distinct scores are ranked once."""
    values = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(train)).alias("_k"))
    ranked = running_sum(values, score, F.col("_k"), "_above", descending=True, inclusive=True).crossJoin(F.broadcast(values.agg(F.sum("_k").alias("_n"))))
    return df.join(ranked.select(F.col(score).alias("_v"), ((1 + F.col("_above")) / (F.col("_n") + 1)).alias("tail")), df[score] == F.col("_v"), "left").drop("_v")


def risk_bins(df: DataFrame, score: str, outcome: str, levels: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(bin, n, risk): mean outcome between score quantiles."""
    cuts = quantiles(df, F.col(score), [*levels], []).select(F.col("q").alias("_c"))
    bin_ = F.aggregate("_c", F.lit(0), lambda n, c: n + (F.col(score) > c).cast("int"))
    return df.crossJoin(F.broadcast(cuts)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(outcome).cast("double")).alias("risk"))


def order_score(df: DataFrame, score: str, position: str = "i") -> DataFrame:
    """df with order_score: rank from 0 to 1, ties by position, nulls first. Ranks come from ranges of the score, not from one task."""
    n = df.count()
    placed = df.withColumn("_range", placed_in(ranges_of(df, F.col(score)), F.col(score)))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(score, position)) - 1
    out = carried(placed.withColumn("_inside", inside), [], "_range", "_before", F.count("*"), F.sum)
    return out.withColumn("order_score", (F.col("_inside") + F.coalesce("_before", F.lit(0))) / max(1, n - 1)).drop("_range", "_inside", "_before")


@dataclass(frozen=True)
class Method:
    """A declared detector: which score, at which training quantile, and what makes an alarm of its exceedances."""

    name: str
    score: str
    quantile: float
    policy: str = "flags"  # flags, decluster
    run_length: int = 0
    merge_gap: int = 0


def check_methods(methods: list[Method]) -> list[Method]:
    """The methods, if their names and their definitions are all different."""
    names, kinds = [m.name for m in methods], [(m.score, m.quantile, m.policy, m.run_length, m.merge_gap) for m in methods]
    if len({*names}) < len(names) or len({*kinds}) < len(kinds):
        raise ValueError("two methods are the same")
    return methods


def benchmark_alarms(df: DataFrame, methods: list[Method], train: str, test: str, position: str = "i", most_rate: float = 0.5) -> DataFrame:
    """(method, start, end) alarms of all methods on the test rows, as one plan.

    Each score is computed once and unpivoted to its methods; thresholds come from training rows
    only, and a method that would flag over most_rate of them makes no alarm.
    """
    check_methods(methods)
    scores = sorted({m.score for m in methods})
    df = written(df, "scores")  # quantiles, rates and alarms each go over them
    asked = {name: sorted({m.quantile for m in methods if m.score == name}) for name in scores}
    cuts = None
    for name, levels in asked.items():
        one = quantiles(df.where(train), F.col(name), levels, []).select(*[F.col("q")[levels.index(m.quantile)].alias(f"_t{k}") for k, m in enumerate(methods) if m.score == name])
        cuts = one if cuts is None else cuts.crossJoin(F.broadcast(one))
    cuts = written(cuts, "cuts")
    rates = df.where(train).crossJoin(F.broadcast(cuts)).agg(*[F.avg((F.col(m.score) > F.col(f"_t{k}")).cast("double")).alias(f"_r{k}") for k, m in enumerate(methods)])
    fitted = cuts.crossJoin(F.broadcast(rates))
    flags = [F.when((F.col(m.score) > F.round(F.col(f"_t{k}"), 9)) & (F.col(f"_r{k}") <= most_rate), F.lit(m.name)) for k, m in enumerate(methods)]
    hits = df.where(test).select(position, *scores).crossJoin(F.broadcast(fitted)).select(F.col(position).alias("i"), F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("method"))
    out = []
    for gap in sorted({m.merge_gap for m in methods if m.policy == "flags"}):
        part = hits.where(F.col("method").isin([m.name for m in methods if m.policy == "flags" and m.merge_gap == gap]))
        out.append(merged(part.select("method", F.col("i").alias("start"), F.col("i").alias("end")), gap, ["method"]))
    for run in sorted({m.run_length for m in methods if m.policy == "decluster"}):
        part = hits.where(F.col("method").isin([m.name for m in methods if m.policy == "decluster" and m.run_length == run]))
        out.append(onsets(part, run, ["method"]).select("method", F.col("i").alias("start"), F.col("i").alias("end")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def suffix_rate(df: DataFrame, score: str, outcome: str, calibration: str) -> DataFrame:
    """df with risk: the share of outcomes among calibration rows whose score is at least this one; where there is none, the share among all of them.

    Equal scores are one row, and ranges of scores are summed from the top, so nothing is sorted in one place.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(calibration)).alias("_n"), F.count_if(F.col(calibration) & F.col(outcome)).alias("_e"))
    upto = running_sum(running_sum(counts, score, F.col("_n"), "_rows", descending=True, inclusive=True), score, F.col("_e"), "_events", descending=True, inclusive=True)
    whole = F.broadcast(counts.agg((F.sum("_e") / F.sum("_n")).alias("_rate")))
    side = upto.crossJoin(whole).select(F.col(score).alias("_v"), F.when(F.col("_rows") > 0, F.col("_events") / F.col("_rows")).otherwise(F.col("_rate")).alias("risk"))
    return df.join(side, df[score] == F.col("_v"), "left").drop("_v")


def train_share(df: DataFrame, value: str, train: str) -> DataFrame:
    """df with share: the part of the training rows at or below each value (empirical distribution); null for a null value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(train)).alias("_n"))
    side = running_sum(counts, value, F.col("_n"), "_upto", inclusive=True).crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))
    return df.join(side.select(F.col(value).alias("_v"), (F.col("_upto") / F.col("_all")).alias("share")), df[value] == F.col("_v"), "left").drop("_v")


def principal_components(train: DataFrame, columns: list[str], most: int = 3) -> list[list[float]]:
    """Directions of the largest variance, the first most of them. Missing values count as 0; covariances come from one aggregate, the driver factors a small matrix."""
    import numpy as np

    x = [F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    one = train.agg(*[F.covar_pop(x[i], x[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    cov = np.zeros((len(x), len(x)))
    for k, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = one[k] or 0.0
    values, vectors = np.linalg.eigh(cov)
    return [vectors[:, k].tolist() for k in np.argsort(values)[::-1][: max(1, min(most, len(x)))]]


def projection_residual(df: DataFrame, columns: list[str], components: list[list[float]], center: list[float] | None = None, name: str = "residual") -> DataFrame:
    """df with the mean squared part of each row that the components leave over; not centred unless a center is given. Without components, the mean square."""
    shift = center or [0.0] * len(columns)
    x = [F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) - m for c, m in zip(columns, shift, strict=True)]
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    along = [total([v * float(w) for v, w in zip(x, u, strict=True)]) for u in components]
    rest = [v - total([a * float(u[j]) for a, u in zip(along, components, strict=True)]) if components else v for j, v in enumerate(x)]
    return df.withColumn(name, total([r * r for r in rest]) / len(columns))


def rarest(df: DataFrame, score: str, most: int, tie: list[str]) -> DataFrame:
    """The rows of the most highest scores: reference states of a rare-state region. Tasks keep their own highest alone."""
    return df.where(F.col(score).isNotNull()).orderBy(F.desc(score), *tie).limit(most)
