"""Tail models: generalised Pareto fits of excesses, return levels, and thresholds that adapt."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators.series import finite, quantiles, same_key
from crestline.session import written

#: Passes that narrow a tail's profile after the first grid, and the steps of each.
ROUNDS, STEPS = 6, 32


def fit_pareto(excesses: np.ndarray) -> tuple[float, float] | None:
    """(shape, scale) of the largest likelihood with location 0, by its one-parameter profile; None under 3 excesses."""
    x = np.asarray(excesses, float)
    x = x[np.isfinite(x) & (x > 0)]
    if len(x) < 3:
        return None
    return _fit_profile(float(x.mean()), float(x.max()), lambda ts: np.array([np.log1p(t * x).mean() for t in ts]))


#: The first grid of t, from below: in parts of 1 / top, and in parts of 1 / mean.
BELOW, ABOVE = np.linspace(0, 1, 60), np.geomspace(1e-6, 50, 120)
#: Passes that narrow the best of the grid to its neighbours, and their steps: to 1e-10 of a step of the grid.
NARROWINGS, PARTS = 9, np.linspace(0, 1, 28)


def _fit_profile(mean: float, top: float, mean_log: Callable[[np.ndarray], np.ndarray]) -> tuple[float, float]:
    """(shape, scale) from the excesses' mean, their largest, and mean(log(1 + t x)) as a function of t = shape / scale, of many t at once.

    The best shape for a given t is that mean, which leaves a function of t alone, searched on a
    grid that is narrowed to the neighbours of its best place.
    """

    def losses(ts: np.ndarray) -> np.ndarray:
        flat = np.abs(ts) * mean < 1e-9
        out = np.where(flat, np.log(mean) + 1, np.inf)
        sound = np.flatnonzero(~flat & (1 + ts * top > 0))
        shapes = mean_log(ts[sound])
        scales = shapes / ts[sound]
        fine = scales > 0
        out[sound[fine]] = np.log(scales[fine]) + shapes[fine] + 1
        return out

    grid = np.concatenate([-0.999 / top * (1e-6 / 0.999 * top / mean) ** BELOW, [0.0], ABOVE / mean])
    for k in range(NARROWINGS + 1):
        best = int(losses(grid).argmin())
        a, b = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
        if k < NARROWINGS:
            grid = a + (b - a) * PARTS
    t = (a + b) / 2
    if abs(t) * mean < 1e-9:
        return 0.0, mean
    shape = float(mean_log(np.array([t]))[0])
    return shape, float(shape / t)


def return_level(base: float, shape: float, scale: float, rate: float, tail: float) -> float:
    """Level that a row exceeds with probability tail, given that rate of rows exceed base."""
    ratio = rate / tail
    return base + scale * np.log(ratio) if abs(shape) < 1e-9 else base + scale / shape * (ratio**shape - 1)


def profiled(over: DataFrame, entity: list[str], x: str = "x") -> DataFrame:
    """(entity, fit): fit_pareto of all excesses of each entity. The profile's sums over a grid of t are aggregates, and each pass narrows the grid to the best step's neighbours."""
    sound = over.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.col(x) > 0) & (F.col(x) < float("inf")))
    stats = written(sound.groupBy(*entity).agg(F.count("*").alias("m"), F.avg(x).alias("mean"), F.max(x).alias("top")).where("m >= 3"), "tails")
    steps = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: k / n)
    below = F.transform(steps(59), lambda k: -0.999 / F.col("top") * F.pow(1e-6 / 0.999 * F.col("top") / F.col("mean"), k))
    above = F.transform(steps(119), lambda k: 1e-6 / F.col("mean") * F.pow(F.lit(50 / 1e-6), k))
    grids = stats.select(*entity, F.concat(below, F.array(F.lit(0.0)), above).alias("ts"))
    loss = F.when(F.abs("t") * F.col("mean") < 1e-9, F.log("mean") + 1).when(F.col("s") / F.col("t") > 0, F.log(F.col("s") / F.col("t")) + F.col("s") + 1).otherwise(F.lit(float("inf")))
    for _ in range(ROUNDS + 1):
        tried = sound.join(grids, entity).select(*entity, x, F.explode("ts").alias("t")).groupBy(*entity, "t").agg(F.avg(F.log1p(F.col("t") * F.col(x))).alias("s"))
        rows = tried.join(stats, entity).select(*entity, "mean", F.struct("t", loss.alias("loss"), "s").alias("g")).groupBy(*entity, "mean").agg(F.sort_array(F.collect_list("g")).alias("g"))
        k = F.array_position("g.loss", F.array_min("g.loss")).cast("int")
        at = lambda i: F.element_at("g", i)
        best = written(rows.select(*entity, "mean", at(F.greatest(k - 1, F.lit(1)))["t"].alias("low"), at(F.least(k + 1, F.size("g")))["t"].alias("high"), at(k).alias("best")), "tails")
        grids = best.select(*entity, F.transform(steps(STEPS), lambda k: F.col("low") + (F.col("high") - F.col("low")) * k).alias("ts"))
    flat = F.abs("best.t") * F.col("mean") < 1e-9
    return best.select(*entity, F.struct(F.when(flat, 0.0).otherwise(F.col("best.s")).alias("shape"), F.when(flat, F.col("mean")).otherwise(F.col("best.s") / F.col("best.t")).alias("scale")).alias("fit"))


def pareto_by(df: DataFrame, value: str, entity: list[str], quantile: float, target: float, least: int = 50) -> DataFrame:
    """(entity, base, n_excesses, shape, scale, level): the tail over each series' quantile and its return level.

    With fewer than least excesses the level is the empirical quantile. A fit takes in all excesses.
    """
    cuts = written(quantiles(df, F.col(value), [quantile, target], entity).select(*entity, F.col("q")[0].alias("base"), F.col("q")[1].alias("empirical"), "n"), "cuts")
    over = written(df.join(cuts, entity).where(F.col(value) > F.col("base")).select(*entity, (F.col(value) - F.col("base")).alias("x")), "excesses")
    kept = over.groupBy(*entity).agg(F.count("*").alias("n_excesses"))
    enough = over.join(kept.where(F.col("n_excesses") >= least), entity, "left_semi")
    kept = kept.join(profiled(enough, entity), entity, "left")

    both = cuts.join(kept, entity, "left")
    ratio = (F.col("n_excesses") / F.col("n")) / (1 - target)
    level = F.when(F.abs(F.col("fit.shape")) < 1e-9, F.col("base") + F.col("fit.scale") * F.log(ratio)).otherwise(F.col("base") + F.col("fit.scale") / F.col("fit.shape") * (F.pow(ratio, F.col("fit.shape")) - 1))
    return both.select(*entity, "base", F.coalesce("n_excesses", F.lit(0)).alias("n_excesses"), F.col("fit.shape").alias("shape"), F.col("fit.scale").alias("scale"), F.coalesce(F.when(ratio > 1, level), F.col("empirical")).alias("level"))


#: Steps of a tail's grid: t * unit = BEND * sinh(u), from u = LOWEST in steps of STEP, of which none is 0; it spans t * unit from about -60 to 6,000.
BEND, LOWEST, STEP, GRID = 0.02, -8.6925, 0.015, 1_463
UNIT_STEPS = BEND * np.sinh(LOWEST + STEP * np.arange(GRID))
#: Weights of six places of the grid, one apart, in the polynomial through them.
NEAR = np.array([-1.0, 5.0, -10.0, 10.0, -5.0, 1.0])
#: Largest different excesses that are kept as they are, each with its number.
TOPS = 64


class TailSums:
    """Excesses as sums of fixed size: their count, total, the TOPS largest values, and sums of log(1 + t x) of the others on a grid of t.

    unit is a typical excess and sets the grid, which is tested for means up to 20 times the unit
    and down to a twentieth of it. Sums between steps are interpolated by polynomials through six of them; the largest excesses,
    whose logarithms bend most, are exact. Fits differ from those over all excesses by less than
    0.1 % of the return level's excess (tests/core/test_tails.py).
    """

    def __init__(self, unit: float, count: int = 0, total: float = 0.0, tops: Sequence[float] = (), copies: Sequence[int] = (), sums: Sequence[float] = ()):
        self.unit, self.count, self.total = unit, count, total
        self.tops, self.copies = list(tops), list(copies)
        self.spread = len(sums) > 0  # are there others than the largest?
        self.steps = UNIT_STEPS / unit
        self.sums = np.array(sums, float) if self.spread else np.zeros(GRID)

    def add(self, x: float) -> None:
        self.count, self.total = self.count + 1, self.total + x
        k = bisect_left(self.tops, x)
        if k < len(self.tops) and self.tops[k] == x:
            self.copies[k] += 1
            return
        self.tops.insert(k, x)
        self.copies.insert(k, 1)
        if len(self.tops) > TOPS:
            self.spread = True
            inside, n = 1 + self.steps * self.tops.pop(0), self.copies.pop(0)
            self.sums = self.sums + n * np.log(np.where(inside > 0, inside, np.nan))  # a t that one excess rules out stays out

    def fit(self) -> tuple[float, float]:
        first = int(np.isnan(self.sums).sum()) if self.spread else 0
        tops, copies = np.array(self.tops), np.array(self.copies)
        slopes = self.sums / self.steps if self.spread else None  # smooth through t = 0

        def mean_log(ts: np.ndarray) -> np.ndarray:
            if not self.spread:
                return np.log1p(ts[:, None] * tops) @ copies / self.count
            at = (np.arcsinh(ts * self.unit / BEND) - LOWEST) / STEP
            k = np.minimum(np.maximum(first, at.astype(np.int64) - 2), GRID - 6)
            gaps = (at - k)[:, None] - np.arange(6)
            near = NEAR / np.where(gaps == 0, 1e-12, gaps)
            rest = ts * (near * slopes[k[:, None] + np.arange(6)]).sum(1) / near.sum(1)
            return (rest + np.log1p(ts[:, None] * tops) @ copies) / self.count

        return _fit_profile(self.total / self.count, self.tops[-1], mean_log)


class Adaptive:
    """An adaptive threshold: the return level of the tail over a base, refitted when excesses come in. Its state has a fixed size at most."""

    def __init__(self, base: float, tail: float, excesses: Sequence[float] = (), unit: float | None = None, held: Sequence | None = None):
        """held: what state() gave. A unit is taken from the excesses where none is given."""
        self.base, self.tail = base, tail
        count, total, tops, copies, sums, self.seen, self.threshold, self.fitted = held or (0, 0.0, [], [], [], 0, base, -1)
        known = unit is not None and math.isfinite(unit) and unit > 0
        self.sums = TailSums(unit if known else float(np.mean(excesses)) if len(excesses) else 1.0, count, total, tops, copies, sums)
        for x in excesses:
            self.learn(base + x, x)

    def state(self) -> tuple:
        """(count, total, tops, copies, sums, seen, threshold, fitted), in columns of STATE."""
        s = self.sums
        return s.count, float(s.total), [float(x) for x in s.tops], [int(n) for n in s.copies], s.sums.tolist() if s.spread else [], self.seen, float(self.threshold), self.fitted

    def learn(self, value: float, excess: float | None = None) -> None:
        """Takes in a training value; those not over the base, and infinite ones, say nothing of the tail."""
        x = value - self.base if excess is None else excess
        if x > 0 and math.isfinite(x):
            self.sums.add(float(x))

    def step(self, value: float) -> float:
        """The threshold that holds for the value."""
        if self.sums.count >= 3 and self.sums.count != self.fitted:
            self.threshold = return_level(self.base, *self.sums.fit(), self.sums.count / max(1, self.seen + 1), self.tail)
            self.fitted = self.sums.count
        self.seen += 1
        if self.base < value <= self.threshold:
            self.learn(value)
        return self.threshold


#: What a stream holds of a key.
STATE = "count long, total double, tops array<double>, copies array<long>, sums array<double>, seen long, threshold double, fitted long"


def tail_of(quantile: float) -> float:
    return max(1e-4, 1 - quantile)


def adaptive_bases(rows: DataFrame, value: str, entity: list[str], quantile: float = 0.9) -> DataFrame:
    """(entity, base, unit) of training rows: the quantile over which a tail begins, and the mean excess over it; null without any."""
    base = written(quantiles(rows, F.col(value), [quantile], entity).select(*[F.col(c).alias(f"_k_{c}") for c in entity], F.col("q")[0].alias("base")), "bases")
    x = F.when(finite(F.col(value).cast("double")) > F.col("base"), F.col(value) - F.col("base"))
    return rows.join(base, same_key(rows, base, entity)).groupBy(*entity, "base").agg(F.avg(x).alias("unit"))


def adaptive_thresholds(df: DataFrame, value: str, entity: list[str], order: list[str], train_share: float = 0.6, quantile: float = 0.9) -> DataFrame:
    """Rows of each series (entity, order columns, value) with threshold and exceeds; sequential within a series, parallel over series.

    A series' threshold starts from the excesses of its training share, then each row is judged and
    those between base and threshold are learned. A task reads its series' rows in order, batch by
    batch (the sort may spill), and holds one state of fixed size. NaN and infinite values are judged
    but not learned; rows without a value are left out; without a finite training value the threshold is null.
    """
    at = F.row_number().over(Window.partitionBy(*entity).orderBy(*order)) - 1
    rows = written(df.select(*entity, *order, value).where(F.col(value).isNotNull()).withColumn("_at", at), "series")
    sizes = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in entity]).agg(F.greatest(F.lit(1), F.floor(train_share * F.count("*"))).alias("_train"))
    train = rows.join(sizes, same_key(rows, sizes, entity)).where("_at < _train").select(*entity, *order, value, "_at")
    fitted = adaptive_bases(train, value, entity, quantile)
    fitted = written(fitted.select(*[F.col(c).alias(f"_k_{c}") for c in entity], F.col("base").alias("_base"), F.col("unit").alias("_unit")), "fitted")

    both = train.withColumn("_live", F.lit(False)).unionByName(rows.withColumn("_live", F.lit(True)))
    placed = both.join(fitted, same_key(both, fitted, entity)).where(F.col("_live") | (F.col(value) > F.col("_base"))).withColumn("_series", F.struct(*entity) if entity else F.lit(0))
    placed = placed.select(F.to_json(F.struct("_series")).alias("_series"), *entity, *order, value, "_at", "_base", "_unit", "_live")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_at").schema) + ", threshold double, exceeds boolean"
    tail, kept = tail_of(quantile), [*entity, *order, value]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, model = None, None
        for pdf in parts:
            x, cuts = pdf[value].to_numpy(float), np.full(len(pdf), np.nan)
            live = pdf["_live"].to_numpy(bool)
            for k, (name, base, unit) in enumerate(zip(pdf["_series"], pdf["_base"], pdf["_unit"], strict=True)):
                if name != series:
                    series, model = name, None if pd.isna(base) else Adaptive(base, tail, unit=unit)
                if live[k]:
                    cuts[k] = np.nan if model is None else model.step(x[k])
                else:
                    model.learn(x[k])
            yield pdf[kept].assign(threshold=cuts, exceeds=x > cuts)[live]

    # one task has all rows of a series: training excesses, then every row in its order
    return placed.repartition("_series").sortWithinPartitions("_series", "_live", "_at").mapInPandas(run, schema)
