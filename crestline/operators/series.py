"""Series: rows of an entity in a total order, numbered from 0.

Gaps, run lengths and horizons count samples, so every analysis starts from a dense position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Series:
    """entity: columns that name a series (none: the table is one series); order: columns of a total order."""

    entity: tuple[str, ...]
    order: tuple[str, ...]
    position: str = "i"

    def window(self) -> WindowSpec:
        """By entity, in position order."""
        return Window.partitionBy(*self.entity).orderBy(self.position)


def not_nan(x: Column) -> Column:
    """NaN means missing: it becomes null, infinities stay."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """Null for NaN and infinities: what may be fitted on."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def place_among(cuts: list, value: Column) -> Column:
    """Number of cuts at or below the value; 0 for null."""
    return F.coalesce(sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0))


#: Positions (or rows) of a range that one task works through in order.
SPAN = 1_000_000


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on equal keys that takes nulls for equal; the right side's columns carry a prefix _k_."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"_k_{c}"]) for c in keys], F.lit(True))


def carried(df: DataFrame, entity: list[str], by: str, name: str, part: Column, merge: Callable[[Column], Column], descending: bool = False) -> DataFrame:
    """df with ``name``: an aggregate over all rows of the series' earlier ranges (later ones, if descending), null in the first.

    part aggregates a range, merge joins the ranges' parts. Only one row a range meets the others
    of its series, so a long series, or the one series of a table, is never in one task.
    """
    keys = [*entity, by]
    parts = df.groupBy(*keys).agg(part.alias("_part"))
    order = Window.partitionBy(*entity).orderBy(F.desc(by) if descending else F.asc(by)).rowsBetween(Window.unboundedPreceding, -1)
    side = parts.select(*[F.col(c).alias(f"_k_{c}") for c in keys], merge(F.col("_part")).over(order).alias(name))
    return df.join(side, same_key(df, side, keys), "left").drop(*[f"_k_{c}" for c in keys])


def ranges_of(df: DataFrame, number: Column, span: int = SPAN) -> list:
    """Cut points of a numeric column, so many that a range holds about span rows; the size of the data sets their number."""
    n = df.count()
    ranges = -(-n // span)
    if ranges <= 1:
        return []
    return sorted(set(df.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)], max(10_000, 50 * ranges))).first()[0] or []))


def placed_in(cuts: list, value: Column) -> Column:
    """place_among() for any number of cuts."""
    return place_among(cuts, value) if len(cuts) < 32 else F.when(value.isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)))


def with_position(df: DataFrame, series: Series, span: int = SPAN) -> DataFrame:
    """df with a dense 0-based position in each series.

    Without an entity, rows are dealt into ranges of the first order column, numbered in each,
    and shifted by the sizes of the ranges before: no window spans the table.
    """
    if series.entity:
        order = Window.partitionBy(*series.entity).orderBy(*series.order)
        return df.withColumn(series.position, F.row_number().over(order) - 1)
    first = series.order[0]
    kind = dict(df.dtypes)[first]
    number = F.unix_micros(F.col(first).cast("timestamp")) if kind.startswith("timestamp") else F.col(first).cast("double")
    cuts = ranges_of(df, number, span)
    placed = df.withColumn("_range", placed_in(cuts, number))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*series.order)) - 1
    if not cuts:  # one range, whose numbers are those of the table
        return placed.withColumn(series.position, inside.cast("long")).drop("_range")
    out = carried(placed.withColumn("_inside", inside), [], "_range", "_before", F.count("*"), F.sum)
    return out.withColumn(series.position, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_range", "_inside", "_before")


def running_sum(df: DataFrame, by: str, amount: Column, name: str, descending: bool = False, inclusive: bool = False, span: int = SPAN) -> DataFrame:
    """df with the sum of amount over the rows before each in the order of a numeric column (and the row itself, if inclusive).

    For columns of different values. Rows are dealt into ranges, summed within each, and shifted
    by the sums of the ranges before: no window spans the table.
    """
    cuts = ranges_of(df, F.col(by), span)
    placed = df.withColumn("_range", placed_in(cuts, F.col(by))).withColumn("_amount", amount)
    turn = F.desc if descending else F.asc
    inside = F.sum("_amount").over(Window.partitionBy("_range").orderBy(turn(by)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    if not cuts:
        return placed.withColumn(name, F.coalesce(inside, F.lit(0))).drop("_range", "_amount")
    out = carried(placed.withColumn("_inside", inside), [], "_range", "_before", F.sum("_amount"), F.sum, descending)
    return out.withColumn(name, F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_range", "_amount", "_inside", "_before")


def quantiles(df: DataFrame, value: Column, levels: list[float], by: list[str], accuracy: int = 10_000, every: bool = False, few: bool = False) -> DataFrame:
    """(by, n, q): exact quantiles, by linear interpolation between order statistics, of the finite values of each group.

    With every, infinities count too, and NaN as the largest value. few: the groups are so few that their bounds are
    broadcast, and the rows aren't shuffled.

    Sketches first enclose each quantile between two values; then rows below are counted, and only
    values in between, about four in ``accuracy``, are sorted. No group's values meet in one place,
    and a value that many rows share is one row. Groups without a finite value are there, with nulls.
    """
    number = value.cast("double")
    rows = df.select(*by, (number if every else finite(number)).alias("_x"))
    pad = 2 / accuracy
    ask = [min(1.0, max(0.0, q + d)) for q in levels for d in (-pad, pad)]
    # to the sketch NaN is infinite; as a value beyond all bounds it is counted apart
    inner = F.when(F.isnan("_x"), F.lit(float("inf"))).otherwise(F.col("_x")) if every else F.col("_x")
    rough = rows.groupBy(*by).agg(F.count("_x").alias("n"), F.percentile_approx(inner, ask, accuracy).alias("_a"))
    bounds = [F.struct(F.lit(q).cast("double").alias("level"), F.col("_a")[2 * k].alias("lo"), F.col("_a")[2 * k + 1].alias("hi"), F.floor((F.col("n") - 1) * F.lit(q)).alias("rank"), ((F.col("n") - 1) * F.lit(q)).alias("at")) for k, q in enumerate(levels)]
    side = rough.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.array(*bounds).alias("_b"))
    met = rows.where("_x is not null").join(F.broadcast(side) if few else side, same_key(rows, side, by)) if by else rows.where("_x is not null").crossJoin(F.broadcast(side))
    each = met.select(*by, "_x", F.explode("_b").alias("b")).select(*by, "_x", "b.*")
    # values outside the two bounds count, and the nearest of them stays, as an interpolation may need it
    low, high = F.col("_x") < F.col("lo"), F.col("_x") > F.col("hi")
    spot = F.when(low, F.lit(-1)).when(high, F.lit(1)).otherwise(F.lit(0))
    kept = F.when(spot == 0, F.col("_x"))
    counts = each.groupBy(*by, "level", "rank", "at", spot.alias("_spot"), kept.alias("_v")).agg(F.count("*").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    here = counts.withColumn("_v", F.when(F.col("_spot") < 0, F.col("_max")).when(F.col("_spot") > 0, F.col("_min")).otherwise(F.col("_v")))
    wide = _interpolated(here, by)
    out = rough.join(wide, same_key(rough, wide, by), "left") if by else rough.crossJoin(F.broadcast(wide))
    return out.select(*by, "n", F.array(*[F.col("_m")[F.lit(q).cast("double")] for q in levels]).alias("q"))


def _interpolated(counts: DataFrame, by: list[str]) -> DataFrame:
    """(_k_.. of by, _m: quantile by level) of (by, level, rank, at, _spot, _v, _c): values and how often they are there, in the order of _spot and _v."""
    ranked = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "level").orderBy("_spot", "_v")))
    holds = lambda r: F.min(F.when(F.col("_upto") > r, F.struct("_spot", "_v")))["_v"]
    got = ranked.groupBy(*by, "level", "rank", "at").agg(holds(F.col("rank")).alias("_p"), holds(F.col("rank") + 1).alias("_q"))
    part = F.col("at") - F.col("rank")
    found = got.select(*[F.col(c).alias(f"_k_{c}") for c in by], "level", F.when((part > 0) & (F.col("_p") != F.col("_q")) & (F.col("_p") != F.lit(float("-inf"))), F.col("_p") + (F.col("_q") - F.col("_p")) * part).otherwise(F.col("_p")).alias("_z"))
    return found.groupBy(*[f"_k_{c}" for c in by]).agg(F.map_from_entries(F.collect_list(F.struct("level", "_z"))).alias("_m"))


def column_quantiles(df: DataFrame, columns: dict[str, tuple[Column, list[float]]], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact quantiles of the finite values of each column at its levels, as quantiles() has them; nulls for a column without any.

    For a few columns of one table: they are sketched side by side, and values are counted where they are.
    Only those between two bounds, about four in ``accuracy``, become rows and are sorted; the bounds
    and the quantiles are all that meets the driver.
    """
    names, pad = [*columns], 2 / accuracy
    rows = df.select(*[finite(columns[c][0].cast("double")).alias(f"_x{k}") for k, c in enumerate(names)])
    ask = [[min(1.0, max(0.0, q + d)) for q in columns[c][1] for d in (-pad, pad)] for c in names]
    rough = rows.agg(*[F.struct(F.count(f"_x{k}").alias("n"), F.percentile_approx(f"_x{k}", a, accuracy).alias("a")).alias(f"_r{k}") for k, a in enumerate(ask)]).first()
    ends, sums, inner = [], [], []
    for k, c in enumerate(names):
        n, bounds, x = rough[f"_r{k}"]["n"], rough[f"_r{k}"]["a"], F.col(f"_x{k}")
        for j, level in enumerate(columns[c][1] if n else []):
            lo, hi, key = bounds[2 * j], bounds[2 * j + 1], (k, float(level), int((n - 1) * level), float((n - 1) * level))
            # equal values at a bound are counted there; what lies above both has the rest
            sums += [F.struct(F.count_if(x < lo).alias("below"), F.max(F.when(x < lo, x)).alias("before"), F.count_if(x == lo).alias("lo"), F.count_if(x == hi).alias("hi"), F.min(F.when(x > hi, x)).alias("after")).alias(f"_s{len(ends)}")]
            ends.append((key, lo, hi, n))
            inner += [((x > lo) & (x < hi), F.struct(F.lit(k).alias("name"), F.lit(key[1]).alias("level"), F.lit(key[2]).cast("long").alias("rank"), F.lit(key[3]).alias("at"), x.alias("_v")))] if lo < hi else []
    if not ends:
        return {c: [None] * len(columns[c][1]) for c in names}
    met = rows.agg(*sums).first()
    known = []
    for b, (key, lo, hi, n) in enumerate(ends):
        one = met[f"_s{b}"]
        spots = [(-2, one["before"], one["below"]), (-1, lo, one["lo"]), *([(1, hi, one["hi"])] if lo < hi else []), (2, one["after"], n)]
        known += [(*key, *s) for s in spots if s[1] is not None]
    counts = df.sparkSession.createDataFrame(known, "name int, level double, rank long, at double, _spot int, _v double, _c long")
    if inner:
        between = F.filter(F.array(*[F.when(hit, one) for hit, one in inner]), lambda e: e.isNotNull())
        few = rows.where(reduce(Column.__or__, [hit for hit, _ in inner])).select(F.explode(between).alias("e")).select("e.name", "e.level", "e.rank", "e.at", F.lit(0).alias("_spot"), "e._v")
        counts = counts.unionByName(few.groupBy(*few.columns).agg(F.count("*").alias("_c")))
    found = {r["_k_name"]: r["_m"] for r in _interpolated(counts, ["name"]).collect()}
    return {c: [found.get(k, {}).get(float(level)) for level in columns[c][1]] for k, c in enumerate(names)}


def split_label(position: Column, n: Column, train: float = 0.6, validation: float = 0.2) -> Column:
    """train, validation or test by position: contiguous, sizes cut to whole rows."""
    a = F.floor(n * train)
    b = a + F.floor(n * validation)
    return F.when(position < a, "train").when(position < b, "validation").otherwise("test")
