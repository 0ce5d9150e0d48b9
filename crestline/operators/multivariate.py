"""Extremes of several components: which exceed together, and after what lag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions.draws import BITS, number
from crestline.operators import blocks
from crestline.operators.episodes import clusters, merged
from crestline.operators.resampling import GAP_UNITS, shuffled_runs, turned_hits
from crestline.operators.series import carried, placed_in, ranges_of, running_sum
from crestline.session import written


def simultaneous(flags: DataFrame, components: list[str]) -> DataFrame:
    """(vector, n): which components exceed in the same row, as a+b, or none."""
    label = F.concat_ws("+", *[F.when(F.col(c), F.lit(c)) for c in components])
    return flags.groupBy(F.when(label == "", "none").otherwise(label).alias("vector")).agg(F.count("*").alias("n"))


def tail_dependence(flags: DataFrame, components: list[str]) -> DataFrame:
    """(left, right, joint, n_left, n_right, right_given_left, left_given_right) of all pairs, in one pass."""
    pairs = [(a, b) for k, a in enumerate(components) for b in components[k + 1 :]]
    sums = flags.agg(*[F.count_if(F.col(c)).alias(f"n_{c}") for c in components], *[F.count_if(F.col(a) & F.col(b)).alias(f"j_{a}_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"j_{a}_{b}").alias("joint"), F.col(f"n_{a}").alias("n_left"), F.col(f"n_{b}").alias("n_right")) for a, b in pairs]))
    share = lambda n: F.when(F.col(n) > 0, F.col("joint") / F.col(n)).otherwise(F.lit(0.0))
    return sums.select(rows.alias("p")).select("p.*").withColumn("right_given_left", share("n_left")).withColumn("left_given_right", share("n_right"))


def exceedances_long(flags: DataFrame, components: list[str], position: str = "i", entity: list[str] | None = None) -> DataFrame:
    """(entity, i, component) of the exceedances alone."""
    each = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in components]), lambda c: c.isNotNull())
    return flags.select(*(entity or []), F.col(position).alias("i"), F.explode(each).alias("component"))


def lag_surface(hits: DataFrame, max_lag: int, window: int | None = None) -> DataFrame:
    """(source, target, lag, n) of ordered pairs of different components.

    Positions are dealt into cells of window samples; a source meets the targets of its own cell
    and the next, so the join is on equal keys and no exceedance meets one out of reach.
    """
    size = max(1, window or max_lag + 1)
    if size <= max_lag:
        raise ValueError("window must exceed max_lag")
    source = hits.select(F.col("component").alias("source"), F.col("i").alias("si"), F.explode(F.array(F.floor(F.col("i") / size), F.floor(F.col("i") / size) + 1)).alias("cell"))
    target = hits.select(F.col("component").alias("target"), F.col("i").alias("ti"), F.floor(F.col("i") / size).alias("cell"))
    met = source.join(target, "cell").where((F.col("source") != F.col("target")) & (F.col("ti") - F.col("si")).between(0, max_lag))
    return met.groupBy("source", "target", (F.col("ti") - F.col("si")).alias("lag")).agg(F.count("*").alias("n"))


#: Counts that a task of whole_lag_surface() holds: all pairs of components at the lags of two cells.
HELD = 1 << 23


def whole_lag_surface(hits: DataFrame, components: list[str], entity: list[str], size: int | None = None) -> DataFrame:
    """(source, target, lag, n) of ordered pairs of different components at every lag from 0 to the end of a series.

    hits: (entity, component, i), i from 0. The hits of a cell of size positions are one row. It meets those of its own
    cell and of all later ones of its series, and a task counts all lags of two cells at once, so that no row stands
    for a pair. Work grows with the square of a series' cells, memory doesn't. Hits without a series meet none.
    """
    size = size or max(1, HELD // (2 * len(components) ** 2))
    names = F.array(*map(F.lit, components))
    cell = F.floor(F.col("i") / size)
    at = (F.array_position(names, F.col("component")) - 1) * size + F.col("i") - cell * size
    cells = written(hits.where(F.col("component").isin(components)).groupBy(*entity, cell.alias("_cell")).agg(F.collect_list(at.cast("int")).alias("_at")), "lag-cells")  # met twice
    source = cells.select(*entity, F.col("_cell").alias("_first"), F.col("_at").alias("source"))
    target = cells.select(*entity, F.col("_cell"), F.col("_at").alias("target"), F.explode(F.sequence(F.lit(0).cast("long"), "_cell")).alias("_first"))
    met = source.join(target, [*entity, "_first"]).select(*entity, (F.col("_cell") - F.col("_first")).alias("apart"), "source", "target")
    # cells of a series that lie as far apart are counted together; few bytes and much work, so the number of tasks isn't left to their size
    dealt = met.repartition(_tasks(hits), *entity, "apart").sortWithinPartitions("apart").select("apart", "source", "target")
    counts = dealt.mapInArrow(blocks.cell_lags(len(components), size), "source int, target int, lag long, n long").groupBy("source", "target", "lag").agg(F.sum("n").alias("n"))
    return counts.select(*[F.element_at(names, F.col(c) + 1).alias(c) for c in ("source", "target")], "lag", "n")


def _tasks(df: DataFrame) -> int:
    """A few tasks a core, but no more than partitions of a shuffle: each of them has a surface of its own to send."""
    spark = df.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def detections(flags: DataFrame, components: list[str], lags: list[int], entity: list[str], position: str = "i") -> DataFrame:
    """Rows at which every component of the pattern exceeds at its lag; patterns that pass the end of a series aren't there."""
    order = Window.partitionBy(*entity).orderBy(position)
    all_ = reduce(Column.__and__, [F.coalesce(F.lead(F.col(c), lag).over(order), F.lit(False)) for c, lag in zip(components, lags, strict=True)])
    return flags.withColumn("_found", all_).where("_found").select(*entity, position)


def pattern_clusters(found: DataFrame, window: int, run_length: int, entity: list[str], position: str = "i") -> DataFrame:
    """Detections whose windows overlap or lie within run_length: (entity, start, end)."""
    spans = found.select(*entity, F.col(position).alias("start"), (F.col(position) + window - 1).alias("end"))
    return merged(spans, run_length, entity)


def rolled(hits: DataFrame, n: int, offsets: DataFrame) -> DataFrame:
    """Null replicates: (replicate, component, i) with each component rolled by its own offset around n samples. offsets: (replicate, component, offset)."""
    return hits.join(F.broadcast(offsets), "component").select("replicate", "component", ((F.col("i") + F.col("offset")) % n).alias("i"))


def right_tail(observed: DataFrame, nulls: DataFrame, keys: list[str], replicates: int, statistic: str = "n") -> DataFrame:
    """(keys, n, p): (1 + nulls at least as large) / (replicates + 1). Replicates without a row count as 0."""
    met = observed.join(nulls.select(*keys, F.col(statistic).alias("_null")), keys, "left")
    p = (1 + F.count_if(F.col("_null") >= F.col(statistic)) + F.when(F.first(statistic) <= 0, replicates - F.count("_null")).otherwise(0)) / (replicates + 1)
    return met.groupBy(*keys, statistic).agg(p.alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", tie: list[str] | None = None) -> DataFrame:
    """tests with adjusted: the running minimum of p * m / rank from the largest p down, at most 1; null for a null p.

    Equal p share the rank of the last of them, which gives the same minimum whatever their order (tie). Distinct p are
    ranked and gone through in ranges, so no window spans the tests.
    """
    counts = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    ranked = running_sum(counts, "_p", F.col("_c"), "_rank", inclusive=True).crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("_m"))))
    raw = ranked.withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    dealt = raw.withColumn("_range", placed_in(ranges_of(raw, F.col("_p")), F.col("_p")))
    dealt = carried(dealt, [], "_range", "_later", F.min("_raw"), F.min, descending=True)
    here = F.min("_raw").over(Window.partitionBy("_range").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    side = dealt.select("_p", F.least(F.lit(1.0), here, "_later").alias("adjusted"))
    return tests.join(side, tests[p] == F.col("_p"), "left").drop("_p")


def candidate_patterns(components: list[str], max_lag: int, simultaneous: bool = True) -> list[tuple[str, str, int]]:
    """(source, target, lag) of all ordered pairs of different components and all lags."""
    if len(components) < 2 or max_lag < 0:
        raise ValueError("patterns need two components and a lag of 0 or more")
    return [(a, b, lag) for a in components for b in components if a != b for lag in range(0 if simultaneous else 1, max_lag + 1)]


def lag_detections(hits: DataFrame, entity: list[str], max_lag: int, simultaneous: bool = True, window: int | None = None) -> DataFrame:
    """(entity, source, target, lag, i) wherever a target exceeds lag samples after a source: all patterns of candidate_patterns() in one join.

    hits: (entity, component, i). Positions are dealt into cells of window samples, which are as few as the lag allows
    unless asked for otherwise; a source meets its own and the next, so wider cells mean more pairs that are out of reach.
    """
    size = max(window or 0, max_lag + 1)
    cell = F.floor(F.col("i") / size)
    source = hits.select(*entity, F.col("component").alias("source"), "i", F.explode(F.array(cell, cell + 1)).alias("_cell"))
    target = hits.select(*entity, F.col("component").alias("target"), F.col("i").alias("_ti"), cell.alias("_cell"))
    lag = (F.col("_ti") - F.col("i")).cast("long")
    return source.join(target, [*entity, "_cell"]).where((F.col("source") != F.col("target")) & lag.between(0 if simultaneous else 1, max_lag)).select(*entity, "source", "target", lag.alias("lag"), "i")


def contained(df: DataFrame, mask: str, window: int, entity: list[str], name: str = "contained", position: str = "i") -> DataFrame:
    """df with a boolean: are all window rows from this one on there and in the mask?"""
    ahead = Window.partitionBy(*entity).orderBy(position).rowsBetween(0, window - 1)
    inside = F.count_if(F.coalesce(F.col(mask), F.lit(False))).over(ahead)
    return df.withColumn(name, inside == window)


def pattern_report(found: DataFrame, entity: list[str], run_length: int = 0) -> DataFrame:
    """(source, target, lag, n, clusters, theta): detections, clusters of those whose windows lie within run_length, and their ratio."""
    keys = ["source", "target", "lag"]
    found = written(found.select(*keys, *entity, "i"), "found")  # met twice
    spans = found.select(*keys, *entity, F.col("i").alias("start"), (F.col("i") + F.col("lag")).alias("end"))
    groups = merged(spans, run_length, [*keys, *entity]).groupBy(*keys).agg(F.count("*").alias("clusters"))
    return found.groupBy(*keys).agg(F.count("*").alias("n")).join(groups, keys).withColumn("theta", F.col("clusters") / F.col("n"))


#: Null models by name: (hits, n, replicates, seed) -> (replicate, component, i).
NULL_MODELS = {"time_shift": turned_hits, "cluster_permutation": shuffled_runs}


def null_hits(hits: DataFrame, n: int, null_model: str, replicates: int, seed: int = 7) -> DataFrame:
    """(replicate, component, i): null replicates of (component, i) that keep each component's own clustering."""
    if null_model not in NULL_MODELS:
        raise ValueError(f"null_model must be one of {', '.join(NULL_MODELS)}")
    return NULL_MODELS[null_model](hits, n, replicates, seed)


#: Positions of a cell; with a lag of up to as many they fit into 16 bits.
CELL = 1 << 15


def shifted_counts(hits: DataFrame, n: int, replicates: int, seed: int, first: int, last: int, max_lag: int) -> DataFrame:
    """(replicate, source, target, lag, n): what lag_detections() counts between first and last in turned_hits(), and in the hits themselves as replicate 0.

    The hits of a component in a cell are one row. It is rolled where it is, and its positions between
    first and last go to their cells as one array each, those just behind a cell to that cell too. A
    cell of a replicate then counts all pairs and lags at once.
    """
    size = max(CELL, max_lag + 1)
    packed = hits.where("component is not null").groupBy("component", F.floor(F.col("i") / size).alias("_chunk")).agg(F.collect_list(F.col("i").cast("long")).alias("_at"))
    turns = F.array(F.lit(0).cast("long"))
    if replicates:
        turns = F.concat(turns, F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: number(seed, "component", r) % n))
    kind = hits.schema["component"].dataType.simpleString()
    pieces = packed.select("component", "_at", turns.alias("_turns")).mapInArrow(blocks.turned(n, first, last, size, max_lag), f"replicate int, cell long, component {kind}, at binary")
    return counted_cells(pieces, size, max_lag)


def counted_cells(pieces: DataFrame, size: int, max_lag: int) -> DataFrame:
    """(replicate, source, target, lag, n) of (replicate, cell, component, at)."""
    kind = pieces.schema["component"].dataType.simpleString()
    cells = pieces.groupBy("replicate", "cell").agg(F.collect_list(F.struct("component", "at")).alias("parts"))
    found = cells.select("replicate", "parts").mapInArrow(blocks.lag_counts(size, max_lag), f"replicate int, source {kind}, target {kind}, lag long, n long")
    return found.groupBy("replicate", "source", "target", "lag").agg(F.sum("n").alias("n"))


#: Positions of a chunk of runs, runs of a range of turns, replicates that are drawn in a row.
CHUNK, RANGE_RUNS, DRAWN = 1 << 18, 200_000, 8
#: Half the share of turns that are kept beyond those expected between first and last, in 1 / sqrt(runs).
MARGIN = 6.0


def permuted_counts(hits: DataFrame, n: int, replicates: int, seed: int, first: int, last: int, max_lag: int) -> DataFrame:
    """(replicate, source, target, lag, n): what lag_detections() counts between first and last in shuffled_runs(), and in the hits themselves as replicate 0.

    The runs of a component in a chunk of positions are one row, and its replicates are drawn there. As runs
    stand in the order of their turns, only those whose turns are near first and last are sent on, as their
    starts; the others are sums. A replicate of a component is then placed range by range of turns, and goes
    to its cells. Where the sums show that a run was left out that should be there (very long runs), more turns are kept.
    """
    hits = hits.where("component is not null")
    observed = shifted_counts(hits, n, 0, seed, first, last, max_lag)
    if not replicates:
        return observed
    size, kind = max(CELL, max_lag + 1), hits.schema["component"].dataType.simpleString()
    runs = written(clusters(hits, 0, ["component"]).select("component", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start") + 1).cast("long").alias("length")), "runs")
    sums = runs.groupBy("component").agg(F.sum("length").alias("total"), F.count("*").alias("m")).collect()
    if not sums:
        return observed
    if max(r["total"] for r in sums) > n:
        raise ValueError(f"intervals of {max(r['total'] for r in sums)} samples don't fit into {n}")
    totals, margin, partitions = {}, MARGIN, int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for r in sums:
        apart = 1 if r["total"] + r["m"] - 1 <= n else 0
        totals[r["component"]] = (str(r["component"]), n - r["total"] - apart * (r["m"] - 1), apart)
    packed = written(runs.groupBy("component", F.floor(F.col("start") / CHUNK).alias("_chunk")).agg(F.collect_list(F.struct("start", "length")).alias("_runs")), "packed-runs")
    while True:
        kept = []
        for r in sums:
            wide = margin / r["m"] ** 0.5
            low, high = max(0.0, first / n - wide), min(1.0, (last + 1) / n + wide)
            kept.append((r["component"], r["m"], totals[r["component"]][0], int(low * (1 << BITS)), int(high * (1 << BITS)), -(-r["m"] // RANGE_RUNS)))
        side = hits.sparkSession.createDataFrame(kept, f"_k_component {kind}, whole long, _word string, _low long, _high long, _ranges int")
        begins = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(min(DRAWN, replicates))))
        rows = packed.join(F.broadcast(side), F.col("component") == F.col("_k_component")).drop("_k_component").withColumn("_begin", begins).withColumn("_end", F.least(F.lit(replicates + 1), F.col("_begin") + DRAWN))
        # few bytes and much work, so the number of tasks isn't left to their size
        rows = rows.repartition(4 * partitions, "component", "_chunk", "_begin").drop("whole")
        drawn = rows.mapInArrow(blocks.drawn_runs(seed, GAP_UNITS), f"component {kind}, chunk long, replicate int, place int, all_gaps long, gaps long, lengths long, runs long, held int, first long, steps binary, sizes binary")
        drawn = drawn.withColumn("whole", F.element_at(F.array(*[F.lit(r["m"]) for r in sums]), F.coalesce(*[F.when(F.col("component") == F.lit(r["component"]), k + 1) for k, r in enumerate(sums)])))
        dealt = drawn.repartition(4 * partitions, "component", "replicate").sortWithinPartitions("component", "replicate", "place", "chunk")
        pieces = dealt.mapInArrow(blocks.placed_runs(seed, GAP_UNITS, totals, first, last, size, max_lag), f"replicate int, cell long, component {kind}, at binary")
        counts = written(counted_cells(pieces, size, max_lag), "permuted-counts")
        if counts.where("replicate < 0").isEmpty():
            return observed.unionByName(counts)
        margin *= 8


#: Counts of lagged pairs under each null model.
COUNTS = {"time_shift": shifted_counts, "cluster_permutation": permuted_counts}


def evaluated(hits: DataFrame, components: list[str], n: int, max_lag: int, null_model: str = "time_shift", replicates: int = 199, inside: tuple[int, int] | None = None, run_length: int = 0, patterns: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """(source, target, lag, n, clusters, theta, p, adjusted): all lagged pairs of components, or those of patterns, against a null model.

    hits: (component, i) of a series of n samples. A pattern counts where it lies whole in the
    positions inside (both ends included); p is the share of replicates that have it as often,
    adjusted over all patterns asked for, also those that are never seen. The observed series is
    replicate 0 of one plan. Replicates are counted in cells of packed positions, all lags at once.
    """
    keys = ["source", "target", "lag"]
    if null_model not in NULL_MODELS:
        raise ValueError(f"null_model must be one of {', '.join(NULL_MODELS)}")
    first, last = inside or (0, n - 1)
    asked = patterns.select(*keys) if patterns is not None else hits.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(lag).cast("long").alias("lag")) for a, b, lag in candidate_patterns(components, max_lag)])).alias("c")).select("c.*")
    hits = written(hits.select("component", "i"), "hits")
    met = COUNTS[null_model](hits, n, replicates, seed, first, last, max_lag)
    counts = written(met, "pattern-counts")
    seen = asked.join(counts.where("replicate = 0").drop("replicate"), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tested = benjamini_hochberg(written(right_tail(seen, counts.where("replicate > 0"), keys, replicates), "tests"))
    found = lag_detections(hits, [], max_lag).where(F.col("i").between(first, last))
    shape = pattern_report(found, [], run_length).select(*keys, "clusters", "theta")
    return tested.join(shape, keys, "left").select(*keys, "n", F.coalesce("clusters", F.lit(0)).alias("clusters"), "theta", "p", "adjusted")


def nested_selection(hits: DataFrame, components: list[str], n: int, max_lag: int, validation: tuple[int, int], heldout: tuple[int, int], most: int = 5, alpha: float = 0.1, **how) -> DataFrame:
    """evaluated() with split: the patterns chosen in the validation positions, and how these, and they alone, do in the held-out ones."""
    chosen = written(top_patterns(evaluated(hits, components, n, max_lag, inside=validation, **how), most, alpha), "chosen")
    seed = how.pop("seed", 7)
    again = evaluated(hits, components, n, max_lag, inside=heldout, patterns=chosen, seed=seed + 1, **how)
    return chosen.withColumn("split", F.lit("validation")).unionByName(again.withColumn("split", F.lit("heldout")))


def top_patterns(reports: DataFrame, most: int, alpha: float, p: str = "adjusted") -> DataFrame:
    """At most most patterns that are there and whose adjusted p is at most alpha: least p first, then more detections, shorter lags and the components' names."""
    return reports.where((F.col(p) <= alpha) & (F.col("n") > 0)).orderBy(p, F.desc("n"), "lag", "source", "target").limit(most)
