"""Resampling: replicates as rows. Exceedances are packed up to a bounded number a row; what a replicate needs of longer series is joined from summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions.draws import BITS, number, share
from crestline.operators import blocks
from crestline.operators.episodes import clusters, spaced
from crestline.operators.series import SPAN, same_key
from crestline.session import written


def cube_root_block(n: Column) -> Column:
    """Block length of circular blocks."""
    return F.greatest(F.lit(2), F.round(F.pow(n, F.lit(1 / 3)))).cast("long")


def square_root_block(run_length: int):
    """Block length of moving blocks."""
    return lambda n: F.greatest(F.lit(run_length + 1), F.floor(F.sqrt(n))).cast("long")


def block_draws(sizes: DataFrame, entity: list[str], replicates: int, block: Column, circular: bool, seed: int) -> DataFrame:
    """(entity, replicate, _out, _s, _e): the parts [_s, _e) of a series that stand at _out in a replicate, until it is as long as the series.

    Moving blocks lie in the series; circular ones may wrap around, which gives two parts.
    """
    rows = sizes.where("n > 0").select(*entity, F.col("n").alias("_n"), block.alias("_b")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_b")))))
    starts = F.col("_n") if circular else F.greatest(F.lit(1), F.col("_n") - F.col("_b") + 1)
    rows = rows.withColumn("_s", number(seed, *entity, "replicate", "_k") % starts).withColumn("_out", F.col("_k") * F.col("_b"))
    end = F.col("_s") + F.least(F.col("_b"), F.col("_n") - F.col("_out"))
    part = lambda out, s, e: F.struct(out.alias("_out"), s.alias("_s"), e.alias("_e"))
    whole = part(F.col("_out"), F.col("_s"), F.least(end, F.col("_n")))
    wrapped = part(F.col("_out") + F.col("_n") - F.col("_s"), F.lit(0).cast("long"), end - F.col("_n"))
    return rows.select(*entity, "replicate", F.explode(F.when(end <= F.col("_n"), F.array(whole)).otherwise(F.array(whole, wrapped))).alias("_p")).select(*entity, "replicate", "_p.*")


def block_summaries(hits: DataFrame, parts: DataFrame, entity: list[str], run_length: int, position: str = "i", span: int = SPAN) -> DataFrame:
    """parts with hits, _first, _last and _opened: exceedances of the series in [_s, _e), and clusters that begin in it after the first of them.

    The parts' ends are put among the exceedances in order and take their counts from there. Ranges
    of span positions are gone through on their own; a range gets sums of those around it.
    """
    edges = parts.select(*entity, "replicate", "_out", "_s", "_e", F.explode(F.array(F.struct(F.col("_s").alias("_x"), F.lit(0).alias("_side")), F.struct(F.col("_e").alias("_x"), F.lit(1).alias("_side")))).alias("_edge"))
    edges = edges.select(*entity, "replicate", "_out", "_s", "_e", F.col("_edge._x").alias("_x"), F.col("_edge._side").alias("_side"), F.lit(0).alias("_hit"), F.lit(0).alias("_opens"))
    marks = spaced(hits, entity, position, span).select(*entity, *[F.lit(None).cast("long").alias(c) for c in ("replicate", "_out", "_s", "_e")], F.col(position).alias("_x"), F.lit(2).alias("_side"), F.lit(1).alias("_hit"), F.when(F.col("distance") - 1 <= run_length, 0).otherwise(1).alias("_opens"))
    rows = edges.withColumn("replicate", F.col("replicate").cast("long")).unionByName(marks).withColumn("_range", F.floor(F.col("_x") / span))
    mark = F.when(F.col("_hit") == 1, F.struct("_x", "_opens"))
    sums = rows.groupBy(*entity, "_range").agg(F.sum("_hit").alias("_h"), F.sum("_opens").alias("_o"), F.max(F.when(F.col("_hit") == 1, F.col("_x"))).alias("_l"), F.min(mark).alias("_f"))
    before = Window.partitionBy(*entity).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*entity).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*entity, "_range"]
    side = sums.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_h"), F.coalesce(F.sum("_o").over(before), F.lit(0)).alias("_o"), F.max("_l").over(before).alias("_l"), F.min("_f").over(after).alias("_f"))
    # an end comes before an exceedance at its own place, which lies after it
    past = Window.partitionBy(*keys).orderBy("_x", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    coming = Window.partitionBy(*keys).orderBy(F.desc("_x"), F.desc("_hit")).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(side, same_key(rows, side, keys)).select(*[rows[c] for c in rows.columns], (F.col("_h") + F.sum("_hit").over(past)).alias("_upto"), (F.col("_o") + F.sum("_opens").over(past)).alias("_open_upto"), F.greatest("_l", F.max(F.when(F.col("_hit") == 1, F.col("_x"))).over(past)).alias("_last"), F.least("_f", F.min(mark).over(coming)).alias("next"))
    at = lambda c, k: F.max(F.when(F.col("_side") == k, F.col(c)))
    both = met.where("_hit = 0").groupBy(*entity, "replicate", "_out", "_s", "_e").agg((at("_upto", 1) - at("_upto", 0)).alias("hits"), (at("_open_upto", 1) - at("_open_upto", 0)).alias("_opening"), at("_last", 1).alias("_last"), at("next", 0).alias("_next"))
    return both.where("hits > 0").select(*entity, "replicate", "_out", "_s", "_e", "hits", F.col("_next._x").alias("_first"), "_last", (F.col("_opening") - F.col("_next._opens")).alias("_opened"))


def joined(summaries: DataFrame, entity: list[str], run_length: int) -> DataFrame:
    """(entity, replicate, hits, clusters, theta): the summaries of a replicate's parts put together in order."""
    order = Window.partitionBy(*entity, "replicate").orderBy("_out")
    begins, ends = F.col("_out") + F.col("_first") - F.col("_s"), F.col("_out") + F.col("_last") - F.col("_s")
    apart = summaries.withColumn("_gap", begins - F.lag(ends).over(order) - 1)
    opens = F.col("_opened") + F.when(F.col("_gap") <= run_length, 0).otherwise(1)
    return apart.groupBy(*entity, "replicate").agg(F.sum("hits").alias("hits"), F.sum(opens).alias("clusters"), (F.sum(opens) / F.sum("hits")).alias("theta"))


#: Exceedances of a series that may be one row, and blocks of it that are drawn at once.
PACKED, DRAWN = 50_000, 1_000_000


def _parted(rows: DataFrame, keys: DataFrame, entity: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows without and with those keys."""
    side = keys.select(*[F.col(c).alias(f"_k_{c}") for c in entity])
    on = same_key(rows, side, entity)
    return rows.join(side, on, "left_anti"), rows.join(side, on, "left_semi")


def packed_index(hits: DataFrame, sizes: DataFrame, entity: list[str], run_length: int, replicates: int, block: Column, circular: bool, seed: int, position: str = "i") -> DataFrame:
    """(entity, theta): as joined(), one row a replicate with exceedances, of series whose exceedances are one row each. block is a column of sizes' n."""
    packed = hits.groupBy(*entity).agg(F.sort_array(F.collect_list(F.col(position).cast("long"))).alias("_at"))
    side = sizes.where("n > 0").select(*[F.col(c).alias(f"_k_{c}") for c in entity], F.col("n").cast("long").alias("_n"), block.cast("long").alias("_b"))
    met = packed.join(side, same_key(packed, side, entity)).select(*entity, "_at", "_n", "_b")
    # so many replicates at a time that their blocks are about DRAWN
    step = F.greatest(F.lit(1), F.floor(F.lit(DRAWN) / F.ceil(F.col("_n") / F.col("_b")))).cast("int")
    rows = met.withColumn("_step", step).withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.least(F.col("_step"), F.lit(replicates)))))
    words = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in entity])
    rows = rows.select(F.struct(*[F.col(c) for c in entity]).alias("_key") if entity else F.lit(0).alias("_key"), words.alias("_words"), "_at", "_n", "_b", "_first", F.least(F.lit(replicates + 1), F.col("_first") + F.col("_step")).alias("_end"))
    # the rows are few bytes and much work, so their number of tasks isn't left to their size
    rows = rows.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_words", "_first")
    out = rows.mapInArrow(blocks.thetas(run_length, circular), f"_key {rows.schema['_key'].dataType.simpleString()}, thetas array<double>")
    return out.select(*([F.col("_key")[c].alias(c) for c in entity]), F.explode("thetas").alias("theta"))


def bootstrap_index(hits: DataFrame, sizes: DataFrame, entity: list[str], run_length: int, replicates: int = 200, confidence: float = 0.95, circular: bool = True, block=None, seed: int = 7, position: str = "i", span: int = SPAN) -> DataFrame:
    """(entity, theta, low, high, valid): the runs index of each series with a percentile interval from block bootstraps.

    hits: (entity, position) of the exceedances, sizes: (entity, n). Circular blocks have the cube
    root of n as length, moving ones its square root, unless block says otherwise. A replicate of a
    series is a number of drawn starts. The exceedances of a series are one row, up to PACKED of them,
    and its replicates are drawn where that row is, a bounded number of blocks a task, so nothing but
    exceedances is shuffled. Of longer series blocks are summed up where the exceedances are: no such
    series is in one place and a replicate costs as many rows as it has blocks.
    """
    block = block or (cube_root_block if circular else square_root_block(run_length))
    hits = written(hits.select(*entity, position), "hits")
    drawn, counts = None, hits.groupBy(*entity).agg(F.count("*").alias("_hits")) if PACKED else None
    if PACKED:
        many = written(counts.where(F.col("_hits") > PACKED), "long-series")
        long = not many.isEmpty()
        short, rest = _parted(hits, many, entity) if long else (hits, None)
        drawn = packed_index(short, sizes, entity, run_length, replicates, block(F.col("n")), circular, seed, position)
        some = _parted(sizes, many, entity)[1] if long else None
    else:
        long, rest, some = True, hits, sizes
    if long:
        parts = block_draws(some, entity, replicates, block(F.col("n")), circular, seed)
        apart = joined(block_summaries(rest, parts, entity, run_length, position, span), entity, run_length).select(*entity, "theta")
        drawn = drawn.unionByName(apart) if drawn is not None else apart
    tail = (1 - confidence) / 2
    bounds = drawn.groupBy(*entity).agg(F.percentile("theta", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"), F.count("*").cast("int").alias("valid"))
    whole = spaced(hits, entity, position, span).groupBy(*entity).agg((F.sum(F.when(F.col("distance") - 1 <= run_length, 0).otherwise(1)) / F.count("*")).alias("theta"))
    out = sizes.select(*entity)
    for side in (whole, bounds):
        keyed = side.select(*[F.col(c).alias(f"_k_{c}") for c in entity], *[c for c in side.columns if c not in entity])
        out = out.join(keyed, same_key(out, keyed, entity), "left").drop(*[f"_k_{c}" for c in entity])
    return out.select(*entity, "theta", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), F.coalesce("valid", F.lit(0)).alias("valid"))


#: Parts of a unit in which random gaps are measured; whole numbers add up the same in any order.
GAP_UNITS = 1 << 20


def spread(intervals: DataFrame, n: int, replicates: int, keys: list[str], seed: int = 7, span: int = SPAN) -> DataFrame:
    """(keys, replicate, start, end): the intervals of each key in random order at random places of n samples.

    Lengths and numbers are kept and no two intervals touch, as at least one sample lies between
    them (none, if there is no room for it). The free samples are dealt out by exponential gaps, so
    all ways to place them are equally likely; starts are running sums over ranges of a hash.
    Intervals that don't fit into n samples are an error of the caller and raise.
    """
    rows = written(intervals.select(*keys, "start", (F.col("end") - F.col("start") + 1).alias("_length")), "intervals")
    sums = rows.groupBy(*keys).agg(F.sum("_length").alias("_total"), F.count("*").alias("_m"))
    most, longest = sums.agg(F.max("_m"), F.max("_total")).first()
    if longest and longest > n:
        raise ValueError(f"intervals of {longest} samples don't fit into {n}")
    ranges = max(1, -(-(most or 0) // span))
    apart = F.when(F.col("_total") + F.col("_m") - 1 <= n, 1).otherwise(0)
    gap = lambda *what: F.floor(-F.log(1 - share(seed, *what)) * GAP_UNITS).cast("long") + 1
    every = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    turn = rows.withColumn("replicate", every).withColumn("_turn", number(seed, *keys, F.lit("turn"), "replicate", "start"))
    turn = turn.withColumn("_gap", gap(*keys, F.lit("gap"), "replicate", "start")).withColumn("_range", F.floor(F.col("_turn") * F.lit(float(ranges)) / F.lit(float(1 << BITS))))
    group = [*keys, "replicate"]
    inside = Window.partitionBy(*group, "_range").orderBy("_turn", "start")
    placed = turn.withColumn("_gaps", F.sum("_gap").over(inside)).withColumn("_lengths", F.sum("_length").over(inside) - F.col("_length")).withColumn("_nth", F.row_number().over(inside) - 1)
    parts = turn.groupBy(*group, "_range").agg(F.sum("_gap").alias("_g"), F.sum("_length").alias("_l"), F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    side = parts.select(*[F.col(c).alias(f"_k_{c}") for c in (*group, "_range")], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_g", "_l", "_c")], F.sum("_g").over(everything).alias("_all"))
    out = placed.join(side, same_key(placed, side, [*group, "_range"]))
    few = sums.select(*[F.col(c).alias(f"_s_{c}") for c in keys], (F.lit(n) - F.col("_total") - apart * (F.col("_m") - 1)).alias("_free"), apart.alias("_apart"))
    on = F.lit(True)
    for c in keys:
        on = on & out[c].eqNullSafe(few[f"_s_{c}"])
    out = out.join(few, on) if keys else out.crossJoin(F.broadcast(few))
    all_gaps = F.col("_all") + gap(*keys, F.lit("last"), "replicate", F.lit(""))
    start = F.floor(F.col("_free") * (F.col("_g") + F.col("_gaps")).cast("double") / all_gaps) + F.col("_l") + F.col("_lengths") + F.col("_apart") * (F.col("_c") + F.col("_nth"))
    return out.select(*group, start.cast("long").alias("start"), (start + F.col("_length") - 1).cast("long").alias("end"))


def shuffled_runs(hits: DataFrame, n: int, replicates: int, seed: int = 7, span: int = SPAN) -> DataFrame:
    """(replicate, component, i): each component's runs of consecutive exceedances, in random order at random places. Keeps run lengths and counts.

    hits: (component, i) of a series of n samples.
    """
    runs = clusters(hits, 0, ["component"]).select("component", "start", "end")
    moved = spread(runs, n, replicates, ["component"], seed, span)
    return moved.select("replicate", "component", F.explode(F.sequence("start", "end")).alias("i"))


def turned_hits(hits: DataFrame, n: int, replicates: int, seed: int = 7) -> DataFrame:
    """(replicate, component, i): each component rolled around n samples by a random offset of its own."""
    each = hits.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return each.select("replicate", "component", ((F.col("i") + number(seed, "component", "replicate") % n) % n).alias("i"))


def group_resamples(groups: DataFrame, key: str, replicates: int, seed: int = 7) -> DataFrame:
    """(replicate, key, times): how often each group is drawn, groups that aren't drawn left out. Groups, never rows, are resampled.

    Draws number 1, 2, 3... of as many as there are groups; each takes the group at a random place
    of their order by hash, so every replicate has exactly that many. The groups' places are
    numbered by ranges of the hash.
    """
    names = groups.select(F.col(key).alias("_key")).distinct().withColumn("_hash", number(seed, F.lit("place"), "_key"))
    names = written(names, "groups")
    n = names.count()
    ranges = max(1, -(-n // SPAN))
    dealt = names.withColumn("_range", F.floor(F.col("_hash") * F.lit(float(ranges)) / F.lit(float(1 << BITS))))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    firsts = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    at = dealt.join(F.broadcast(firsts), F.col("_range") == F.col("_r")).select("_key", (F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy("_hash", "_key")) - 1).alias("_place"))
    draws = groups.sparkSession.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    times = draws.select("replicate", (number(seed, F.lit("draw"), "replicate", "k") % max(1, n)).alias("_place")).groupBy("replicate", "_place").agg(F.count("*").alias("times"))
    return times.join(at, "_place").select("replicate", F.col("_key").alias(key), "times")
