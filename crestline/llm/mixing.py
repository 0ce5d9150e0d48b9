"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents fall into cells of (source, language, topic). The cells' token weights are raked to the
targets of one marginal after the other until all hold. A document is then kept with a probability
that is proportional to its cell's weight, at most 1, calibrated so that the expected number of
tokens is the budget; kept documents carry the weight that brings the expectation back to the
raked weight, so the weighted sample meets the targets.

Nulls in source, language or topic form a class of their own, ``?``. Null and empty texts have no
tokens and are kept with their cell's probability. The draw is a hash of doc_id, so equal ids are
kept or dropped together and any run repeats it. An empty table gives an empty result. Columns of
the input other than those named are left alone, but for one named mix, which is replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.shared import free_names, written

MARGINALS = ("source", "lang", "topic")
#: Cells of one partition while raking, and the most that are broadcast to the documents.
CELLS_AT_ONCE = 50_000


def n_tokens(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def genre(text: Column, tokens: Column) -> Column:
    """A topic for tables without one, from the form of the whole text."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    lines = F.regexp_count(text, F.lit(r"\n")) + 1
    return F.when(tokens == 0, "empty").when(5 * symbols > tokens, "symbols").when(tokens < 50, "fragment").when(tokens < 8 * lines, "lists").otherwise("prose")


def tempered(cells: DataFrame, by: str, power: float) -> DataFrame:
    """(by, target): a marginal's observed token shares, raised to a power and normalised."""
    sums = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("s")).withColumn("s", F.pow("s", F.lit(power)))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all")))).select(by, (F.col("s") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, per_round: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """cells (keys, tokens) with weight: sums of tokens * weight meet the shares of every marginal in targets.

    targets: marginal -> (marginal, target share). Classes without a target get weight 0. Targets that
    the cells can't meet together, or at all, are warned of; the weights are then the nearest found. The cells'
    number is that of the combinations that occur; beyond CELLS_AT_ONCE they are dealt by key.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    few = cells.count() <= CELLS_AT_ONCE
    out = cells.withColumn("weight", F.lit(1.0))
    for m, t in targets.items():
        out = out.join(t.select(m, F.col("target").alias(f"{m}_target")), m, "left").withColumn(f"{m}_target", F.coalesce(f"{m}_target", F.lit(0.0)))
    out = written(out, "rake")
    for _ in range(rounds):
        one = out.coalesce(1) if few else out
        for _ in range(per_round):
            for m in targets:
                now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
                one = one.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"{m}_target") * total / now).otherwise(0.0))
        out = written(one, "rake")
        worst = 0.0
        for m in targets:
            gap = out.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"), F.first(f"{m}_target").alias("t"), F.sum("tokens").alias("n")).where("n > 0")
            worst = max(worst, gap.agg(F.max(F.abs(F.col("now") / max(1, total) - F.col("t")))).first()[0] or 0.0)
        if worst < tolerance:
            break
    else:
        warnings.warn(f"the targets can't all be met by these cells: a marginal is off by {worst:.2g} of all tokens after {rounds * per_round} sweeps", stacklevel=2)
    for m, t in targets.items():
        if lost := t.where("target > 0").join(cells.where("tokens > 0"), m, "left_anti").count():
            warnings.warn(f"{lost} classes of {m} have a target but no tokens", stacklevel=2)
    return out.drop(*[f"{m}_target" for m in targets])


def calibrated(cells: DataFrame, budget_share: float, passes: int = 5, steps: int = 32) -> DataFrame:
    """cells with keep: weight times one constant, at most 1, so that the expected tokens are budget_share of all (or as near as weights allow).

    What a constant spends grows with it, so each pass is one aggregate over the cells for a row of
    constants, and the next looks between the two that enclose the budget; no window spans the cells.
    """
    mass, have = F.col("tokens") * F.col("weight"), F.col("weight") > 0
    total, reachable, least, most = cells.agg(F.sum("tokens"), F.sum(F.when(have, F.col("tokens"))), F.min(F.when(have, F.col("weight"))), F.max("weight")).first()
    if not total or not reachable:
        return cells.withColumn("keep", F.least(F.lit(1.0), F.col("weight")) if not total else F.lit(0.0))
    budget = budget_share * total
    if budget >= reachable:
        return cells.withColumn("keep", F.when(have, 1.0).otherwise(0.0))
    # at low no cell is kept whole and too little is spent, at high all are
    low, high = 0.0, 1.0 / least
    grid = [1.0 / most * (most / least) ** (k / steps) for k in range(steps)] if most > least else []
    for _ in range(passes):
        grid = [c for c in grid if low < c < high]
        if not grid:
            break
        tried = cells.crossJoin(F.broadcast(cells.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, grid))).alias("c"))))
        spent = tried.groupBy("c").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("c") * F.col("weight"))).alias("s")).orderBy("c").collect()
        for c, x in spent:
            low, high = (c, high) if x <= budget else (low, min(high, c))
        grid = [low + (high - low) * k / steps for k in range(1, steps)]
    # between the two the cells that are kept whole are known, and the constant of the others follows
    whole = F.lit(low) * F.col("weight") >= 1
    full, rest = cells.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(mass))).first()
    constant = (budget - full) / rest if rest else low
    return cells.withColumn("keep", F.least(F.lit(1.0), F.lit(float(constant)) * F.col("weight")))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 (included) to 1 for each key."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, budget_share: float = 0.5, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, seed: int = 17, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """docs with struct column ``mix`` (source, lang, topic, tokens, weight, keep, sampled, sample_weight).

    Without targets, each marginal's observed token shares are flattened by its power. Token counts
    are pre-aggregated by cell, so a hot source costs no more than any other.
    """
    tokens = n_tokens(F.col(text))
    keys = F.struct(F.coalesce(F.col(source), F.lit("?")).alias("source"), F.coalesce(F.col(lang), F.lit("?")).alias("lang"), F.coalesce(topic if topic is not None else genre(F.col(text), tokens), F.lit("?")).alias("topic"), tokens.alias("tokens"))
    own, cell = free_names(docs, "_mix_keys", "_mix_cell")
    marked = docs.withColumn(own, keys)
    cells = written(marked.groupBy(*[F.col(f"{own}.{m}").alias(m) for m in MARGINALS]).agg(F.sum(f"{own}.tokens").alias("tokens")), "cells")
    powers = powers or {"source": 0.5, "lang": 0.7, "topic": 0.7}
    wanted = targets or {m: tempered(cells, m, powers[m]) for m in MARGINALS}
    fitted = written(calibrated(rake(cells, wanted), budget_share).select(F.struct(*MARGINALS, "weight", "keep").alias(cell)), "fitted")
    side = F.broadcast(fitted) if fitted.count() <= CELLS_AT_ONCE else fitted
    joined = marked.join(side, [F.col(f"{own}.{m}") == F.col(f"{cell}.{m}") for m in MARGINALS])
    keep, weight = F.col(f"{cell}.keep"), F.col(f"{cell}.weight")
    sampled = draw(F.col(id_col), seed) < keep
    full = F.struct(f"{own}.*", weight.alias("weight"), keep.alias("keep"), sampled.alias("sampled"), F.when(sampled, weight / keep).alias("sample_weight"))
    return joined.select(*[F.col(c) for c in docs.columns if c != "mix"], full.alias("mix"))
