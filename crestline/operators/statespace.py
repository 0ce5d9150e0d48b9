"""State vectors: robust scaling, distance to reference states, dangerous regions."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators import matrices
from crestline.operators.series import quantiles
from crestline.session import written


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) of the columns' values."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")


def robust_scales(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(column, center, scale): median and interquartile range, 1 where the range is at most least."""
    long = _long(df, columns)
    q = quantiles(long.where(F.col("x").isNotNull() & ~F.isnan("x")), F.col("x"), [0.25, 0.5, 0.75], ["column"], every=True, few=True)
    spread = F.col("q")[2] - F.col("q")[0]
    return q.select("column", F.col("q")[1].alias("center"), F.when(spread > least, spread).otherwise(F.lit(1.0)).alias("scale"))


def max_abs_z(df: DataFrame, columns: list[str], scales: DataFrame, name: str = "score") -> DataFrame:
    """df with the largest absolute robust z over the columns; nulls are passed over, all null gives 0."""
    wide = scales.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("center", "scale")))).alias("_scales"))
    z = [F.abs(F.col(c) - F.col("_scales")[c]["center"]) / F.col("_scales")[c]["scale"] for c in columns]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return df.crossJoin(F.broadcast(wide)).withColumn(name, F.coalesce(score, F.lit(0.0))).drop("_scales")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def least_distances(groups: Iterable[list[list[float]]], size: int):
    """A function of a column of arrays of size coordinates: the distance to the nearest reference of each group, as an array.

    Squares are summed by coordinate in order, so the distances are those of distance().
    """
    known = [np.array(refs, float).reshape(-1, size).T for refs in groups]

    @F.pandas_udf("array<double>")
    def least(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, size))
        return pd.Series(list(np.stack([_least_of(x.T, refs) for refs in known], axis=1)), dtype=object)

    return least


def _least_of(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distance of each state to the nearest reference; both by coordinate."""
    with np.errstate(over="ignore"):
        return np.sqrt(sum((c[None, :] - r[:, None]) ** 2 for c, r in zip(x, refs, strict=True)).min(axis=0))


def least_distance_columns(groups: dict[str, list[list[float]]], columns: list[str]) -> Column:
    """least_distances() of a state whose coordinates are columns, as a struct with a field for each group: no array is made or taken apart for a row."""
    known = {name: np.array(refs, float).reshape(-1, len(columns)).T for name, refs in groups.items()}

    @F.pandas_udf(", ".join(f"{name} double" for name in known))
    def least(states: pd.DataFrame) -> pd.DataFrame:
        x = [np.ascontiguousarray(states.iloc[:, k].to_numpy(float)) for k in range(len(columns))]
        return pd.DataFrame({name: _least_of(x, refs) for name, refs in known.items()})

    return least(F.struct(*columns))


#: References that are sent to all tasks as one array; more of them lie in blocks, which meet blocks of states.
MOST_REFERENCES = 64
#: Pivots, references of a block, and states of a block, about.
PIVOTS, BLOCK, STATES = 128, 16_384, 8_192


def nearest(states: DataFrame, references: DataFrame, vector: str = "embedding", key: str = "vec_id", ref_key: str = "ref_id", ref_vector: str = "ref", most: int = MOST_REFERENCES) -> DataFrame:
    """(key, ref_id, distance) of each state's nearest reference; ties go to the smallest ref_id.

    Up to ``most`` references are one array that is broadcast; more of them are searched in blocks,
    with the same result and a plan of one size. A key names one state. References without a vector
    are none; a state without a vector, or without any reference, has nulls.
    """
    sound = references.where(F.col(ref_vector).isNotNull()).select(F.col(ref_key).alias("id"), F.col(ref_vector).alias("v"))
    asked = states.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    least = _by_blocks(asked, sound) if sound.limit(most + 1).count() > most else _by_one_array(asked, sound)
    return least.select(F.col("key").alias(key), F.col("least.id").alias("ref_id"), F.col("least.d").alias("distance"))


def _least(refs: Column) -> Column:
    """(d, id) of the nearest in an array of (id, v); null where there is no vector or no reference."""
    return F.when(F.col("vector").isNotNull(), F.array_min(F.transform(refs, lambda r: F.struct(distance(F.col("vector"), r["v"]).alias("d"), r["id"].alias("id")))))


def _by_one_array(states: DataFrame, references: DataFrame) -> DataFrame:
    table = references.agg(F.collect_list(F.struct("id", "v")).alias("refs"))
    return states.crossJoin(F.broadcast(table)).select("key", _least(F.col("refs")).alias("least"))


def _by_blocks(states: DataFrame, references: DataFrame) -> DataFrame:
    """(key, least): blocks of states meet blocks of references, each pair of blocks as products of matrices.

    Some references are pivots. A reference belongs to its nearest pivot, a pivot's references to one
    block or, if they are many, to several. The nearest pivot bounds a state's search: a block goes
    without the state if the distances of its references to their pivots differ by more from the
    state's (triangle inequality). Where that spares nothing, all pairs are worked out, which takes
    time in their number, but no task holds more than two blocks. Equal vectors are one reference,
    that with the smallest id. Vectors that are odd (missing or infinite coordinates, another
    length) skip the bounds. The pivots and their blocks (PIVOTS rows) are all that meets the driver.
    """
    refs = written(references.groupBy("v").agg(F.min("id").alias("id")), "references")
    asked = written(states, "states")
    kind, key_kind = refs.schema["id"].dataType.simpleString(), asked.schema["key"].dataType.simpleString()
    drawn = [r["v"] for r in refs.where(F.size("v") > 0).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    pivots = matrices.usable(drawn)
    own = refs.mapInArrow(matrices.owner(pivots, "v"), f"v {refs.schema['v'].dataType.simpleString()}, id {kind}, pivot int, r double")
    own = written(own, "owned")
    spans = own.groupBy("pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("pivot").collect()
    places, shells, blocks = matrices.dealt(spans, BLOCK)
    parts = max(1, -(-asked.where("vector is not null").count() // STATES))

    place = F.create_map(*[F.lit(x) for p, (first, salts) in places.items() for x in (p, F.struct(F.lit(first).alias("first"), F.lit(salts).alias("salts")))])[F.col("pivot")]
    block = (place["first"] + F.pmod(F.xxhash64("id", "v"), place["salts"])).cast("int")
    left = asked.where("vector is not null").mapInArrow(matrices.sent(pivots, shells, blocks), f"key {key_kind}, vector {asked.schema['vector'].dataType.simpleString()}, blocks array<int>")
    left = left.select("key", "vector", F.pmod(F.xxhash64("key", "vector"), F.lit(parts)).cast("int").alias("part"), F.explode("blocks").alias("block"))
    right = own.select("id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(matrices.nearest, f"key {key_kind}, d double, id {kind}")
    every = found.groupBy("key").agg(F.min(F.struct("d", "id")).alias("least"))
    without = asked.where("vector is null").select("key", F.lit(None).cast(every.schema["least"].dataType).alias("least"))
    return every.unionByName(without)


def observable(d: Column, eps: float = 1e-12) -> Column:
    """Minus the logarithm of a distance: large when near."""
    return -F.log(F.greatest(d, F.lit(eps)))


def column_quantile(df: DataFrame, columns: list[str], level: float, prefix: str) -> DataFrame:
    """One row of the columns' quantiles, null for a column without values."""
    q = quantiles(_long(df, columns), F.col("x"), [level], ["column"], every=True, few=True)
    return written(q.agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"{prefix}{c}") for c in columns]), "column-quantiles")


def density_region(df: DataFrame, columns: list[str], quantile: float) -> DataFrame:
    """df with density_distance (root sum of squared deviations over the median absolute deviation, 1 if that is 0) and in_region, at or over its quantile."""
    near = df.crossJoin(F.broadcast(column_quantile(df, columns, 0.5, "_m_")))
    apart = near.select(*[F.abs(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])
    spreads = column_quantile(apart, columns, 0.5, "_s_")
    z = [(F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns]
    far = near.crossJoin(F.broadcast(spreads)).withColumn("density_distance", F.round(F.sqrt(sum((x * x for x in z), F.lit(0.0))), 9))
    cut = written(quantiles(far, F.col("density_distance"), [quantile], [], every=True).select(F.round(F.col("q")[0], 9).alias("_cut")), "cut")
    return far.crossJoin(F.broadcast(cut)).withColumn("in_region", F.col("density_distance") >= F.col("_cut")).select(*df.columns, "density_distance", "in_region")


def delayed(df: DataFrame, columns: list[str], lags: list[int], entity: list[str], position: str = "i") -> DataFrame:
    """df with column__lag_k: causal delay coordinates, null while a series is shorter."""
    w = Window.partitionBy(*entity).orderBy(position)
    return df.withColumns({f"{c}__lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}={v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def horizon_risk(df: DataFrame, distance_col: str, entity: list[str], radius: float, horizons: list[int], position: str = "i") -> DataFrame:
    """(horizon, probability, brier): share of rows followed by an entry into the region within a horizon, and the Brier score of the forward hit rate."""
    from crestline.operators.recurrence import forward_rate, horizon_outcome

    hits = df.withColumn("_hit", F.coalesce(F.col(distance_col) <= radius, F.lit(False)))
    out = None
    for h in horizons:
        rated = forward_rate(horizon_outcome(hits, "_hit", entity, h, position=position), "_hit", entity, h, position)
        one = rated.agg(F.lit(h).alias("horizon"), F.avg(F.col("outcome").cast("double")).alias("probability"), F.avg(F.pow(F.col("rate") - F.col("outcome").cast("double"), F.lit(2))).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out


def whitened(df: DataFrame, columns: list[str], regularization: float = 1e-6) -> DataFrame:
    """df with white_k: coordinates in which the Euclidean distance is the Mahalanobis one. Covariances come from one aggregate; the driver factors a small matrix."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{k}") for k, (a, b) in enumerate(pairs)]).first()
    cov = np.eye(len(columns)) * regularization
    for k, (a, b) in enumerate(pairs):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] += one[f"c_{k}"] or 0.0
        if i != j:
            cov[j, i] = cov[i, j]
    root = np.linalg.cholesky(np.linalg.inv(cov))
    centered = [F.col(c) - F.lit(float(one[f"m_{c}"] or 0.0)) for c in columns]
    return df.withColumns({f"white_{k}": sum((x * float(root[j, k]) for j, x in enumerate(centered)), F.lit(0.0)) for k in range(len(columns))})


def medoids(references: DataFrame, key: str, vector: str, count: int) -> DataFrame:
    """count references by farthest-first traversal from the smallest key; ties go to the smallest key, rows without a vector are none.

    Each pick is one pass over the references: a task keeps its farthest row alone, and only the
    vectors chosen so far are sent out.
    """
    rows = references.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    first = rows.agg(F.min(F.struct("key", "vector")).alias("best")).first()["best"]
    chosen = [first] if first is not None else []
    while chosen and len(chosen) < count:
        at = np.array([c["vector"] for c in chosen], float)

        def farthest(batches, at=at):
            best = None
            for batch in batches:
                if len(batch):
                    x, keys = np.stack(batch["vector"].to_numpy()), batch["key"].to_numpy()
                    near = np.min([np.linalg.norm(x - c, axis=1) for c in at], axis=0)
                    top = np.flatnonzero(near == near.max())
                    k = top[keys[top].argmin()] if len(top) else None
                    if k is not None and (best is None or (-near[k], keys[k]) < best[:2]):
                        best = (-near[k], keys[k], x[k])
            if best is not None:
                yield pd.DataFrame({"back": [best[0]], "key": [best[1]], "vector": [best[2]]})

        kind = rows.schema["key"].dataType.simpleString()
        best = rows.mapInPandas(farthest, f"back double, key {kind}, vector array<double>").agg(F.min(F.struct("back", "key", "vector")).alias("best")).first()["best"]
        if best is None or not best["back"] < 0:
            break  # all that is left equals a chosen one
        chosen.append(best)
    return references.where(F.col(key).isin([c["key"] for c in chosen]))
