"""Isolation forest: trees on bounded samples, scores by a map over all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one tree.
TREE_ROWS = 256


def _depth(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, level: int, limit: int) -> tuple:
    low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(0), np.zeros(0))
    open_ = np.flatnonzero(high > low)
    if level >= limit or len(x) <= 1 or not len(open_):
        return (level + _depth(len(x)),)
    k = int(rng.choice(open_))
    cut = float(rng.uniform(low[k], high[k]))
    left = x[:, k] < cut
    return k, cut, _grow(x[left], rng, level + 1, limit), _grow(x[~left], rng, level + 1, limit)


def _flat(tree: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree as arrays by node: feature, cut, left child (the right one follows it), length of path, and the tree's depth. A leaf is its own child, whatever the row."""
    nodes, depth, level = [tree], 0, [0]
    feature, cut, child, length = [], [], [], []
    for k, node in enumerate(nodes):  # grows as children are met
        if len(node) == 1:
            feature.append(0), cut.append(np.nan), child.append(k - 1), length.append(node[0])
            continue
        depth = max(depth, level[k] + 1)
        feature.append(node[0]), cut.append(node[1]), child.append(len(nodes)), length.append(0.0)
        nodes += node[2:]
        level += [level[k] + 1] * 2
    return np.array(feature), np.array(cut, float), np.array(child), np.array(length, float), depth


def _paths(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Length of each row's path in a flat tree; all rows go down a level at a time."""
    feature, cut, child, length, depth = tree
    wide, at = x.ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), np.intp)
    for _ in range(depth):
        # not below the cut, a NaN of a leaf among them: one place on
        node = child[node] + ~(wide[at + feature[node]] < cut[node])
    return length[node]


def isolation_scores(df: DataFrame, columns: list[str], trees: int = 100, train: str | DataFrame = "true", seed: int = 7, name: str = "isolation_score", key: str | None = None) -> DataFrame:
    """df with a score, larger for rows that are isolated sooner. Trees take TREE_ROWS * trees training rows at most; nulls count as 0.

    train: a condition on df, or the training rows. key: a column of theirs that tells equal rows
    apart; with it the draw doesn't hang on how the rows lie in partitions.
    """
    spark = df.sparkSession
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    place = F.monotonically_increasing_id() if key is None else F.col(key)
    rows = (df.where(train) if isinstance(train, str) else train).select(*filled, F.xxhash64(*filled, place).alias("_draw"))
    most = TREE_ROWS * trees
    share = min(1.0, 1.1 * most / max(1, rows.count()))
    # a row's place is in its draw, so of equal rows a part is drawn; the limit holds whatever is drawn
    some = rows.where(F.shiftrightunsigned("_draw", 33) / F.lit(float(1 << 31)) < share).orderBy("_draw").limit(most).select(*columns)
    sample = np.array([list(r) for r in some.collect()], float).reshape(-1, len(columns))
    rng = np.random.default_rng(seed)
    size = min(TREE_ROWS, max(1, len(sample)))
    forest = [_grow(sample[rng.choice(len(sample), size, replace=False)] if len(sample) else sample, rng, 0, max(1, int(np.ceil(np.log2(size))))) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(([_flat(t) for t in forest], max(1e-9, _depth(size))))

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        trees_, usual = shared.value
        values = np.ascontiguousarray(x.to_numpy(float))
        return pd.Series(2.0 ** (-np.mean([_paths(t, values) for t in trees_], axis=0) / usual))

    return df.withColumn(name, score(F.struct(*filled)))
