from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import forest, preparation, resampling, statespace, tails, transfer
from crestline.operators.preparation import ContractError


def test_pareto_recovers_its_parameters():
    rng = np.random.default_rng(1)
    for shape in (-0.2, 0.0, 0.3):
        u = rng.uniform(size=20_000)
        x = 2.0 * (-np.log(u) if shape == 0 else (u**-shape - 1) / shape)
        got = tails.fit_pareto(x)
        assert got[0] == pytest.approx(shape, abs=0.04) and got[1] == pytest.approx(2.0, abs=0.08)
    assert tails.fit_pareto(np.array([1.0, 2.0])) is None


def test_pareto_by_series(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(x)) for x in rng.exponential(1, 5_000)] + [("b", float(x)) for x in range(20)], "k string, v double")
    got = {r["k"]: r for r in tails.pareto_by(df, "v", ["k"], 0.9, 0.99).collect()}
    assert got["a"]["level"] == pytest.approx(np.log(100), rel=0.1)
    assert got["b"]["shape"] is None and got["b"]["level"] == pytest.approx(np.quantile(np.arange(20), 0.99))


def test_adaptive_threshold_is_sequential(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(1, 400)
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(x)], "s int, i long, v double").repartition(5)
    got = np.array([r["threshold"] for r in tails.adaptive_thresholds(df, "v", ["s"], ["i"]).orderBy("i").collect()])
    base = np.quantile(x[:240], 0.9)
    state = tails.Adaptive(base, 0.1, [v - base for v in x[:240] if v > base])
    assert np.allclose(got, [state.step(v) for v in x])


def test_bootstrap_and_permutation(spark):
    hits = spark.createDataFrame([(0, i) for i in range(0, 300, 10)], "s int, i long")
    got = resampling.bootstrap_index(hits, spark.createDataFrame([(0, 300)], "s int, n long"), ["s"], 2, 50).first()
    assert got["theta"] == 1.0 and got["low"] <= got["high"] <= 1.0 and got["valid"] == 50
    hits = spark.createDataFrame([(i, "a") for i in (3, 4, 5, 20, 40, 41)], "i long, component string")
    for r in resampling.shuffled_runs(hits, 60, 5).groupBy("replicate").agg(F.sort_array(F.collect_list("i")).alias("at")).collect():
        at = np.array(r["at"])
        runs = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1, [len(at)]]))
        assert len(set(r["at"])) == 6 and sorted(runs) == [1, 2, 3] and at.max() < 60


def test_isolation(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(500, 2)))] + [(500, 9.0, -9.0)]
    scored = forest.isolation_scores(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], trees=30)
    assert scored.orderBy(F.desc("isolation_score")).first()["id"] == 500


def test_paths_of_flat_trees():
    def walked(tree, row):
        while len(tree) > 1:
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree[0]

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[:5, 1] = np.nan
    for rows in (x[10:210], x[10:12], x[10:11], np.zeros((0, 3))):
        tree = forest._grow(rows, rng, 0, 8)
        assert forest._paths(forest._flat(tree), x).tolist() == [walked(tree, row) for row in x]


def test_forest_by_key_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(4)
    rows = [(k, *map(float, x)) for k, x in enumerate(np.round(rng.normal(size=(900, 2)), 1))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    score = lambda part: {r["id"]: r["isolation_score"] for r in forest.isolation_scores(part, ["a", "b"], trees=2, train=part.where("id < 700"), key="id").collect()}
    assert score(df.coalesce(1)) == score(df.repartition(7, "b"))


def test_least_distances(spark):
    rng = np.random.default_rng(2)
    groups = [rng.normal(size=(16, 3)).tolist(), rng.normal(size=(1, 3)).tolist()]
    df = spark.createDataFrame([(v,) for v in (rng.normal(size=(50, 3)) * 1e3).tolist()] + [([0.0, -0.0, 1e200],)], "v array<double>")
    plain = [F.array_min(F.transform(F.array(*[F.array(*map(F.lit, r)) for r in refs]), lambda r: statespace.distance(F.col("v"), r))) for refs in groups]
    for r in df.select(statespace.least_distances(groups, 3)("v").alias("got"), F.array(*plain).alias("want")).collect():
        assert r["got"] == r["want"]


def test_preparation(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 2.0), (2, 1, 1.0)], "v long, t long, c double")
    got = [(r["c__increment"], r["counter_reset"]) for r in preparation.increments(df, ["c"], ["v"], ["t"]).orderBy("v", "t").collect()]
    assert got == [(None, False), (2.0, False), (None, True), (None, False)]
    with pytest.raises(ContractError):
        preparation.check_no_leak({"train": df, "validation": df.where("v = 1")}, "v")
    preparation.check_no_leak({"train": df.where("v = 2"), "validation": df.where("v = 1")}, "v")
    with pytest.raises(ContractError):
        preparation.validate(df.where("v = 3"), ["c"], "t")
    with pytest.raises(ContractError):
        preparation.require_columns(df, ["nope"])
    with pytest.raises(ContractError):
        preparation.unique_join(df, df, "v")
    assert preparation.families(["hist_0", "hist_1", "counter"]) == {"hist": ["hist_0", "hist_1"], "counter": ["counter"]}
    assert preparation.with_aliases(df, {"c": "pressure", "gone": "x"}).columns == ["v", "t", "c", "pressure"]


def test_time_quality(spark):
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:01", "2024-01-01 00:00:04"])], "s int, k int, t string").withColumn("t", F.to_timestamp("t"))
    got = preparation.time_quality(df, "t", ["s"], ["k"]).first()
    assert (got["n"], got["duplicates"], got["gaps"], got["cadence"]) == (4, 1, 1, 2.0)


def test_states(spark):
    states = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    refs = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 0.0])], "ref_id long, ref array<float>")
    assert [(r["ref_id"], r["distance"]) for r in statespace.nearest(states, refs).orderBy("vec_id").collect()] == [(7, 0.0), (7, 5.0)]
    traces = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0],)], "x array<double>")
    got = preparation.trace_summary(traces, "x").orderBy("x_mean").collect()
    assert [(r["x_mean"], r["x_std"], r["x_last"]) for r in got] == [(2.0, 1.0, 3.0), (4.0, None, 4.0)]


def test_transfer(spark):
    same = spark.createDataFrame([(float(k % 50), k % 2 == 0) for k in range(1_000)], "x double, s boolean")
    assert transfer.histogram_overlap(same.withColumn("x", F.floor(F.col("x") / 2).cast("double")), "x", "s").first()["overlap"] == pytest.approx(1.0)
    apart = same.withColumn("x", F.when(F.col("s"), F.col("x")).otherwise(F.col("x") + 1_000))
    got = transfer.compatibility(apart, "x", "s").first()
    assert got["overlap"] < 0.01 and not got["compatible"]


def test_medoids_of_all_rows(spark, tmp_path):
    from crestline.plans.control_queries import medoid_references

    x = np.random.default_rng(5).normal(size=(6_001, 3))
    x[1] = [50.0, 0.0, 0.0]  # an odd key, the farthest of all; key 9 is as far, but comes later
    x[9] = x[1]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(7_000, None)], "vec_id long, embedding array<double>")
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    chosen, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < 16:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
    got = sorted(r["vec_id"] for r in medoid_references(spark, str(tmp_path)).collect())
    assert got == sorted(chosen) and 1 in got and 9 not in got
    few = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [4.0])], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in statespace.medoids(few, "vec_id", "embedding", 16).collect()) == [1, 3]
    assert statespace.medoids(few.where("vec_id > 9"), "vec_id", "embedding", 16).count() == 0


def test_nearest_by_pivots_is_exact(spark, monkeypatch):
    """Many references in clusters, a hot vector, ties, NaN, nulls: the same as brute force, and as one array."""
    monkeypatch.setattr(statespace, "PIVOTS", 16)
    monkeypatch.setattr(statespace, "BLOCK", 20)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 6)) * 5
    near = [(centers[k % 12] + rng.normal(size=6) * 0.3).tolist() for k in range(1_500)]
    many = [*near, *[near[0]] * 700, [float("nan")] * 6]
    refs = [(len(many) - k, v) for k, v in enumerate(many)]
    asked = [(k, (centers[k % 12] + rng.normal(size=6) * (3 if k % 5 == 0 else 0.3)).tolist()) for k in range(300)] + [(300, near[0]), (301, None), (302, [0.0] * 6)]
    states = spark.createDataFrame(asked, "vec_id long, embedding array<double>").repartition(5)
    known = spark.createDataFrame([*refs, (-1, None)], "ref_id long, ref array<double>").repartition(6)
    got = {r["vec_id"]: (r["ref_id"], r["distance"]) for r in statespace.nearest(states, known, most=100).collect()}
    plain = {r["vec_id"]: (r["ref_id"], r["distance"]) for r in statespace.nearest(states, known).collect()}
    assert got == plain and len(got) == 303 and got[301] == (None, None)
    at, ids = np.array([v for _, v in refs]), np.array([i for i, _ in refs])
    for k, v in asked:
        if v is not None:
            d = np.linalg.norm(at - v, axis=1)
            least = np.nanmin(d)
            assert got[k][1] == pytest.approx(least, abs=1e-9) and d[ids == got[k][0]][0] == pytest.approx(least, abs=1e-9)
    assert got[300] == (min(i for i, v in refs if v == near[0]), 0.0)


def test_nearest_by_pivots_of_one_vector(spark):
    """All references equal: one pivot, whose ring has no width."""
    refs = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(50)], "ref_id long, ref array<double>")
    states = spark.createDataFrame([(1, [1.0, 1.0]), (2, [4.0, 5.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["ref_id"], r["distance"]) for r in statespace.nearest(states, refs, most=10).collect()}
    assert got == {1: (0, 0.0), 2: (0, 5.0)}
