"""Matching, thresholds of unknown regimes, reference states and projections on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import detectors, matching, preparation, regions, selection, thresholds, univariate


def test_regimes_that_were_not_fitted_take_the_global_threshold(spark):
    train = spark.createDataFrame([("a", float(k)) for k in range(200)] + [("few", 1000.0)] + [(None, float(k)) for k in range(150)], "regime string, x double")
    fitted = thresholds.fit_regimes(train, "x", "regime", 0.9)
    values = {r["regime"]: (r["threshold"], r["own"]) for r in fitted.collect()}
    every = round(float(np.quantile([*range(200), 1000, *range(150)], 0.9)), 6)
    assert values["a"] == (pytest.approx(179.1), True) and values["few"] == (every, False) and values["<ANY>"] == (every, False) and values["<NA>"] == (pytest.approx(134.1), True)
    rows = spark.createDataFrame([("a", 179.5), ("new", every + 1), ("new", every - 1), (None, 135.0), ("few", every + 1), ("a", None), ("a", float("nan"))], "regime string, x double")
    got = [(r["regime"], r["exceeds"]) for r in thresholds.apply_regimes(rows, fitted, "x", "regime").collect()]
    assert sorted(got, key=str) == sorted([("a", True), ("new", True), ("new", False), (None, True), ("few", True), ("a", False), ("a", False)], key=str)


def test_components_take_their_regime_or_the_whole(spark):
    train = spark.createDataFrame([("a", float(k), float(-k)) for k in range(150)], "regime string, x double, y double")
    fitted = thresholds.fit_components(train, ["x", "y"], "regime", 0.9, train=F.col("x") < 140)
    rows = spark.createDataFrame([("a", 130.0, -100.0), ("b", 130.0, 0.0), (None, 1.0, None)], "regime string, x double, y double")
    got = {r["regime"]: (r["exceeds_x"], r["exceeds_y"]) for r in thresholds.apply_components(rows, fitted, ["x", "y"], "regime").collect()}
    assert got == {"a": (True, False), "b": (True, True), None: (False, False)}


@pytest.mark.parametrize("seed", range(3))
def test_matching_in_order_equals_going_through(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(12), rng.randrange(8)) for _ in range(40)})
    rows = [(a, a * 10, f, f * 15, rng.randrange(5)) for a, f in pairs]
    used_a, used_f, want = set(), set(), set()
    for a, _, f, _, _ in sorted(rows, key=lambda r: (r[4], r[3], r[1], r[2], r[0])):
        if a not in used_a and f not in used_f:
            used_a.add(a)
            used_f.add(f)
            want.add((a, f))
    df = spark.createDataFrame(rows, "alarm_id long, a_start long, failure_id long, f_start long, cost long")
    assert {(r["alarm_id"], r["failure_id"]) for r in matching.greedy(df).collect()} == want
    assert matching.greedy(df.where("false")).count() == 0


def test_derived_run_length(spark):
    got = spark.createDataFrame([(1.0,), (0.4,), (0.001,), (0.0,), (None,), (2 / 3,)], "theta double").select(univariate.derived_run_length(F.col("theta")).alias("k")).collect()
    assert [r["k"] for r in got] == [1, 2, 600, 1, 1, 2]


def test_provenance_and_states_are_guarded(spark):
    states = spark.createDataFrame([(1, "train", "f1", [1.0, 2.0]), (2, "train", "f2", [1.0, 3.0]), (3, "test", "f1", [0.0, 0.0]), (4, "train", None, [0.0, 1.0])], "id long, split string, failure_id string, v array<double>")
    allowed = spark.createDataFrame([("f1",)], "failure_id string")
    assert [r["id"] for r in regions.from_failures(states, allowed).collect()] == [1]
    for k in (2, 3, 4):
        with pytest.raises(regions.ProvenanceError):
            regions.check_provenance(states.where(F.col("id").isin(1, k)), allowed)
    with pytest.raises(ValueError):
        regions.from_failures(states.where("id > 1"), allowed)
    with pytest.raises(ValueError):
        regions.from_constraint(states, "id > 9")
    for bad in ([None, 1.0], [float("inf"), 0.0], None):
        with pytest.raises(ValueError):
            regions.check_states(spark.createDataFrame([(1, bad)], "id long, v array<double>"), "v")
    with pytest.raises(preparation.ContractError):
        preparation.unique_columns(spark.sql("select 1 as a, 2 as A"))


def test_evenly_picked(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 3)
    want = [3 * int(x) for x in np.linspace(0, 99, 16, dtype=int)]
    assert sorted(r["x"] for r in regions.evenly_picked(df, "x").collect()) == want
    assert regions.evenly_picked(df.limit(5), "x").count() == 5


def test_projection_residual_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, a double, b double, c double, d double")
    found = detectors.principal_components(df, list("abcd"), 2)
    vt = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    for u, v in zip(found, vt, strict=True):
        assert abs(np.dot(u, v)) == pytest.approx(1, abs=1e-9)
    for center in (None, x.mean(0).tolist()):
        z = x - (center or 0)
        want = ((z - z @ vt.T @ vt) ** 2).mean(1)
        got = [r["residual"] for r in detectors.projection_residual(df, list("abcd"), found, center).orderBy("k").collect()]
        assert got == pytest.approx(want.tolist(), abs=1e-9)


def test_first_of_equal_candidates_wins(spark):
    df = spark.createDataFrame([(float(k), k >= 7) for k in range(10)], "x double, y boolean")
    table = selection.objectives(df, "x", [8.0, 6.5, 7.0, 3.0], "y")
    assert {r["threshold"]: r["objective"] for r in table.collect()}[7.0] == 1.0
    assert selection.selected(table).first()["threshold"] == 6.5  # alarms are the same as at 7, and it comes first
    assert selection.objectives(df.where("false"), "x", [1.0]).first()["objective"] == -0.02
