"""Steps that must not hold a group, a series or a table in one place."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import draws
from crestline.operators import blocks, multivariate, resampling, statespace
from crestline.operators.series import quantiles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_density_and_scales_are_exact_without_percentile(spark, monkeypatch):
    """No exact percentile, which holds a column's different values in one place, and the same numbers."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=3_001), np.round(rng.gamma(2, 3, 3_001))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x double, y double").repartition(5)
    monkeypatch.setattr(F, "percentile", lambda *_: pytest.fail("percentile"))
    got = {r["k"]: (r["density_distance"], r["in_region"]) for r in statespace.density_region(df, ["x", "y"], 0.97).collect()}
    z = [(v - np.median(v)) / np.median(np.abs(v - np.median(v))) for v in (x, y)]
    d = np.round(np.hypot(*z), 9)
    assert all(got[k] == (pytest.approx(d[k], abs=2e-9), bool(d[k] >= np.quantile(d, 0.97))) for k in range(3_001))
    scales = {r["column"]: (r["center"], r["scale"]) for r in statespace.robust_scales(df, ["x", "y"]).collect()}
    for c, v in (("x", x), ("y", y)):
        q = np.quantile(v, [0.25, 0.5, 0.75])
        assert scales[c] == pytest.approx((q[1], q[2] - q[0]))


def test_quantiles_of_every_value(spark):
    """Infinities count as they are and NaN as the largest, like percentile()."""
    inf, nan = float("inf"), float("nan")
    for values in ([1.0, 2.0, inf, nan], [-inf, -inf, 3.0], [nan, nan], [1.0, inf, inf, inf, nan]):
        df = spark.createDataFrame([(1, v) for v in values] + [(1, None)], "g int, x double")
        levels = [0.25, 0.5, 0.75, 1.0]
        want = df.agg(F.percentile("x", F.array(*map(F.lit, levels))).alias("q")).first()["q"]
        got = quantiles(df, F.col("x"), levels, ["g"], every=True, few=True).first()
        assert got["n"] == len(values) and [repr(v) for v in got["q"]] == [repr(v) for v in want], values


def test_nearest_of_many_is_worked_out_in_blocks(spark, monkeypatch):
    """No state is joined to references one by one; odd vectors, ties and equal distances as with one array."""
    monkeypatch.setattr(statespace, "BLOCK", 50)
    monkeypatch.setattr(statespace, "STATES", 40)
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    grid = rng.integers(0, 3, (400, 4)).astype(float).tolist()  # many equal distances
    for odd_refs in ([], [[nan, 0.0, 0.0, 0.0], [inf, 0.0, 0.0, 1.0]], [[1e200, 0.0, 0.0, 0.0]], [[1.0, 2.0]], [[None, 1.0, 1.0, 1.0]]):
        refs = spark.createDataFrame([((7 * k) % 1009, v) for k, v in enumerate([*grid, *odd_refs])], "ref_id long, ref array<double>")
        asked = [*rng.integers(0, 3, (150, 4)).astype(float).tolist(), [nan, 0.0, 0.0, 0.0], [inf, 1.0, 0.0, 0.0], [1e200, 1.0, 0.0, 0.0], [1.0], [None, 0.0, 0.0, 0.0], [], None]
        states = spark.createDataFrame(list(enumerate(asked)), "vec_id long, embedding array<double>").repartition(3)
        got, want = ({r["vec_id"]: repr((r["ref_id"], r["distance"])) for r in statespace.nearest(states, refs, most=m).collect()} for m in (0, 10_000))
        assert got == want
    assert "FlatMapCoGroups" in plan(statespace.nearest(states, refs, most=0))


@pytest.mark.parametrize("circular", [True, False])
def test_bootstrap_shuffles_no_blocks(spark, monkeypatch, circular):
    """Replicates of packed series are drawn in place, in parts or at once, and equal those of series that are too long to be packed."""
    rng = np.random.default_rng(6)
    series = {("a", None): 300, ("b", 2): 41, (None, 3): 7, ("c", 1): 150}
    rows = [(*e, int(i)) for e, n in series.items() for i in np.flatnonzero(rng.random(n) < 0.3)]
    hits = spark.createDataFrame(rows, "s string, k int, i long")
    sizes = spark.createDataFrame([(*e, n) for e, n in series.items()] + [("d", 4, 9)], "s string, k int, n long")
    run = lambda: sorted(map(repr, resampling.bootstrap_index(hits, sizes, ["s", "k"], 1, 60, circular=circular).collect()))
    called = []
    draws = resampling.block_draws
    monkeypatch.setattr(resampling, "block_draws", lambda *a: called.append(a) or draws(*a))
    packed = run()
    assert not called and len(packed) == 5
    monkeypatch.setattr(resampling, "DRAWN", 100)
    assert run() == packed and not called
    monkeypatch.setattr(resampling, "PACKED", 40)
    assert run() == packed and called
    monkeypatch.setattr(resampling, "PACKED", 0)
    assert run() == packed


def test_time_shifts_are_counted_in_cells(spark, monkeypatch):
    """No exceedance of a replicate is a row, and the counts equal those of the rows, repeats and borders of cells included."""
    monkeypatch.setattr(multivariate, "CELL", 16)
    rng, n, first, last, lags = np.random.default_rng(2), 301, 50, 250, 3
    rows = [(c, int(i)) for c in "abc" for i in np.flatnonzero(rng.random(n) < 0.3)]
    for given in (rows, [*rows, ("a", 77), ("a", 77), ("b", 78)]):
        hits = spark.createDataFrame(given, "component string, i long")
        every = hits.selectExpr("0 as replicate", "component", "i").union(resampling.turned_hits(hits, n, 40, 7)).where(F.col("i").between(first, last))
        want = multivariate.lag_detections(every, ["replicate"], lags).groupBy("replicate", "source", "target", "lag").count()
        got = multivariate.shifted_counts(hits, n, 40, 7, first, last, lags)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(multivariate, "null_hits", lambda *_: pytest.fail("rows of replicates"))
    assert multivariate.evaluated(hits, ["a", "b", "c"], n, lags, replicates=20, inside=(first, last)).count() == 24


def test_numbers_of_texts_at_once():
    rng = np.random.default_rng(1)
    at = np.concatenate([[0, 9, 10, 99, 100, 10**18], rng.integers(0, 10**9, 500), rng.integers(0, 2_000, 200)])
    for begin in ("7:l_tax:turn:3:", "7:é:gap:199:", "", "x" * 44, "x" * 50, "x" * 60):
        assert draws.Texts(at).numbers(begin).tolist() == draws.numbers(f"{begin}{x}" for x in at.tolist()).tolist()


def test_permuted_runs_are_counted_in_cells(spark, monkeypatch):
    """No exceedance of a replicate is a row; the counts equal those of the rows, with chunks, ranges, very long runs and repeats."""
    monkeypatch.setattr(multivariate, "CELL", 16)
    monkeypatch.setattr(multivariate, "CHUNK", 32)
    monkeypatch.setattr(multivariate, "RANGE_RUNS", 7)
    monkeypatch.setattr(blocks, "LAID", 20)
    rng, n, first, last, lags = np.random.default_rng(2), 901, 500, 640, 3
    rows = [(c, int(i)) for c, p in (("a", 0.3), ("b", 0.1), ("c", 0.6)) for i in np.flatnonzero(rng.random(n) < p)]
    long = [("d", i) for i in range(100, 400)] + [("d", 2 * i) for i in range(250, 400)]
    tried = []
    count = multivariate.counted_cells
    monkeypatch.setattr(multivariate, "counted_cells", lambda *a: tried.append(a) or count(*a))
    for given, margin in ((rows, 6.0), (rows, 0.5), ([*rows, ("a", 77), ("a", 77), (None, 78), (None, 510)], 6.0), ([*rows, *long], 0.01)):
        monkeypatch.setattr(multivariate, "MARGIN", margin)
        hits = spark.createDataFrame(given, "component string, i long")
        every = hits.selectExpr("0 as replicate", "component", "i").union(resampling.shuffled_runs(hits, n, 10, 7)).where(F.col("i").between(first, last))
        want = multivariate.lag_detections(every, ["replicate"], lags).groupBy("replicate", "source", "target", "lag").count()
        got = multivariate.permuted_counts(hits, n, 10, 7, first, last, lags)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert len(tried) > 8  # two a call, and more where turns were left out
    monkeypatch.setattr(multivariate, "null_hits", lambda *_: pytest.fail("rows of replicates"))
    assert multivariate.evaluated(hits, ["a", "b", "c"], n, lags, "cluster_permutation", replicates=20, inside=(first, last)).count() == 24


def test_lagged_pairs_meet_in_cells_of_the_lag(spark):
    """Cells are no wider than the lag needs, and the pairs are those of any width."""
    hits = spark.createDataFrame([(c, int(i)) for k, c in enumerate("ab") for i in np.flatnonzero(np.random.default_rng(k).random(200) < 0.3)], "component string, i long")
    found = multivariate.lag_detections(hits, [], 3)
    assert "/ 4.0" in plan(found) and "/ 64.0" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, multivariate.lag_detections(hits, [], 3, window=64).collect()))


def test_component_thresholds_without_percentile(spark, monkeypatch):
    from crestline.plans.data_queries import COMPONENTS, component_flags

    monkeypatch.setattr(F, "percentile", lambda *_: pytest.fail("percentile"))
    assert component_flags(spark, "/root/testdata/sf0.001").columns == ["l_suppkey", "i", *COMPONENTS]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_column_quantiles(spark, accuracy):
    """Those of quantiles(), whatever is between the bounds, at them and beyond: ties, infinities, NaN, columns without a value."""
    from crestline.operators.series import column_quantiles

    rng, n, levels = np.random.default_rng(1), 3_000, [0.0, 0.2, 1 / 3, 0.5, 0.98, 1.0]
    zero, odd = np.where(rng.random(n) < 0.9, 0, rng.normal(size=n)), np.where(rng.random(n) < 0.3, -np.inf, rng.integers(0, 3, n))
    given = {"a": rng.normal(size=n), "b": np.round(rng.gamma(2, 3, n)), "c": zero, "d": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)), "e": np.full(n, np.inf), "f": odd}
    shape = ", ".join(f"{c} double" for c in given) + ", g double"
    for size in (1, n):
        df = spark.createDataFrame([(*[float(v[k]) for v in given.values()], None) for k in range(size)], shape).repartition(3)
        got = column_quantiles(df, {c: (F.col(c), levels) for c in df.columns}, accuracy)
        for c in df.columns:
            assert got[c] == list(quantiles(df, F.col(c), levels, [], accuracy).first()["q"]), (size, c)
    assert column_quantiles(df, {"low": (F.col("a"), [0.5]), "high": (F.when(F.col("a") > 0, F.col("a")), [0.1, 0.9])}, accuracy) == {"low": [np.median(given["a"])], "high": pytest.approx(np.quantile(given["a"][given["a"] > 0], [0.1, 0.9]))}


def test_benchmark_makes_no_row_of_each_value_for_quantiles(spark, monkeypatch):
    from crestline.operators import regions, selection

    for module in (regions, selection):
        monkeypatch.setattr(module, "quantiles", lambda *_, **__: pytest.fail("rows multiplied"))
    df = spark.createDataFrame([(float(k), float(k % 7), k % 10 == 0) for k in range(101)], "a double, b double, bad boolean")
    one = regions.scales_of(df, ["a", "b"]).first()
    assert (one["_center"], one["_scale"]) == ([50.0, 3.0], [50.0, 4.0])
    got = {r["sensor"]: (r["eligible"], r["separation"]) for r in selection.sensor_separation(df, ["a", "b"], "bad").collect()}
    x, bad = np.arange(101.0), np.arange(101) % 10 == 0
    want = {c: (np.median(v[bad]) - np.median(v[~bad])) / v[~bad].std() for c, v in (("a", x), ("b", x % 7))}
    assert got == {c: (True, pytest.approx(want[c], abs=1e-6)) for c in want}
    assert selection.sensor_separation(df.limit(0), ["a"], "bad").isEmpty()


def test_separations_of_several_scores(spark):
    """Those of each score, from one count of all values, with ranges that cut a score's values."""
    from crestline.operators import evaluation

    rng, nan = np.random.default_rng(3), float("nan")
    rows = [(float(rng.normal()), float(rng.integers(0, 4)), nan if k % 3 else 1.0 * k, None, bool(rng.random() < 0.3)) for k in range(400)]
    df = spark.createDataFrame(rows, "s0 double, s1 double, s2 double, s3 double, inside boolean").repartition(3)
    kinds = ["s0", "s1", "s2", "s3"]
    want = {c: evaluation.separation(df, c, "inside").first()["auc"] for c in kinds}
    for span in (1_000_000, 50):
        assert {r["score_kind"]: r["auc"] for r in evaluation.separations(df, kinds, "inside", span).collect()} == want
    assert want["s3"] is None and want["s0"] is not None


def test_distances_of_columns(spark):
    rng = np.random.default_rng(2)
    groups = {"near": rng.normal(size=(16, 3)).tolist(), "far": rng.normal(size=(1, 3)).tolist()}
    df = spark.createDataFrame([tuple(v) for v in (rng.normal(size=(50, 3)) * 1e3).tolist()] + [(0.0, -0.0, 1e200)], "x double, y double, z double")
    both = df.select(statespace.least_distance_columns(groups, ["x", "y", "z"]).alias("got"), statespace.least_distances(groups.values(), 3)(F.array("x", "y", "z")).alias("want"))
    assert all([r["got"]["near"], r["got"]["far"]] == r["want"] for r in both.collect())


def test_event_stream_is_placed_once(spark, monkeypatch):
    from crestline.plans import alarm_queries, benchmark_queries

    calls = []
    for module in (alarm_queries, benchmark_queries):
        monkeypatch.setattr(module, "with_position", lambda *a, of=module.with_position: calls.append(a) or of(*a))
    got = benchmark_queries.machine(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    known = alarm_queries.failures(spark, "/root/testdata/sf0.001").selectExpr("sum(end - start + 1)").first()[0]
    assert got.where("failing").count() == (known or 0)
