from __future__ import annotations

import numpy as np
import pytest

from crestline.operators import tails


def test_tails_are_fitted_on_all_excesses(spark):
    rng = np.random.default_rng(6)
    series = {"a": np.append(rng.exponential(1, 20_000), [60.0, 61.0]), "b": rng.uniform(0, 3, 9_000), "c": rng.pareto(2, 6_000)}
    df = spark.createDataFrame([(k, float(v)) for k, x in series.items() for v in x], "k string, v double").repartition(5)
    got = {r["k"]: r for r in tails.pareto_by(df, "v", ["k"], 0.9, 0.99).collect()}
    for k, x in series.items():
        base = np.quantile(x, 0.9)
        shape, scale = tails.fit_pareto(x[x > base] - base)
        assert got[k]["n_excesses"] == (x > base).sum()
        assert got[k]["shape"] == pytest.approx(shape, rel=1e-5, abs=1e-6) and got[k]["scale"] == pytest.approx(scale, rel=1e-5)


TAILS = {"exponential": lambda g, n: g.exponential(2, n), "uniform": lambda g, n: g.uniform(0, 3, n), "pareto": lambda g, n: g.pareto(1.5, n), "normal": lambda g, n: np.abs(g.normal(0, 5, n)), "repeated": lambda g, n: g.integers(1, 6, n).astype(float)}


@pytest.mark.parametrize("name", TAILS)
@pytest.mark.parametrize("n", [3, 9, 40, 400, 5_000])
def test_sums_of_fixed_size_fit_as_all_excesses_do(name, n):
    """Return levels at a tenth and a thousandth of the excesses differ by under 0.1 %, whether the unit fits or is 20 times too large or small."""
    x = TAILS[name](np.random.default_rng(n), n)
    shape, scale = tails.fit_pareto(x)
    for unit in (x.mean(), 20 * x.mean(), x.mean() / 20):
        sums = tails.TailSums(float(unit))
        for v in x:
            sums.add(float(v))
        assert len(sums.tops) <= tails.TOPS and len(sums.sums) == tails.GRID
        got = sums.fit()
        for tail in (0.1, 0.001):
            want = tails.return_level(0.0, shape, scale, 1.0, tail)
            assert tails.return_level(0.0, *got, 1.0, tail) == pytest.approx(want, rel=1e-3)


def test_adaptive_thresholds_against_full_refits(spark, monkeypatch):
    """Every row's threshold against a refit over all excesses so far; series of several batches, a null series name, NaN, infinite and missing values."""
    rng = np.random.default_rng(4)
    series = {"a": rng.exponential(1, 1_500), "b": rng.uniform(0, 1, 900), None: rng.pareto(3, 700), "few": np.array([1.0, 2.0]), "nan": np.array([np.nan] * 4)}
    series["a"][[1_000, 1_100]] = np.inf, np.nan
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", 9_999, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r["k"], r["i"]): (r["threshold"], r["exceeds"]) for r in tails.adaptive_thresholds(df, "v", ["k"], ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) - 1
    for k, x in series.items():
        train = x[: max(1, int(0.6 * len(x)))]
        sound = train[np.isfinite(train)]
        if not len(sound):
            assert all(got[k, i] == (None, False) for i in range(len(x)))
            continue
        base = np.quantile(sound, 0.9)
        over, cut, count = [v - base for v in sound if v > base], base, -1
        for i, v in enumerate(x):
            if len(over) >= 3 and len(over) != count:
                cut, count = tails.return_level(base, *tails.fit_pareto(np.array(over)), len(over) / (i + 1), 0.1), len(over)
            assert got[k, i][0] == pytest.approx(cut, rel=1e-3), (k, i)
            if abs(v - cut) > 1e-3 * abs(cut) or np.isnan(v):
                assert got[k, i][1] == (v > cut)
            if base < v <= cut:
                over.append(v - base)


def test_a_fit_takes_few_steps_and_a_short_tail_little_state():
    """The profile is worked out for many t at once; sums of a tail whose excesses are all kept are no state."""
    x, calls = np.random.default_rng(5).pareto(3.0, 300), []

    def mean_log(ts):
        calls.append(len(ts))
        return np.array([np.log1p(t * x).mean() for t in ts])

    shape, scale = tails._fit_profile(float(x.mean()), float(x.max()), mean_log)
    assert len(calls) < 20
    loss = lambda t: np.log(np.log1p(t * x).mean() / t) + np.log1p(t * x).mean() + 1
    best = min(loss(t) for t in np.linspace(0.5, 1.5, 2_001) * shape / scale)
    assert loss(shape / scale) <= best + 1e-12
    model = tails.Adaptive(0.0, 0.1, x[: tails.TOPS])
    assert model.state()[4] == []
    model.learn(9.0)
    assert len(model.state()[4]) == tails.GRID
