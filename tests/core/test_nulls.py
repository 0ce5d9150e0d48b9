"""Bootstraps, random places and null models against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import controls, multivariate, resampling, selection


def number(seed, *keys):
    return int(hashlib.md5(":".join(map(str, [seed, *keys])).encode()).hexdigest()[:13], 16)


def runs(flags, r):
    hits = np.flatnonzero(flags)
    return (1 + int((np.diff(hits) - 1 > r).sum())) / len(hits) if len(hits) else None


def made(seed=3, sizes=((1, 97), (2, 40), (3, 5), (4, 30))):
    rng = np.random.default_rng(seed)
    return {e: (rng.random(n) < 0.2) | (np.roll(rng.random(n) < 0.1, 1)) for e, n in sizes} | {5: np.zeros(12, bool), 6: np.ones(9, bool)}


@pytest.mark.parametrize("span", [7, 1_000_000])
@pytest.mark.parametrize("circular", [True, False])
def test_bootstrap_equals_brute_force(spark, circular, span):
    series, r, reps = made(), 1, 200
    hits = spark.createDataFrame([(e, int(i)) for e, f in series.items() for i in np.flatnonzero(f)], "e long, i long")
    sizes = spark.createDataFrame([(e, len(f)) for e, f in series.items()], "e long, n long")
    got = {x["e"]: x for x in resampling.bootstrap_index(hits, sizes, ["e"], r, reps, circular=circular, span=span).collect()}
    for e, f in series.items():
        n = len(f)
        b = max(2, round(n ** (1 / 3))) if circular else max(r + 1, int(n**0.5))
        thetas = []
        for k in range(1, reps + 1):
            starts = [number(7, e, k, j) % (n if circular else max(1, n - b + 1)) for j in range(-(-n // b))]
            drawn = np.concatenate([f[(s + np.arange(b)) % n] if circular else f[s : s + b] for s in starts])[:n]
            if drawn.any():
                thetas.append(runs(drawn, r))
        x = got[e]
        assert x["valid"] == len(thetas) and x["theta"] == (pytest.approx(runs(f, r)) if f.any() else None)
        assert [x["low"], x["high"]] == (pytest.approx(np.quantile(thetas, [0.025, 0.975])) if thetas else [None, None])


@pytest.mark.parametrize("span", [3, 1_000_000])
def test_intervals_keep_lengths_and_never_touch(spark, span):
    rows = [("a", 10 * k, 10 * k + k % 4) for k in range(40)] + [("b", 0, 99)] + [("c", 2 * k, 2 * k) for k in range(150)] + [("d", 0, 499)]
    out = resampling.spread(spark.createDataFrame(rows, "c string, start long, end long"), 500, 30, ["c"], span=span).collect()
    for c in "abcd":
        want = Counter(e - s + 1 for x, s, e in rows if x == c)
        places = set()
        for k in range(1, 31):
            found = sorted((x["start"], x["end"]) for x in out if x["c"] == c and x["replicate"] == k)
            assert Counter(e - s + 1 for s, e in found) == want and found[0][0] >= 0 and found[-1][1] < 500
            assert all(b[0] - a[1] > 1 for a, b in zip(found, found[1:], strict=False))
            places.add(tuple(found))
        assert c == "d" or len(places) > 20
    starts = np.array([x["start"] for x in out if x["c"] == "b"])
    assert 120 < starts.mean() < 280  # of 0 to 400
    with pytest.raises(ValueError):
        resampling.spread(spark.createDataFrame([("a", 0, 600)], "c string, start long, end long"), 500, 2, ["c"])


def test_places_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(5 * k, 5 * k + k % 3) for k in range(60)], "start long, end long")
    a, b = (sorted(map(tuple, resampling.spread(df, 1_000, 4, [], span=s).collect())) for s in (4, 10**6))
    assert a == b and len(a) == 240


def test_groups_are_drawn_as_many_times_as_there_are(spark):
    df = spark.range(900).select((F.col("id") % 70).alias("g"))
    got = resampling.group_resamples(df, "g", 40).collect()
    assert all(sum(x["times"] for x in got if x["replicate"] == k) == 70 for k in range(1, 41))
    assert {x["g"] for x in got} <= {*range(70)} and max(x["times"] for x in got) > 3 and len({x["g"] for x in got}) > 60


def hits_of(spark, n=300):
    rng = np.random.default_rng(5)
    a = np.flatnonzero(rng.random(n) < 0.12)
    rows = [("a", int(i)) for i in a] + [("b", int(i) + 2) for i in a if i + 2 < n and i % 3] + [("c", int(i)) for i in np.flatnonzero(rng.random(n) < 0.2)]
    return rows, spark.createDataFrame(rows, "component string, i long")


@pytest.mark.parametrize("model", ["time_shift", "cluster_permutation"])
def test_patterns_against_nulls_equal_brute_force(spark, model):
    n, lags, reps, inside = 300, 3, 99, (60, 279)
    rows, hits = hits_of(spark, n)
    null = {}
    for x in multivariate.null_hits(hits, n, model, reps).collect():
        null.setdefault(x["replicate"], set()).add((x["component"], x["i"]))
    if model == "time_shift":
        assert null[3] == {(c, (i + number(7, c, 3) % n) % n) for c, i in rows}
    assert all(Counter(c for c, _ in v) == Counter(c for c, _ in rows) for v in null.values()) and len(null) == reps

    def count(at, s, t, lag):
        return sum(c == s and (t, i + lag) in at and inside[0] <= i and i + lag <= inside[1] for c, i in at)

    keys = [(s, t, k) for s in "abc" for t in "abc" if s != t for k in range(lags + 1)]
    seen = {k: count({*rows}, *k) for k in keys}
    p = {k: (1 + sum(count(v, *k) >= seen[k] for v in null.values())) / (reps + 1) for k in keys}
    order = sorted(keys, key=p.get)
    adjusted = {k: min(1.0, min(p[x] * len(keys) / (j + 1) for j, x in enumerate(order) if p[x] >= p[k])) for k in keys}
    got = {(x["source"], x["target"], x["lag"]): x for x in multivariate.evaluated(hits, ["a", "b", "c"], n, lags, model, reps, inside).collect()}
    assert {*got} == {*keys}
    for k in keys:
        assert got[k]["n"] == seen[k] and got[k]["p"] == pytest.approx(p[k]) and got[k]["adjusted"] == pytest.approx(adjusted[k])
    assert got[("a", "b", 2)]["p"] <= 0.03


def test_nested_selection_finds_what_was_put_in(spark):
    _, hits = hits_of(spark, 300)
    out = multivariate.nested_selection(hits, ["a", "b", "c"], 300, 3, (60, 180), (181, 299), most=1, alpha=0.7, replicates=99).collect()
    assert {(x["source"], x["target"], x["lag"], x["split"]) for x in out} == {("a", "b", 2, "validation"), ("a", "b", 2, "heldout")}
    held = next(x for x in out if x["split"] == "heldout")
    assert held["adjusted"] == held["p"] <= 0.05 and held["n"] > 5
    with pytest.raises(ValueError):
        multivariate.null_hits(hits, 300, "other", 3)


def test_controls_anywhere_keep_durations(spark):
    seen = spark.createDataFrame([(10, 19), (40, 40), (80, 99)], "start long, end long")
    out = controls.drawn(seen, seen.limit(0), 200, 20).where("family = 'scattered'").collect()
    for k in range(20):
        assert sorted(x["end"] - x["start"] + 1 for x in out if x["draw"] == k) == [1, 10, 20]


def test_down_sampling_is_exact_and_merged_before_the_shuffle(spark):
    df = spark.range(3_000).repartition(9).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"))
    got = selection.down_sampled(df, 60, ["g"], ["id"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {r["g"]: min(60, r["count"]) for r in df.groupBy("g").count().collect()}
    hot = {r["id"] for r in got.where("g = 'hot'").collect()}
    assert hot == {*sorted((k for k in range(3_000) if k % 3), key=lambda k: number(7, k))[:60]}
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
