from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crestline.operators import episodes, extremal, recurrence, regimes, thresholds
from crestline.operators.series import Series, with_position


def rows(spark, positions, n=None):
    return spark.createDataFrame([(0, int(i)) for i in positions], "s int, i long")


def flags(spark, hits, n):
    return spark.createDataFrame([(0, i, i in hits) for i in range(n)], "s int, i long, hit boolean")


def test_clusters(spark):
    found = episodes.clusters(rows(spark, [1, 2, 5, 9]), 2, ["s"]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["size"]) for r in found] == [(1, 5, 3), (9, 9, 1)]
    assert episodes.clusters(rows(spark, []), 2, ["s"]).count() == 0


def test_merging(spark):
    spans = spark.createDataFrame([(0, 1, 2), (0, 4, 4), (0, 7, 7), (0, 1, 1)], "s int, start long, end long")
    assert sorted((r.start, r.end) for r in episodes.merged(spans, 1, ["s"]).collect()) == [(1, 4), (7, 7)]
    assert sorted((r.start, r.end) for r in episodes.merged(spans, 0, ["s"]).collect()) == [(1, 2), (4, 4), (7, 7)]
    nested = spark.createDataFrame([(0, 0, 10), (0, 2, 3), (0, 12, 12)], "s int, start long, end long")
    assert sorted((r.start, r.end) for r in episodes.merged(nested, 0, ["s"]).collect()) == [(0, 10), (12, 12)]


def test_extremal_indices(spark):
    assert extremal.runs_index(rows(spark, [0, 1, 4, 8]), ["s"], 1).first()["theta"] == 0.75
    assert extremal.intervals_index(rows(spark, [1, 2, 10, 11, 30]), ["s"]).first()["theta"] == pytest.approx(0.897989, abs=1e-6)
    sizes = spark.createDataFrame([(0, 25)], "s int, n long")
    assert extremal.k_gaps_index(rows(spark, [0, 1, 8, 9, 20]), sizes, ["s"], 1).first()["theta"] == pytest.approx(0.551225, abs=1e-6)
    # two of five blocks of 5 hold an exceedance: -ln(3/5) / (5 * 3/25)
    three = rows(spark, [0, 1, 12])
    assert extremal.blocks_index(three, sizes, ["s"], 5).first()["theta"] == pytest.approx(0.851376, abs=1e-6)
    assert extremal.reciprocal_index(three, sizes, ["s"], 5).first()["theta"] == pytest.approx(2 / 3)


def test_affine_invariance(spark):
    events = spark.createDataFrame([(0, i, float((i * 37) % 101)) for i in range(200)], "s int, i long, value double")
    a = extremal.stability(events, [0.9], [2]).first()
    b = extremal.stability(events.withColumn("value", F.col("value") * 3 + 5), [0.9], [2]).first()
    assert (a["hits"], a["clusters"]) == (b["hits"], b["clusters"])


def test_recurrence(spark):
    df = flags(spark, {2, 4}, 6)
    for start, wait in ((0, 2), (3, 1), (5, None)):
        assert recurrence.first_hit(df, "hit", ["s"], start).first()["wait"] == wait
    assert [r["return_time"] for r in recurrence.return_times(df.where("hit"), ["s"]).collect()] == [2]
    assert recurrence.hit_probability(df, "hit", ["s"], 2).first()["probability"] == 1.0
    got = {r["i"]: r["outcome"] for r in recurrence.horizon_outcome(df, "hit", ["s"], 1).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}
    got = {r["i"]: r["outcome"] for r in recurrence.horizon_outcome(df, "hit", ["s"], 1, inclusive=True).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True, 5: False}


def test_regime_thresholds(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(100)] + [("b", 1000.0 + k) for k in range(100)] + [("c", 5.0), ("c", None), ("c", float("nan")), (None, 1.0)], "regime string, value double")
    fitted = thresholds.fit_regimes(df, "value", "regime", 0.9)
    got = {r["regime"]: r for r in fitted.collect()}
    assert got["a"]["threshold"] == pytest.approx(89.1) and got["b"]["threshold"] == pytest.approx(1089.1)
    assert not got["c"]["own"] and got["c"]["threshold"] == got["<NA>"]["threshold"]
    assert thresholds.apply_regimes(df, fitted, "value", "regime").where("exceeds").count() == 20


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_do_not_depend_on_partitions(spark, partitions):
    df = spark.createDataFrame([(k, float((k * 7919) % 500), f"{k % 3}") for k in range(500)], "id long, at double, e string").repartition(partitions)
    whole = with_position(df, Series((), ("at", "id")))
    assert [r["i"] for r in whole.orderBy("at", "id").collect()] == list(range(500))
    each = with_position(df, Series(("e",), ("at", "id")))
    assert sorted(r["m"] for r in each.groupBy("e").agg(F.max("i").alias("m")).collect()) == [165, 166, 166]


def test_regimes(spark):
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate([1.0, 1.0, 1.0, 1.0, 9.0, 9.0])], "s int, i long, value double")
    assert [r["regime"] for r in regimes.by_changepoint(df, "value", ["s"], 3, 3.0).orderBy("i").collect()] == ["stable", "stable", "stable", "stable", "high_shift", "stable"]
    ruled = regimes.by_rules(df, "value", "value", ["s"], 2.0, 5.0)
    assert [r["regime"] for r in ruled.orderBy("i").collect()] == ["off"] * 4 + ["recovery", "loaded"]
    assert sorted((r["regime"], r["duration"]) for r in regimes.durations(ruled, ["s"]).collect()) == [("loaded", 1), ("off", 4), ("recovery", 1)]
    assert {r["regime"] for r in regimes.pooled(ruled, 0.2, "rest").collect()} == {"off", "rest"}


def test_circular_shift_keeps_every_interval(spark, tmp_path):
    from crestline.plans.episode_queries import circular_shift

    # a hit spans floor(value) % 4 samples more: [10], [60, 61], [92, 95] and [97, 100], of which 100 isn't there; user 2 has 5 samples
    at = {(1, 10): 900.0, (1, 60): 901.0, (1, 92): 903.0, (1, 97): 903.0, (2, 4): 900.0}
    events = [(u * 1000 + i, u, "a", at.get((u, i), 0.0)) for u, n in ((1, 100), (2, 5)) for i in range(n)]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["user_id"], r["start"], r["end"]) for r in circular_shift(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 2), (1, 4, 6), (1, 17, 17), (1, 67, 68), (1, 99, 99), (2, 1, 1)]


@pytest.mark.parametrize("span", [1, 3, 7, 1_000_000])
def test_ranges_give_what_one_range_gives(spark, span):
    """Clusters, merged intervals, differences and running maxima of two series, whatever ranges they are dealt into."""
    import random

    from crestline.operators import detectors

    rng = random.Random(span)
    rows = [(e, i, rng.choice([None, rng.random() * 10])) for e in ("a", None) for i in range(40) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "e string, i long, v double")
    got = {(r["e"], r["i"]): r["cluster_id"] for r in episodes.clustered(df, 1, ["e"], span=span).collect()}
    diff = {(r["e"], r["i"]): r["difference_score"] for r in detectors.difference_score(df, "v", ["e"], span=span).collect()}
    most = {(r["e"], r["i"]): r["excess_score"] for r in detectors.running_excess(df, "v", ["e"], span=span).collect()}
    spans = df.select("e", F.col("i").alias("start"), (F.col("i") + F.col("i") % 4).alias("end"))
    joined = sorted(((r["e"] or "", r["start"], r["end"]) for r in episodes.merged(spans, 1, ["e"], span=span).collect()))
    want = []
    for e in ("a", None):
        last, cluster, high, before, open_ = None, -1, None, None, None
        for _, i, v in sorted(r for r in rows if r[0] == e):
            cluster += last is None or i - last - 1 > 1
            assert got[(e, i)] == cluster
            assert diff[(e, i)] == pytest.approx(abs(v - before) if v is not None and before is not None else 0)
            assert most[(e, i)] == pytest.approx(v - high if v is not None and high is not None else 0)
            last, before = i, v
            high = v if high is None else high if v is None else max(high, v)
            if open_ is None or i - open_[1] - 1 > 1:
                open_ = [i, i + i % 4]
                want.append((e or "", open_))
            open_[1] = max(open_[1], i + i % 4)
    assert joined == sorted((e, a, b) for e, (a, b) in want)


def test_exact_quantiles(spark):
    """Ties, negative values, infinities, NaN, groups of one row and of none that is finite, against numpy; a coarse sketch too."""
    import numpy as np

    from crestline.operators.series import quantiles

    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=3_001), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([7.0]), "d": np.array([np.nan, np.inf]), None: np.array([-1.0, 2.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    levels = [0.0, 0.123, 0.5, 0.98, 1.0]
    for accuracy in (20, 10_000):
        got = {r["k"]: r for r in quantiles(df, F.col("x"), levels, ["k"], accuracy).collect()}
        for k, v in data.items():
            v = v[np.isfinite(v)]
            assert got[k]["n"] == len(v)
            assert got[k]["q"] is None or [None if x is None else pytest.approx(x, abs=1e-12) for x in got[k]["q"]] == (list(np.quantile(v, levels)) if len(v) else [None] * 5)
        every = np.concatenate([v[np.isfinite(v)] for v in data.values()])
        assert quantiles(df, F.col("x"), levels, [], accuracy).first()["q"] == pytest.approx(list(np.quantile(every, levels)), abs=1e-12)


def test_local_trace(spark):
    from crestline.operators import timeline

    rows, alarms = spark.range(30).withColumnRenamed("id", "i"), spark.createDataFrame([(3, 6), (12, 13), (25, 40)], "start long, end long")
    got = {r["i"]: (r["alarm_start"], r["in_window"]) for r in timeline.local_trace(rows, alarms, 15, 11, 12, 4).collect()}
    assert set(got) == set(range(4, 28)) and all(got[i][0] == (3 if i <= 6 else 12 if i in (12, 13) else 25 if i >= 25 else None) for i in got)
    assert [i for i in sorted(got) if got[i][1]] == [11, 12, 13, 14, 15]


def test_labels_do_not_depend_on_the_number_of_intervals(spark):
    from crestline.operators import preparation

    rows = spark.sql("select id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) as ts from range(60)")
    spans = spark.sql("select timestamp_ntz'2024-01-01 05:00' as start, timestamp_ntz'2024-01-02 03:00' as end, 'a' as kind, 0 as rank union all select timestamp_ntz'2024-01-01 20:00', timestamp_ntz'2024-01-01 22:00', 'b', 1")
    few, many = preparation.label_intervals(rows, spans, "ts"), preparation.label_intervals(rows, spans, "ts", most_broadcast=0)
    assert few.columns == many.columns and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
