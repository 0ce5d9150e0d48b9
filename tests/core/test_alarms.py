from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crestline.operators import blocks, evaluation, multivariate
from crestline.operators.evaluation import Policy


def alarms(spark, spans):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "alarm_id long, start long, end long")


def failures(spark, spans):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "failure_id long, start long, end long")


def test_warning_window(spark):
    policy, f = Policy(20, 0, 5), failures(spark, [(100, 120)])
    w = evaluation.windows(f, policy).first()
    assert (w["w_start"], w["w_end"]) == (80, 105)
    pairs = evaluation.eligible(alarms(spark, [(80, 82), (70, 75)]), f, policy).collect()
    assert [(p["alarm_id"], p["lead"]) for p in pairs] == [(0, 20)]


def test_evaluation(spark):
    a, f = alarms(spark, [(70, 75), (88, 90), (95, 105), (200, 205)]), failures(spark, [(100, 130)])
    got = evaluation.evaluated(a, f, Policy(20, 0, 10), 240, 24).first()
    assert (got["tp"], got["duplicates"], got["false_alarms"], got["missed"]) == (1, 1, 2, 0)
    assert got["false_alarms_per_day"] == pytest.approx(0.2) and got["median_lead"] == 12 and got["time_under_warning"] == 26


def test_optimal_matching(spark):
    pairs = evaluation.eligible(alarms(spark, [(95, 96), (125, 126)]), failures(spark, [(100, 110), (130, 140)]), Policy(40, 0, 0))
    assert sorted((r["alarm_id"], r["failure_id"]) for r in evaluation.matched(pairs).collect()) == [(0, 0), (1, 1)]


def test_matching_is_cheapest(spark):
    rng = random.Random(3)
    rows = [(f, a, rng.randrange(100)) for f in range(4) for a in range(5) if rng.random() < 0.8]
    pairs = spark.createDataFrame([(a, 0, 1000, f, 500, 0, c) for f, a, c in rows], "alarm_id long, a_start long, a_end long, failure_id long, f_start long, lead long, cost long")
    cost = {(f, a): c for f, a, c in rows}
    best = min((-sum((f, a) in cost for f, a in enumerate(p)), sum(cost.get((f, a), 0) for f, a in enumerate(p))) for p in itertools.permutations(range(5), 4))
    got = evaluation.matched(pairs).collect()
    assert (-len(got), sum(r["cost"] for r in got)) == best
    assert len({r["alarm_id"] for r in got}) == len({r["failure_id"] for r in got}) == len(got)


def test_lone_failures_are_matched_without_a_call_each(spark):
    rng, rows = random.Random(8), []
    for g in range(60):  # groups of one to three failures, apart from each other; costs tie
        for f in range(g % 3 + 1):
            picked = [a for a in range(5) if rng.random() < 0.6] or [0]
            rows += [(f"m{g % 2}", 10 * g + a, 1000 * g, 1000 * g + 900, 10 * g + f, 1000 * g + 500, a - f, rng.randrange(4)) for a in picked]
    pairs = spark.createDataFrame(rows, "method string, alarm_id long, a_start long, a_end long, failure_id long, f_start long, lead long, cost long")
    out = evaluation.matched(pairs, ["method"])
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    lead = {(m, a, f): (x, c) for m, a, _, _, f, _, x, c in rows}
    got = {(r["method"], r["alarm_id"], r["failure_id"]): (r["lead"], r["cost"]) for r in out.collect()}
    assert got.items() <= lead.items() and len({k[:2] for k in got}) == len({(k[0], k[2]) for k in got}) == len(got)
    for g in range(60):
        mine = {(a % 10, f % 10): c for (_, a, f), (_, c) in lead.items() if a // 10 == g}
        best = min((-sum((a, f) in mine for f, a in enumerate(p)), sum(mine.get((a, f), 0) for f, a in enumerate(p))) for p in itertools.permutations(range(5), g % 3 + 1))
        taken = {k: v for k, v in got.items() if k[1] // 10 == g}
        assert (-len(taken), sum(c for _, c in taken.values())) == best
        if g % 3 == 0:  # of equal costs a lone failure takes the first alarm
            assert [k[1] % 10 for k in taken] == [min(mine, key=lambda k: (mine[k], k[0]))[0]]


def test_calibration(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "p double, o int")
    assert evaluation.brier(df, "p", "o").first()["brier"] == pytest.approx(0.025)
    bins = evaluation.reliability(df, "p", "o", 2).orderBy("bin").collect()
    assert [(b["bin"], b["event_rate"]) for b in bins] == [(0, 0.0), (1, 1.0)]
    edges = spark.createDataFrame([(k / 10,) for k in range(11)], "p double").select(evaluation.bin_of(F.col("p"), 10).alias("b")).collect()
    assert [r["b"] for r in edges] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]


def test_separation_of_a_constant_is_a_half(spark):
    df = spark.createDataFrame([(1.0, k < 3) for k in range(10)], "score double, inside boolean")
    assert evaluation.separation(df, "score", "inside").first()["auc"] == 0.5
    perfect = spark.createDataFrame([(float(k >= 7), k >= 7) for k in range(10)], "score double, inside boolean")
    assert evaluation.separation(perfect, "score", "inside").first()["auc"] == 1.0


def test_patterns(spark):
    flags = spark.createDataFrame([(0, i, i == 2, i == 4) for i in range(8)], "s int, i long, a boolean, b boolean")
    assert [r["i"] for r in multivariate.detections(flags, ["a", "b"], [0, 2], ["s"]).collect()] == [2]
    flags = spark.createDataFrame([(0, i, i in {1, 2, 8}, i in {1, 3, 9}, i in {5, 10}) for i in range(12)], "s int, i long, a boolean, b boolean, c boolean")
    counts = {r["vector"]: r["n"] for r in multivariate.simultaneous(flags, ["a", "b", "c"]).collect()}
    assert counts["a+b"] == 1 and counts["none"] == 5
    joint = {(r["left"], r["right"]): r["joint"] for r in multivariate.tail_dependence(flags, ["a", "b", "c"]).collect()}
    assert joint == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}
    found = multivariate.detections(flags, ["a", "b"], [0, 1], ["s"])
    assert sorted(r["start"] for r in multivariate.pattern_clusters(found, 2, 0, ["s"]).collect()) == [2, 8]


def test_lag_surface_is_a_count_of_pairs(spark):
    rng = random.Random(5)
    hits = sorted({(rng.randrange(200), rng.choice("xyz")) for _ in range(150)})
    got = {(r["source"], r["target"], r["lag"]): r["n"] for r in multivariate.lag_surface(spark.createDataFrame(hits, "i long, component string"), 4).collect()}
    want: dict = {}
    for i, a in hits:
        for j, b in hits:
            if a != b and 0 <= j - i <= 4:
                want[a, b, j - i] = want.get((a, b, j - i), 0) + 1
    assert got == want


@pytest.mark.parametrize("size", [None, 1, 7, 64])
def test_whole_lag_surface_counts_all_pairs(spark, size):
    """However far apart, in cells of any width; pairs of two series, or of none, don't count."""
    rng = random.Random(6)
    hits = sorted({(rng.choice([3, 10**12, 10**12 + 1]), rng.randrange(200), rng.choice("xyz")) for _ in range(240)})
    rows = spark.createDataFrame([*hits, (None, 0, "x"), (None, 5, "y")], "s long, i long, component string").repartition(3)
    found = multivariate.whole_lag_surface(rows, ["x", "y", "z"], ["s"], size)
    got = {(r["source"], r["target"], r["lag"]): r["n"] for r in found.collect()}
    want = Counter((a, b, j - i) for s, i, a in hits for t, j, b in hits if s == t and a != b and j >= i)
    assert got == want and max(lag for *_, lag in got) > 150
    assert dict(found.dtypes) == {"source": "string", "target": "string", "lag": "bigint", "n": "bigint"}


def test_lag_surface_query_has_every_lag(spark):
    from crestline.plans.data_queries import COMPONENTS, component_flags, lag_surface

    flags = component_flags(spark, "/root/testdata/sf0.001")
    got = lag_surface(spark, "/root/testdata/sf0.001")
    pairs = sum(r[a] * r[b] for r in flags.groupBy("l_suppkey").agg(*[F.count_if(c).alias(c) for c in COMPONENTS]).collect() for a in COMPONENTS for b in COMPONENTS if a != b)
    # a pair of two places is there once, as its later one follows the earlier; one of the same place is there in both orders
    n = {r["same"]: r["n"] for r in got.groupBy((F.col("lag") == 0).alias("same")).agg(F.sum("n").alias("n")).collect()}
    assert 2 * n[False] + n[True] == pairs
    assert got.agg(F.max("lag")).first()[0] > 500


def test_cells_that_lie_as_far_apart_are_added():
    rng = np.random.default_rng(2)
    size, rows = 5, [(0, [0, 1], [0, 1])] + [(d, sorted(rng.choice(10, 4, False).tolist()), rng.choice(10, 4).tolist()) for d in (1, 1, 3)]
    batch = pa.RecordBatch.from_pydict({"apart": pa.array([r[0] for r in rows]), "source": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "target": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})
    got = [r for out in blocks.cell_lags(2, size)(iter([batch])) for r in out.to_pylist()]
    want = Counter((x // size, y // size, d * size + y % size - x % size) for d, a, b in rows for x in a for y in b if x // size != y // size and (d or y % size >= x % size))
    assert {(r["source"], r["target"], r["lag"]): r["n"] for r in got} == want


def test_benjamini_hochberg(spark):
    tests = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "k int, p double")
    got = {r["k"]: round(r["adjusted"], 6) for r in multivariate.benjamini_hochberg(tests, tie=["k"]).collect()}
    assert got == {1: 0.04, 2: 0.053333, 3: 0.053333, 4: 0.5}
