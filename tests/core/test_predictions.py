"""The standard prediction table against a plain version over arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import selection

COLUMNS = "dataset_id entity_id observation_index timestamp partition model model_id raw_score score transformed_risk_score threshold alarm_flag alarm_episode_id episode_id regime prediction_horizon horizon_risk training_config_hash calibration_config_hash provenance split runtime_seconds peak_memory_bytes parameter_count".split()


def rows_of(seed=3, n=200):
    rng = np.random.default_rng(seed)
    x, y, ok = rng.integers(0, 12, n).astype(float), rng.random(n) < 0.05, rng.random(n) < 0.9
    split = np.where(np.arange(n) < 120, "train", np.where(np.arange(n) < 160, "validation", "test"))
    return x, y, ok, split


def frame(spark, x, y, ok, split):
    return spark.createDataFrame([(i, float(v), bool(a), bool(b), str(s)) for i, (v, a, b, s) in enumerate(zip(x, y, ok, split, strict=True))], "i long, x double, target boolean, ok boolean, split string").repartition(3)


@pytest.mark.parametrize("labelled", [True, False])
def test_table(spark, labelled):
    x, y, ok, split = rows_of()
    out = selection.standard_predictions(frame(spark, x, y, ok, split), "m", "x", 9.0, 7, 2, 3, target="target" if labelled else None, allowed="ok")
    assert out.columns == COLUMNS
    got = sorted(out.collect(), key=lambda r: r["observation_index"])
    assert len(got) == len(x) and len({r["model_id"] for r in got}) == 1
    by, alarm = (split == "validation") & ok, (x >= 9) & ok
    ahead = np.array([y[i : i + 8].any() for i in range(len(y))])
    last, episode, ids = None, -1, []
    for i, a in enumerate(alarm):
        if a:
            episode += last is None or i - last - 1 > 2
            last = i
        ids.append(episode if a else -1)
    for i, r in enumerate(got):
        if labelled:
            over = by & (x >= x[i])
            risk = ahead[over].mean() if over.any() else ahead[by].mean()
        else:
            risk = (x[by] <= x[i]).mean()
        assert (r["alarm_flag"], r["alarm_episode_id"], r["partition"], r["parameter_count"]) == (alarm[i], ids[i], split[i], 3)
        assert r["horizon_risk"] == pytest.approx(risk) and r["transformed_risk_score"] == r["horizon_risk"]


def test_odd_rows(spark):
    x, y, ok, split = rows_of(n=60)  # all training rows: they stand in for validation
    df = frame(spark, x, y, ok, split).withColumn("x", F.when(F.col("i") == 5, None).when(F.col("i") == 6, float("inf")).otherwise(F.col("x")))
    got = {r["observation_index"]: r for r in selection.standard_predictions(df, "m", "x", F.lit(3.0), 5, split="split", entity="ok").collect()}
    assert len(got) == 60 and not got[5]["alarm_flag"] and got[5]["horizon_risk"] is None and got[6]["alarm_flag"] and got[0]["entity_id"] in ("true", "false")
    assert selection.standard_predictions(df.limit(0), "m", "x", 3.0, 5).count() == 0


def test_run_lengths(spark):
    hits = spark.createDataFrame([(i,) for i in (0, 4, 10, 11)], "i long")  # gaps 3, 5, 0
    assert selection.median_gap(hits) == 3 and selection.median_gap(hits, most=2) == 2 and selection.median_gap(hits.limit(0)) == 0
    assert selection.candidate_run_lengths(hits, [5, 0, 10]) == [0, 3, 5, 10]
    assert selection.selected_run_length([5, 0], True) == 5 and selection.selected_run_length([5, 0], False) == 0
    with pytest.raises(ValueError):
        selection.selected_run_length([], True)
