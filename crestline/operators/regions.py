"""Dangerous regions: where their reference states may come from, how states are scored against them, and what a region fitted elsewhere is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators.series import column_quantiles, finite, quantiles, running_sum
from crestline.operators.statespace import nearest, observable
from crestline.session import written

#: Prototypes of a region.
MOST_PROTOTYPES = 16


class ProvenanceError(ValueError):
    """Reference states that the region mustn't know."""


def check_states(states: DataFrame, vector: str) -> DataFrame:
    """states, if there are any and all their coordinates are finite."""
    bad = F.coalesce(F.exists(vector, lambda x: finite(x.cast("double")).isNull()), F.lit(True))
    seen = states.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if not seen["n"] or seen["bad"]:
        raise ValueError("no states" if not seen["n"] else f"{seen['bad']} states with missing or infinite coordinates")
    return states


def check_provenance(references: DataFrame, allowed: DataFrame, split: str = "split", failure: str = "failure_id") -> DataFrame:
    """references, if all are training states of an allowed failure; else ProvenanceError."""
    wrong = references.join(allowed.select(F.col(failure).alias("_ok")).distinct(), F.col(failure) == F.col("_ok"), "left").where((F.coalesce(F.col(split), F.lit("")) != "train") | F.col("_ok").isNull())
    if n := wrong.count():
        raise ProvenanceError(f"{n} reference states are held out")
    return references


def from_failures(states: DataFrame, allowed: DataFrame, split: str = "split", failure: str = "failure_id") -> DataFrame:
    """Training states of allowed failures."""
    out = states.where(F.col(split) == "train").join(allowed.select(failure).distinct(), failure, "left_semi").select(*states.columns)
    if out.isEmpty():
        raise ValueError("no training state of an allowed failure")
    return check_provenance(out, allowed, split, failure)


def from_constraint(states: DataFrame, constraint: str | Column) -> DataFrame:
    """States that break an engineering constraint."""
    out = states.where(constraint)
    if out.isEmpty():
        raise ValueError("the constraint selects no state")
    return out


def scored(states: DataFrame, references: DataFrame, key: str, vector: str, eps: float = 1e-12, near: float = 1e-6) -> DataFrame:
    """(key, distance_to_dangerous_region, dangerous_region_observable, exact_reference_duplicate, small_metric_scale)."""
    d = F.col("distance")
    return nearest(states, references, vector, key).select(key, d.alias("distance_to_dangerous_region"), observable(d, eps).alias("dangerous_region_observable"), (d <= eps).alias("exact_reference_duplicate"), (d <= near).alias("small_metric_scale"))


def scales_of(train: DataFrame, features: list[str]) -> DataFrame:
    """One row: center and scale (interquartile range, 1 where it is 0) of each feature as arrays."""
    found = [*column_quantiles(train, {c: (F.col(c), [0.25, 0.5, 0.75]) for c in features}).values()]
    scales = [1.0 if q[1] is None or q[2] == q[0] else q[2] - q[0] for q in found]
    return train.sparkSession.createDataFrame([([q[1] for q in found], scales)], "_center array<double>, _scale array<double>")


def standardised(df: DataFrame, features: list[str], scales: DataFrame, name: str = "state") -> DataFrame:
    """df with an array of (x - center) / scale; missing and infinite values give 0."""
    each = [F.coalesce(finite((F.col(c).cast("double") - F.col("_center")[k]) / F.col("_scale")[k]), F.lit(0.0)) for k, c in enumerate(features)]
    return df.crossJoin(F.broadcast(scales)).withColumn(name, F.array(*each)).drop("_center", "_scale")


def evenly_picked(rows: DataFrame, order: str, most: int = MOST_PROTOTYPES) -> DataFrame:
    """At most most rows, evenly spaced in the order of a column of different values, the first and last among them."""
    n = rows.count()
    if n <= most:
        return rows
    places = sorted({int(k * ((n - 1) / (most - 1))) for k in range(most)})
    return running_sum(rows, order, F.lit(1), "_place").where(F.col("_place").isin(places)).drop("_place")


def fit_region(train: DataFrame, features: list[str], label: str, key: str, quantile: float = 0.98) -> tuple[DataFrame, DataFrame] | None:
    """(params, prototypes) of a region around failing training rows; None if there is no failing row with finite features.

    params: one row of _center, _scale and _threshold, the distance that a share of 1 - quantile of
    the training rows is nearer than. prototypes: (ref_id, raw), in raw units.
    """
    scales = scales_of(train, features)
    whole = [finite(F.col(c).cast("double")).isNotNull() for c in features]
    failing = train.where(F.col(label))
    for w in whole:
        failing = failing.where(w)
    picked = written(evenly_picked(failing.select(F.col(key).alias("ref_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("raw")), "ref_id"), "prototypes")
    if picked.isEmpty():
        return None
    d = distances(train, features, scales, picked, key)
    cut = quantiles(d, F.col("distance"), [1 - quantile], []).select(F.col("q")[0].alias("_threshold"))
    return written(scales.crossJoin(cut), "region"), picked


def distances(df: DataFrame, features: list[str], scales: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(key, ref_id, distance) to the nearest prototype, both standardised by the scales."""
    scale = scales.select("_center", "_scale")
    refs = prototypes.crossJoin(F.broadcast(scale)).select("ref_id", F.zip_with(F.zip_with("raw", "_center", lambda x, c: x - c), "_scale", lambda x, s: x / s).alias("ref"))
    return nearest(standardised(df.select(key, *features), features, scale), refs, "state", key)


PROTOCOLS = ("direct", "rescaled", "recalibrated", "refit")


def transferred(source: DataFrame, train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, quantile: float = 0.98) -> DataFrame:
    """(protocol, alarms, hits, failing, n, precision, recall, occupancy, f1, degradation) of a region carried to another data set.

    direct: the source's prototypes, scales and threshold. rescaled: the scales are those of the
    destination's training rows. recalibrated: its threshold too. refit: all is fitted there.
    degradation is the refit's F1 less the protocol's.
    """
    far, own = fit_region(source, features, label, key, quantile), fit_region(train, features, label, key, quantile)
    if far is None or own is None:
        raise ValueError("a region needs failing rows in both training sets")
    (far_params, far_refs), (own_params, own_refs) = far, own
    here = own_params.select("_center", "_scale")
    moved = quantiles(distances(train, features, here, far_refs, key), F.col("distance"), [1 - quantile], []).select(F.col("q")[0].alias("_threshold"))
    moved = written(moved, "threshold")
    plans = {"direct": (far_params, far_refs), "rescaled": (here.crossJoin(far_params.select("_threshold")), far_refs), "recalibrated": (here.crossJoin(moved), far_refs), "refit": (own_params, own_refs)}
    out = None
    for protocol in PROTOCOLS:
        params, refs = plans[protocol]
        d = distances(test, features, params, refs, key).crossJoin(F.broadcast(params.select("_threshold")))
        alarm = F.coalesce(F.col("distance") <= F.col("_threshold"), F.lit(False))
        met = d.select(key, alarm.alias("_alarm")).join(test.select(key, F.coalesce(F.col(label), F.lit(False)).alias("_label")), key)
        one = met.agg(F.lit(protocol).alias("protocol"), F.count_if("_alarm").alias("alarms"), F.count_if(F.col("_alarm") & F.col("_label")).alias("hits"), F.count_if("_label").alias("failing"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("alarms") + F.col("failing") > 0, 2 * F.col("hits") / (F.col("alarms") + F.col("failing"))).otherwise(F.lit(0.0))
    rated = out.select("*", share("hits", "alarms").alias("precision"), share("hits", "failing").alias("recall"), share("alarms", "n").alias("occupancy"), f1.alias("f1"))
    best = rated.agg(F.max(F.when(F.col("protocol") == "refit", F.col("f1"))).alias("_refit"))
    return rated.crossJoin(F.broadcast(best)).withColumn("degradation", F.col("_refit") - F.col("f1")).drop("_refit")
