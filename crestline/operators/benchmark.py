"""The event benchmark: declared methods, each a score, a threshold rule and an event policy, fitted on training rows and judged as events on test rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators import detectors, extremal, regions, selection, tails, univariate
from crestline.operators.episodes import merged, spaced, within
from crestline.operators.evaluation import Costs, Policy, chance_match, evaluated_by, separations
from crestline.operators.forest import isolation_scores
from crestline.operators.series import column_quantiles, finite, place_among
from crestline.operators.statespace import least_distance_columns
from crestline.session import written


#: Positions of a range in which scores that look back are worked out; small, so that middling series keep all cores busy.
SPAN = 100_000


@dataclass(frozen=True)
class Spec:
    """A declared method."""

    name: str
    family: str
    score: str
    rule: str
    policy: str
    parameters: int


#: Name, family, score, threshold rule, event policy, number of parameters.
SPECS = tuple(
    Spec(*row)
    for row in (
        ("engineering_threshold", "baseline", "robust_max_abs_z", "fixed_physical_3z", "merge_gap", 1),
        ("best_individual_sensor_threshold", "baseline", "best_single_sensor_z", "train_quantile", "merge_gap", 2),
        ("global_empirical_threshold", "baseline", "robust_max_abs_z", "train_quantile", "merge_gap", 1),
        ("regime_conditioned_empirical_threshold", "baseline", "robust_max_abs_z", "regime_conditioned_quantile", "merge_gap", 3),
        ("classical_pot_gpd", "baseline", "robust_max_abs_z", "gpd_return_level", "merge_gap", 3),
        ("fixed_run_declustering", "baseline", "robust_max_abs_z", "train_quantile", "fixed_run_declustering", 2),
        ("ferro_segers_event_policy", "baseline", "robust_max_abs_z", "train_quantile", "ferro_segers_run_length", 2),
        ("k_gaps_event_policy", "baseline", "robust_max_abs_z", "train_quantile", "k_gaps_run_length", 2),
        ("spot", "baseline", "spot_streaming_excess", "spot_zero", "merge_gap", 3),
        ("isolation_forest", "baseline", "isolation_forest", "train_quantile", "merge_gap", 100),
        ("robust_online_changepoint", "baseline", "absolute_first_difference", "train_quantile", "merge_gap", 1),
        ("linear_autoencoder", "baseline", "linear_projection_residual", "train_quantile", "merge_gap", 8),
        ("compact_nonlinear_autoencoder", "baseline", "nonlinear_projection_residual", "train_quantile", "merge_gap", 8),
        ("conformal_anomaly", "baseline", "conformal_tail_probability", "conformal_level", "merge_gap", 1),
        ("empirical_horizon_risk", "baseline", "empirical_horizon_risk", "train_quantile", "merge_gap", 2),
        ("dynamical_evt_robust_score", "registered", "robust_max_abs_z", "train_quantile", "extremal_index_declustering", 3),
        ("failure_prototype_region", "target_region", "negative_prototype_distance", "train_quantile", "merge_gap", 4),
        ("rare_state_region", "target_region", "negative_rare_state_distance", "train_quantile", "merge_gap", 4),
        ("negative_control_region", "negative_control", "negative_control_distance", "train_quantile", "merge_gap", 4),
    )
)

#: The compact table's categories in order, and the methods of each.
CATEGORIES = {
    "Best simple baseline": ("engineering_threshold", "best_individual_sensor_threshold", "global_empirical_threshold", "regime_conditioned_empirical_threshold"),
    "Best classical EVT baseline": ("classical_pot_gpd", "fixed_run_declustering", "ferro_segers_event_policy", "k_gaps_event_policy", "spot"),
    "Best anomaly baseline": ("isolation_forest", "robust_online_changepoint", "conformal_anomaly", "empirical_horizon_risk"),
    "Best learned model": ("linear_autoencoder", "compact_nonlinear_autoencoder"),
    "Registered recurrence score": ("dynamical_evt_robust_score",),
    "Failure-prototype region": ("failure_prototype_region",),
    "Rare-state region": ("rare_state_region",),
}

#: A threshold that more than this share of training scores exceeds tells nothing apart.
MOST_TRAIN_RATE = 0.5
#: A method that warns for more than this share of the test rows is always on.
MOST_COVERAGE = 0.5


@dataclass(frozen=True)
class Setup:
    """What all methods of a benchmark share."""

    features: tuple[str, ...]
    label: str
    quantile: float = 0.98
    merge_gap: int = 60
    policy: Policy = field(default_factory=Policy)
    per_day: int = 86_400
    trees: int = 100


def check_specs(specs: tuple[Spec, ...]) -> tuple[Spec, ...]:
    """The methods, if no two share a name, or score, rule and policy."""
    if len({s.name for s in specs}) < len(specs) or len({(s.score, s.rule, s.policy) for s in specs}) < len(specs):
        raise ValueError("two methods are the same")
    return specs


def states(df: DataFrame, setup: Setup, position: str = "i") -> DataFrame:
    """(i, split, failing, _z0.., robust_max_abs_z): robustly scaled features by scales of the training rows; missing and infinite ones are 0."""
    scales = regions.scales_of(df.where("split = 'train'"), list(setup.features))
    at = lambda name, k: F.get(F.col(name), F.lit(k))
    z = [F.coalesce(finite((F.col(c).cast("double") - at("_center", k)) / at("_scale", k)), F.lit(0.0)).alias(f"_z{k}") for k, c in enumerate(setup.features)]
    rows = df.crossJoin(F.broadcast(scales)).select(F.col(position).cast("long").alias("i"), "split", F.coalesce(F.col(setup.label), F.lit(False)).alias("failing"), *z)
    return written(rows.withColumn("robust_max_abs_z", F.array_max(F.array(*[F.abs(F.col(f"_z{k}")) for k in range(len(z))]))), "states")


def references(train: DataFrame, z: list[str]) -> dict[str, list[list[float]]]:
    """At most 16 states of each region: failing ones and others evenly spaced in time, and those of the highest scores (ties: the earlier)."""
    most = regions.MOST_PROTOTYPES
    picked = {
        "negative_prototype_distance": regions.evenly_picked(train.where("failing"), "i", most),
        "negative_rare_state_distance": detectors.rarest(train, "robust_max_abs_z", most, ["i"]),
        "negative_control_distance": regions.evenly_picked(train.where("not failing"), "i", most),
    }
    return {kind: [list(r) for r in rows.select(*z).collect()] for kind, rows in picked.items()}


def sensor_of(train: DataFrame, z: list[str], quantile: float) -> int:
    """Place of the sensor that tells failing training rows from the others; without both kinds, that of the widest spread."""
    best = selection.best_sensor(selection.sensor_separation(train, z, "failing", quantile)).first()
    if best is not None and best["place"] is not None:
        return best["place"]
    spread = train.agg(*[F.stddev_pop(c).alias(c) for c in z]).first()
    return max(range(len(z)), key=lambda k: (spread[k] or 0.0, -k))


def horizon_risk(rows: DataFrame, score: str = "robust_max_abs_z", most: int = 3_600) -> DataFrame:
    """rows with empirical_horizon_risk: the share of training rows of the same fifth of the training scores that a failure follows within the horizon (a tenth of them, at most ``most``).

    If no training row fails, training rows and the others are ranked from 0 to 1 instead, each among themselves.
    """
    train = rows.where("split = 'train'")
    horizon = min(most, max(1, train.count() // 10))
    reach = train.where("failing").select(F.greatest(F.lit(0).cast("long"), F.col("i") - horizon).alias("start"), F.col("i").alias("end"))
    if reach.isEmpty():
        train_part, rest = (detectors.order_score(rows.where(part), score) for part in ("split = 'train'", "split != 'train'"))
        return train_part.unionByName(rest).withColumnRenamed("order_score", "empirical_horizon_risk")
    cuts = column_quantiles(train, {score: (F.col(score), [0.2, 0.4, 0.6, 0.8])})[score]
    place = place_among(cuts, F.col(score))
    ahead = within(train, merged(reach, 0, []), "_ahead").groupBy(place.alias("place")).agg(F.avg(F.col("_ahead").cast("double")).alias("risk"))
    risk = {r["place"]: r["risk"] for r in ahead.collect()}
    return rows.withColumn("empirical_horizon_risk", F.element_at(F.array(*[F.lit(risk.get(k, 0.0)) for k in range(len(cuts) + 1)]), place + 1))


def scored(df: DataFrame, setup: Setup, kinds: set[str] | None = None) -> DataFrame:
    """(i, split, failing, one column for each kind of score). All that is fitted comes from training rows; scores that look back start anew in each split.

    df: rows with a position ``i`` in a series, ``split`` (train, test, others), the features and the label.
    """
    kinds = {s.score for s in SPECS} if kinds is None else kinds
    rows = states(df, setup)
    z = [f"_z{k}" for k in range(len(setup.features))]
    train = rows.where("split = 'train'")
    if train.isEmpty():
        raise ValueError("no training rows")
    out, score = rows, "robust_max_abs_z"
    # scores that look at other rows come first, so that only states are shuffled for them
    if "empirical_horizon_risk" in kinds:
        out = horizon_risk(out)
    if "absolute_first_difference" in kinds:
        out = detectors.difference_score(out, score, ["split"], span=SPAN).withColumnRenamed("difference_score", "absolute_first_difference")
    if "spot_streaming_excess" in kinds:
        out = detectors.running_excess(out, score, ["split"], span=SPAN).withColumnRenamed("excess_score", "spot_streaming_excess")
    if "conformal_tail_probability" in kinds:
        tail = detectors.conformal_score(out.withColumn("_train", F.col("split") == "train"), score, "_train")
        out = tail.withColumn("conformal_tail_probability", 1 - F.col("tail")).drop("tail", "_train")
    # the others follow from a row and what is fitted
    if "best_single_sensor_z" in kinds:
        out = out.withColumn("best_single_sensor_z", F.abs(F.col(z[sensor_of(train, z, setup.quantile)])))
    if "linear_projection_residual" in kinds:
        out = detectors.projection_residual(out, z, detectors.principal_components(train, z, 3), name="linear_projection_residual")
    if "nonlinear_projection_residual" in kinds:
        bent = [f"_t{k}" for k in range(len(z))]
        curved = lambda part: part.withColumns({t: F.tanh(F.col(c)) for t, c in zip(bent, z, strict=True)})
        out = detectors.projection_residual(curved(out), bent, detectors.principal_components(curved(train), bent, 2), name="nonlinear_projection_residual").drop(*bent)
    if kinds & {"negative_prototype_distance", "negative_rare_state_distance", "negative_control_distance"}:
        known = {kind: refs for kind, refs in references(train, z).items() if refs and kind in kinds}
        out = out.withColumn("_far", least_distance_columns(known, z)).select("*", *[(-F.col(f"_far.{kind}")).alias(kind) for kind in known]).drop("_far") if known else out
    if "isolation_forest" in kinds:
        out = isolation_scores(out, z, setup.trees, train, name="isolation_forest", key="i")
    return written(out.select("i", "split", "failing", *sorted((kinds | {score}) & {*out.columns})), "scores")


def fitted(scores: DataFrame, setup: Setup, specs: tuple[Spec, ...]) -> dict[str, float | list[float]]:
    """Threshold of each method, from training scores; the regime method has [edge, edge, threshold, threshold, threshold].

    A quantile that over half the training scores exceed is taken from the scores above the least
    one instead; a method that still has no use of it is left out, as is one without a score.
    """
    train = scores.where("split = 'train'")
    there = [s for s in specs if s.score in scores.columns]
    kinds = sorted({s.score for s in there})
    cut = {k: q for k, (q,) in column_quantiles(train, {k: (F.col(k), [setup.quantile]) for k in kinds}).items()}
    chosen: dict[str, float | list[float]] = {}
    for s in there:
        if s.rule == "fixed_physical_3z":
            chosen[s.name] = 3.0
        elif s.rule == "conformal_level":
            chosen[s.name] = setup.quantile
        elif s.rule == "spot_zero":
            chosen[s.name] = 0.0
        elif s.rule == "gpd_return_level":
            one = tails.pareto_by(train.withColumn("_one", F.lit(1)), s.score, ["_one"], min(0.95, setup.quantile), max(setup.quantile, 0.99))
            chosen[s.name] = one.first()["level"]
        elif cut[s.score] is not None:
            chosen[s.name] = cut[s.score]
    guarded = [s for s in there if s.name in chosen and s.rule not in ("conformal_level", "spot_zero")]
    rate = lambda parts: train.agg(*[F.avg((F.col(s.score) > chosen[s.name]).cast("double")).alias(s.name) for s in parts]).first()
    first = rate(guarded) if guarded else {}
    for s in [s for s in guarded if first[s.name] > MOST_TRAIN_RATE]:
        least = train.agg(F.min(s.score)).first()[0]
        (above,) = column_quantiles(train.where(F.col(s.score) > least), {s.score: (F.col(s.score), [setup.quantile])})[s.score]
        if above is not None:
            chosen[s.name] = above
        if rate([s])[s.name] > MOST_TRAIN_RATE:
            del chosen[s.name]
    for s in there:
        if s.rule == "regime_conditioned_quantile" and s.name in chosen:
            x = F.col(s.score)
            edges = column_quantiles(train, {s.score: (x, [1 / 3, 2 / 3])})[s.score]
            own = column_quantiles(train, {str(k): (F.when(place_among(edges, x) == k, x), [setup.quantile]) for k in range(3)})
            chosen[s.name] = [*edges, *[chosen[s.name] if q is None else q for (q,) in own.values()]]
    return chosen


def exceeding(scores: DataFrame, chosen: dict[str, float | list[float]], specs: tuple[Spec, ...]) -> DataFrame:
    """(method, i) of the test rows over each method's threshold, all methods in one pass."""

    def over(s: Spec) -> Column:
        x, cut = F.col(s.score), chosen[s.name]
        if isinstance(cut, list):
            return x > F.element_at(F.array(*map(F.lit, cut[2:])), place_among(cut[:2], x) + 1)
        return x > cut

    flags = [F.when(over(s), F.lit(s.name)) for s in specs if s.name in chosen]
    return scores.where("split = 'test'").select("i", F.explode(F.filter(F.array(*flags), lambda m: m.isNotNull())).alias("method")).select("method", "i")


def run_lengths(hits: DataFrame, n: int, merge_gap: int, specs: tuple[Spec, ...]) -> dict[str, int]:
    """Run length of each declustering method: declared, or what an extremal index of its own exceedances implies (1 without an estimate)."""
    out = {s.name: merge_gap for s in specs if s.policy == "fixed_run_declustering"}
    by_index = {s.name: s.policy for s in specs if s.policy in ("ferro_segers_run_length", "k_gaps_run_length", "extremal_index_declustering")}
    if not by_index:
        return out
    of = lambda *policies: hits.where(F.col("method").isin([m for m, p in by_index.items() if p in policies]))
    sizes = hits.select("method").distinct().withColumn("n", F.lit(n))
    thetas = extremal.intervals_index(of("ferro_segers_run_length", "extremal_index_declustering"), ["method"]).select("method", "theta")
    thetas = thetas.unionByName(extremal.k_gaps_index(of("k_gaps_run_length"), sizes, ["method"]).select("method", "theta"))
    found = {r["method"]: r["run"] for r in thetas.select("method", univariate.derived_run_length(F.col("theta")).alias("run")).collect()}
    for method, policy in by_index.items():
        run = found.get(method, univariate.LEAST_RUN)
        out[method] = max(1, run // 2) if policy == "extremal_index_declustering" else run
    return out


def alarms_of(hits: DataFrame, runs: dict[str, int], merge_gap: int) -> DataFrame:
    """(method, start, end): exceedances merged over the gap, or the first one of each cluster for methods with a run length."""
    plain = hits.where(~F.col("method").isin([*runs])) if runs else hits
    out = merged(plain.select("method", F.col("i").alias("start"), F.col("i").alias("end")), merge_gap, ["method"])
    if not runs:
        return out
    run = F.create_map(*[F.lit(x) for pair in runs.items() for x in pair])[F.col("method")]
    first = spaced(hits.where(F.col("method").isin([*runs])), ["method"]).where(F.col("distance").isNull() | (F.col("distance") - 1 > run))
    return out.unionByName(merged(first.select("method", F.col("i").alias("start"), F.col("i").alias("end")), 0, ["method"]))


@dataclass(frozen=True)
class Run:
    """All parts of a benchmark: scores of the test rows, exceedances and alarms by method, failures, the thresholds and run lengths in use, the number of test rows."""

    scores: DataFrame
    hits: DataFrame
    alarms: DataFrame
    failures: DataFrame
    thresholds: dict[str, float | list[float]]
    runs: dict[str, int]
    n: int


def run(df: DataFrame, setup: Setup, specs: tuple[Spec, ...] = SPECS) -> Run:
    """Scores, thresholds, exceedances and alarms of the methods. Positions of the results count from the first test row."""
    check_specs(specs)
    scores = scored(df, setup, {s.score for s in specs})
    chosen = fitted(scores, setup, specs)
    used = tuple(s for s in specs if s.name in chosen)
    test = scores.where("split = 'test'")
    size = test.agg(F.min("i").alias("first"), F.count("*").alias("n")).first()
    first, n = size["first"] or 0, size["n"]
    hits = written(exceeding(scores, chosen, used).withColumn("i", F.col("i") - first), "hits")
    runs = run_lengths(hits, n, setup.merge_gap, used)
    alarms = written(alarms_of(hits, runs, setup.merge_gap).withColumn("alarm_id", F.col("start")), "alarms")
    bad = test.where("failing").select((F.col("i") - first).alias("start"), (F.col("i") - first).alias("end"))
    failures = written(merged(bad, 0, []).withColumn("failure_id", F.col("start")), "failures")
    return Run(test.withColumn("i", F.col("i") - first), hits, alarms, failures, chosen, runs, n)


def results(done: Run, setup: Setup, specs: tuple[Spec, ...] = SPECS, dataset: str = "events", costs: Costs = Costs()) -> DataFrame:
    """One row for each method that has a threshold: what it is, its event metrics, its coverage, and the settings that all share."""
    used = [s for s in specs if s.name in done.thresholds]
    rows = [(k, s.name, s.family, s.score, s.rule, s.policy, s.parameters, done.runs.get(s.name, 0), 0 if s.policy != "merge_gap" else setup.merge_gap) for k, s in enumerate(used)]
    spark = done.alarms.sparkSession
    table = spark.createDataFrame(rows, "place int, method string, method_family string, score_kind string, threshold_rule string, event_policy string, parameter_count int, run_length_used int, merge_gap_used int")
    judged = evaluated_by(done.alarms, done.failures, ["method"], table.select("method"), setup.policy, done.n, setup.per_day, costs)
    out = table.join(judged, "method")
    coverage = F.col("time_under_warning") / max(1, done.n)
    shared = f"{setup.quantile}:{setup.policy.horizon}:{setup.policy.before}:{setup.policy.after}:{setup.per_day}"
    return out.withColumns(
        {
            "dataset_id": F.lit(dataset),
            "detected": F.col("recall") > 0,
            "alarm_coverage_fraction": coverage,
            "degenerate_always_on": coverage > MOST_COVERAGE,
            "calibration_status": F.when(F.col("threshold_rule") == "conformal_level", "conformal (marginal, split)").when(F.col("score_kind") == "empirical_horizon_risk", "empirical frequency").otherwise("uncalibrated"),
            "tuning_partition": F.when(F.col("threshold_rule") == "fixed_physical_3z", "none (fixed a priori)").when(F.col("threshold_rule") == "conformal_level", "train (calibration split)").otherwise("train"),
            "configuration_hash": F.sha2(F.lit(shared), 256),
            "leakage_control": F.lit("train thresholds and references only"),
        }
    )


def compact(rows: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The best method of each category: largest F1, then least false alarms a day, then the first declared. One that is always on wins only where there is no other."""
    label = F.create_map(*[F.lit(x) for name, members in CATEGORIES.items() for m in members for x in (m, name)])[F.col("method")]
    return selection.best_of_category(rows, label, [*keys], degenerate="degenerate_always_on", tie="place")


def fairness(rows: DataFrame, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """(check, status, detail) of what must hold for the comparison to be fair.

    Settings that all methods of a data set must share; no method tuned on test rows; methods whose
    results are all the same (reported); event policies and gaps in use; methods that nobody declared.
    rows: by results(), one row a method and data set.
    """
    checks = []
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    row = lambda df, check, bad, fail, good, wrong: df.select(F.lit(check).alias("check"), F.when(bad, fail).otherwise("pass").alias("status"), F.when(bad, wrong).otherwise(F.lit(good)).alias("detail"))
    for c in ("configuration_hash", "target_events", "leakage_control"):
        if c not in rows.columns:
            checks.append(rows.limit(0).agg(F.lit(c).alias("check"), F.lit("not_checkable").alias("status"), F.lit(f"column {c} is absent").alias("detail")))
            continue
        of = rows.groupBy("dataset_id").agg(F.count_distinct(c).alias("k")).where("k > 1").agg(names("dataset_id").alias("x"))
        checks.append(row(of, c, F.col("x") != "", "fail", f"one {c} per dataset across all methods", F.concat(F.lit(f"{c} varies within "), "x")))
    of = rows.where(F.lower("tuning_partition").contains("test")).agg(names("tuning_partition").alias("x"))
    checks.append(row(of, "no_test_partition_tuning", F.col("x") != "", "fail", "no method declares test-partition tuning", F.concat(F.lit("test-partition tuning declared by: "), "x")))
    same = ["dataset_id", "predicted_alarm_events", F.round("recall", 10), F.round("precision", 10), F.round("false_alarms_per_day", 10), "duplicates"]
    twins = rows.groupBy(*same).agg(F.count("*").alias("k"), names("method").alias("m")).where("k > 1").agg(F.array_join(F.array_sort(F.collect_list(F.concat("dataset_id", F.lit(": "), "m"))), "; ").alias("x"))
    checks.append(row(twins, "method_result_distinctness", F.col("x") != "", "reported", "every declared method produced a distinct result set", F.concat(F.lit("methods with identical results (reported, not hidden): "), "x")))
    used = rows.agg(names("event_policy").alias("p"), F.array_join(F.transform(F.array_sort(F.collect_set("merge_gap_used")), lambda g: g.cast("string")), ", ").alias("g"))
    checks.append(used.select(F.lit("event_conversion_declared").alias("check"), F.lit("reported").alias("status"), F.concat(F.lit("event policies in use: "), "p", F.lit("; merge gaps in use: "), "g").alias("detail")))
    of = rows.where(~F.col("method").isin([s.name for s in specs])).agg(names("method").alias("x"))
    checks.append(row(of, "declared_specifications", F.col("x") != "", "fail", "every reported method has a declared specification", F.concat(F.lit("undeclared methods present: "), "x")))
    return reduce(DataFrame.unionByName, checks)


def decomposition(done: Run, rows: DataFrame, setup: Setup) -> DataFrame:
    """One row for each method of results(): where its evidence goes, stage by stage, beside the labelled failures.

    score_median, score_p95 and score_separation_auc (warning windows against the other test rows) are
    those of its score; exceedances are counted in samples, clusters under the method's own merge gap,
    then episodes. chance_match_probability is null without an alarm or a failure.
    """
    used = rows.select("method", "score_kind", "merge_gap_used", "tp", "false_alarms", "duplicates", "predicted_alarm_events", "target_events", "recall", "precision", "time_under_warning")
    kinds = sorted({s.score for s in SPECS} & {*done.scores.columns})
    reach = done.failures.select(F.greatest(F.lit(0).cast("long"), F.col("start") - setup.policy.horizon).alias("start"), F.col("start").alias("end"))
    inside = written(within(done.scores, merged(reach, 0, []), "_inside"), "windows")
    apart = separations(inside, kinds, "_inside").withColumnRenamed("auc", "score_separation_auc")
    found = column_quantiles(inside, {k: (F.col(k), [0.5, 0.95]) for k in kinds})
    spread = rows.sparkSession.createDataFrame([(k, *q) for k, q in found.items()], "score_kind string, score_median double, score_p95 double")
    met = spaced(done.hits, ["method"]).join(F.broadcast(rows.select("method", "merge_gap_used")), "method")
    opens = F.col("distance").isNull() | (F.col("distance") - 1 > F.col("merge_gap_used"))
    stages = met.groupBy("method").agg(F.count("*").alias("threshold_exceedances_samples"), F.count_if(opens).alias("extreme_clusters_count"))
    out = used.join(apart, "score_kind").join(spread, "score_kind").join(stages, "method", "left").na.fill(0, ["threshold_exceedances_samples", "extreme_clusters_count"])
    alarms, known = F.col("predicted_alarm_events"), F.col("target_events")
    bad = done.scores.agg(F.count_if("failing").alias("labelled_failure_samples"))
    return out.crossJoin(F.broadcast(bad)).select(
        "method", "score_median", "score_p95", "score_separation_auc",
        F.when((alarms > 0) & (known > 0), chance_match(alarms, known, setup.policy, F.lit(done.n))).alias("chance_match_probability"),
        F.lit(done.n).cast("long").alias("test_observations_samples"), "threshold_exceedances_samples", "extreme_clusters_count", alarms.alias("alarm_episodes_count"),
        F.col("tp").alias("matched_alarm_episodes_count"), F.col("false_alarms").alias("false_alarm_episodes_count"), F.col("duplicates").alias("duplicate_alarm_episodes_count"),
        known.alias("labelled_failure_events_count"), "labelled_failure_samples", F.col("recall").alias("event_recall"), F.col("precision").alias("event_precision"), F.col("time_under_warning").alias("time_under_warning_samples"),
        F.when(alarms > 0, F.col("threshold_exceedances_samples") / alarms).alias("exceedance_to_alarm_ratio"),
    )


#: A score that separates less than this carries no warning; a match below this precision is of no use.
LEAST_SEPARATION, LEAST_PRECISION = 0.55, 0.01


def root_cause(rows: DataFrame) -> DataFrame:
    """rows of decomposition() with layer, the first stage at which a method's evidence breaks down, and the confidence in that.

    Stages in their order: no labelled failure, a score that doesn't rank warning windows higher, no
    exceedance (the score's fault if its separation is unknown, else the threshold's), no cluster, no
    episode, no match, matches drowned in false alarms. What passes all is still evidence of few failures.
    """
    auc, none = F.col("score_separation_auc"), lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    known = auc.isNotNull() & ~F.isnan(auc)
    few = "insufficient independent evidence"
    cases = (
        (none("labelled_failure_events_count"), few, "high"),
        (known & (auc < 0.5), "score failure", "high"),
        (known & (auc < LEAST_SEPARATION), "score failure", "medium"),
        (none("threshold_exceedances_samples") & ~known, "score failure", "low"),
        (none("threshold_exceedances_samples"), "threshold failure", "medium"),
        (none("extreme_clusters_count"), "extreme-cluster failure", "high"),
        (none("alarm_episodes_count"), "alarm-merging failure", "high"),
        (none("matched_alarm_episodes_count"), "event-matching failure", "medium"),
        (F.coalesce(F.col("event_precision"), F.lit(0.0)) < LEAST_PRECISION, "no operationally acceptable result", "medium"),
        (F.lit(True), few, "low"),
    )
    verdict = F.coalesce(*[F.when(holds, F.struct(F.lit(layer).alias("layer"), F.lit(sure).alias("confidence"))) for holds, layer, sure in cases])
    return rows.withColumn("_v", verdict).select(*rows.columns, "_v.layer", "_v.confidence")
