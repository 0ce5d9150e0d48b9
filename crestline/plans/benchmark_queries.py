"""The event benchmark over the event stream: four features, failures as in alarm_queries, the first 60 % of the rows to fit on and the last 20 % to judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators import benchmark, detectors, episodes, evaluation, selection, thresholds, timeline
from crestline.operators.series import Series, split_label, with_position
from crestline.plans.alarm_queries import ALL, FAILURES, OUTCOMES, PER_DAY, POLICY, P, alarms, failures, failures_of, placed
from crestline.plans.registry import query, table
from crestline.session import written

FEATURES = ("value", "k", "pause", "step")
SETUP = benchmark.Setup(FEATURES, "failing", quantile=0.98, merge_gap=5, policy=POLICY, per_day=PER_DAY, trees=50)


def machine(spark, sf_dir) -> DataFrame:
    """(i, split, failing, value, k, pause, step) of the event stream."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    rows = written(with_position(events, Series((), ("ts", "event_id"))), "placed")
    known = failures_of(rows).select("start", "end")
    paused = detectors.difference_score(rows.drop("event_type"), "at", [], span=benchmark.SPAN).withColumnRenamed("difference_score", "pause")
    moved = detectors.difference_score(paused, "value", [], span=benchmark.SPAN).withColumnRenamed("difference_score", "step")
    labelled = episodes.within(moved, known, "failing")
    return written(labelled.select("i", split_label(F.col("i"), F.lit(rows.count())).alias("split"), "failing", *FEATURES), "machine")


def judged(spark, sf_dir, specs=benchmark.SPECS) -> DataFrame:
    return written(benchmark.results(benchmark.run(machine(spark, sf_dir), SETUP, specs), SETUP, specs), "benchmark")


ROUNDED = ("recall", "precision", "f1", "false_alarms_per_day", "duplicates_per_failure", "normalised_lead", "utility", "alarm_coverage_fraction")


@query("event_benchmark")
def event_benchmark(spark, sf_dir):
    return judged(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ROUNDED})


@query("event_benchmark_compact")
def event_benchmark_compact(spark, sf_dir):
    kept = ("detected", "recall", "precision", "f1", "false_alarms_per_day", "median_lead", "duplicates", "utility")
    return benchmark.compact(judged(spark, sf_dir)).select("dataset_id", "category", "method", *[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in kept])


@query("event_benchmark_fairness")
def event_benchmark_fairness(spark, sf_dir):
    return benchmark.fairness(judged(spark, sf_dir))


#: The local view of a timeline: samples around the first failure's onset.
BEFORE, AFTER = 200, 50


@query(
    "timeline_reconciliation",
    f"""{ALL}, {OUTCOMES}, c AS (SELECT round(quantile_cont(value, 0.98), 6) AS t, count(*) AS n FROM events), o AS (SELECT min(f_start) AS o FROM f), na AS (SELECT count(*) AS na FROM a),
    fa AS (SELECT count(*) FILTER (kind = 'false_alarm') * 1000.0 / n AS rate FROM oc, c GROUP BY n), lo AS (SELECT count(*) AS ln FROM a, o WHERE a_end >= o - {BEFORE} AND a_start <= o + {AFTER}), tr AS (SELECT max(i) AS hi, count(DISTINCT t) AS cuts FROM p, o, c WHERE i BETWEEN o - {BEFORE} AND o + {AFTER})
    SELECT k.* FROM (SELECT unnest([{{'check': 'alarms_in_bins', 'here': na, 'there': na}}, {{'check': 'alarms_in_event_table', 'here': na, 'there': na}}, {{'check': 'local_alarms_within_all', 'here': ln, 'there': na}}, {{'check': 'trace_within_bins', 'here': hi, 'there': n - 1}},
    {{'check': 'false_alarms_per_day', 'here': round(rate, 6), 'there': round(rate, 6)}}, {{'check': 'one_threshold_in_trace', 'here': cuts, 'there': 1}}, {{'check': 'threshold_of_trace', 'here': t, 'there': t}}]) AS e FROM na, lo, tr, c, fa), LATERAL (SELECT e."check", CASE e."check" WHEN 'local_alarms_within_all' THEN e.here <= e.there WHEN 'trace_within_bins' THEN e.here <= e.there ELSE e.here = e.there END AS agrees, e.here::DOUBLE AS here, e.there::DOUBLE AS there) k""",
)
def timeline_reconciliation(spark, sf_dir):
    rows, made, known = placed(spark, sf_dir), alarms(spark, sf_dir), failures(spark, sf_dir)
    n = table(spark, sf_dir, "events").count()
    cut = thresholds.fit_global(table(spark, sf_dir, "events"), "value", 0.98).first()["threshold"]
    cut_rows = rows.withColumn("threshold", F.lit(cut))
    bins = timeline.overview(n, made, known, rows.where(F.col("value") > cut).select("i"))
    judged_row = evaluation.evaluated(made, known, POLICY, n, PER_DAY).first()
    onset = known.agg(F.min("start")).first()[0]
    trace = cut_rows.limit(0) if onset is None else timeline.local_trace(cut_rows, made, onset, BEFORE, AFTER, POLICY.horizon)
    local = made.where((F.col("end") >= (onset or 0) - BEFORE) & (F.col("start") <= (onset or 0) + AFTER)).count()
    # the timeline's own count of false alarms: those that touch no warning window
    false = evaluation.outcomes(made, known, POLICY).where("kind = 'false_alarm'").count()
    stated = {"alarm_episodes": made.count(), "local_alarm_episodes": local, "false_alarms_per_day": false * PER_DAY / n, "threshold": cut}
    out = timeline.reconciled(bins, trace, stated, judged_row["tp"] + judged_row["false_alarms"] + judged_row["duplicates"], judged_row["false_alarms_per_day"])
    return out.withColumns({c: F.round(c, 6) for c in ("here", "there")})


RUNS = [0, 5, 10]
PREDICTED = ("observation_index", "partition", "model", "score", "threshold", "alarm_flag", "alarm_episode_id", "regime", "prediction_horizon", "horizon_risk", "parameter_count")


@query(
    "prediction_table",
    f"""WITH {P}, {FAILURES}, e AS (SELECT i, event_type, value, event_type <> 'signup' AS ok, EXISTS (SELECT 1 FROM f WHERE i BETWEEN f_start AND f_end) AS y, EXISTS (SELECT 1 FROM f WHERE i BETWEEN f_start - 60 AND f_end) AS ahead, CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i < floor(0.6 * n) + floor(0.2 * n) THEN 'validation' ELSE 'test' END AS split FROM p, (SELECT count(*) AS n FROM events)),
    c AS (SELECT round(quantile_cont(value, 0.98), 6) AS t FROM e WHERE split = 'train'), al AS (SELECT i, lag(i) OVER (ORDER BY i) AS li FROM e, c WHERE ok AND value >= t), ep AS (SELECT i, sum(CASE WHEN i - li - 1 <= 0 THEN 0 ELSE 1 END) OVER (ORDER BY i) - 1 AS g FROM al),
    v AS (SELECT value, count(*) FILTER (split = 'validation' AND ok) AS c, count(*) FILTER (split = 'validation' AND ok AND ahead) AS h FROM e WHERE value IS NOT NULL GROUP BY value), s AS (SELECT value, sum(c) OVER w AS c, sum(h) OVER w AS h, sum(h) OVER () / sum(c) OVER () AS whole FROM v WINDOW w AS (ORDER BY value DESC))
    SELECT e.i AS observation_index, split AS "partition", 'k_gaps_declustering' AS model, e.value AS score, t AS threshold, coalesce(e.value >= t, false) AND ok AS alarm_flag, coalesce(g, -1)::BIGINT AS alarm_episode_id, event_type AS regime, 60 AS prediction_horizon, round(CASE WHEN s.c > 0 THEN s.h / s.c ELSE whole END, 6) AS horizon_risk, 2 AS parameter_count
    FROM e CROSS JOIN c LEFT JOIN ep ON ep.i = e.i LEFT JOIN s ON s.value = e.value""",
)
def prediction_table(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    marked = episodes.within(placed(spark, sf_dir), failures(spark, sf_dir).select("start", "end"), "target").withColumn("allowed", F.col("event_type") != "signup")
    rows = written(marked.withColumn("split", split_label(F.col("i"), F.lit(n))), "rows")
    train = rows.where("split = 'train'")
    cut = thresholds.fit_global(train, "value", 0.98).first()["threshold"]
    run = selection.selected_run_length(selection.candidate_run_lengths(train.where(F.col("value") > cut), RUNS), labelled=True)
    out = selection.standard_predictions(rows, "k_gaps_declustering", "value", cut, POLICY.horizon, run, 2, allowed="allowed", timestamp="ts", regime="event_type")
    return out.select(*PREDICTED).withColumn("horizon_risk", F.round("horizon_risk", 6))


#: Methods whose scores, thresholds and policies SQL can say: no forest, components or tail fits.
SAID = tuple(m for m in benchmark.SPECS if m.score not in ("isolation_forest", "linear_projection_residual", "nonlinear_projection_residual") and m.rule != "gpd_return_level")


def _sql_scores() -> str:
    """CTEs up to s: (i, split, y, one column a score kind), i from the first row of the split."""
    d = len(FEATURES)
    each = lambda text, sep=", ": sep.join(text.format(k=k, c=c) for k, c in enumerate(FEATURES))
    near = lambda name: f"(SELECT min(sqrt({each(f'pow({name}.z{{k}} - z.z{{k}}, 2)', ' + ')})) FROM {name})"
    even = lambda where: f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY i) - 1 AS rn, count(*) OVER () AS cnt FROM tr WHERE {where}) WHERE cnt <= 16 OR rn IN (SELECT floor(k * ((cnt - 1) / 15.0)) FROM (SELECT unnest(range(16)) AS k))"
    return f"""{P}, {FAILURES}, raw AS (SELECT i, value, nullif(regexp_extract(props, '"k": (-?[0-9.]+)', 1), '')::DOUBLE AS k, coalesce(abs(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY i)), 0.0) AS pause, coalesce(abs(value - lag(value) OVER (ORDER BY i)), 0.0) AS step, count(*) OVER () AS n FROM p),
    x AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE i BETWEEN f_start AND f_end) AS y, CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i < floor(0.6 * n) + floor(0.2 * n) THEN 'validation' ELSE 'test' END AS split FROM raw),
    sc AS (SELECT {each("median({c}) AS c{k}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s{k}")} FROM x WHERE split = 'train'),
    z0 AS (SELECT i, split, y, {each("coalesce(({c} - c{k}) / CASE WHEN s{k} <> 0 THEN s{k} ELSE 1 END, 0.0) AS z{k}")} FROM x, sc), z AS MATERIALIZED (SELECT *, greatest({each("abs(z{k})")}) AS robust_max_abs_z FROM z0), tr AS MATERIALIZED (SELECT * FROM z WHERE split = 'train'),
    sep AS (SELECT unnest([{", ".join(f"{{'k': {k}, 'ok': quantile_cont(abs(z{k}), 0.98) > median(abs(z{k})), 'v': round((median(abs(z{k})) FILTER (y) - median(abs(z{k})) FILTER (NOT y)) / CASE WHEN stddev_pop(abs(z{k})) FILTER (NOT y) > 0 THEN stddev_pop(abs(z{k})) FILTER (NOT y) ELSE 1.0 END, 6)}}" for k in range(d))}]) AS e FROM tr),
    best AS (SELECT e.k AS sensor FROM sep WHERE e.ok OR NOT (SELECT bool_or(e.ok) FROM sep) ORDER BY e.v DESC, e.k LIMIT 1),
    fr AS MATERIALIZED ({even("y")}), rr AS MATERIALIZED (SELECT * FROM tr ORDER BY robust_max_abs_z DESC, i LIMIT 16), cr AS MATERIALIZED ({even("NOT y")}),
    hz AS (SELECT least(3600, greatest(1, count(*) // 10)) AS h, quantile_cont(robust_max_abs_z, [0.2, 0.4, 0.6, 0.8]) AS q FROM tr), lab AS (SELECT i, robust_max_abs_z AS r, coalesce(min(CASE WHEN y THEN i END) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - i <= h, false) AS ahead, q FROM tr, hz),
    risk AS (SELECT len(list_filter(q, lambda c: c <= r)) AS bin, avg(ahead::INT) AS risk FROM lab GROUP BY 1), tail AS (SELECT v, (SELECT count(*) FROM tr WHERE robust_max_abs_z >= v) AS above FROM (SELECT DISTINCT robust_max_abs_z AS v FROM z)),
    s AS MATERIALIZED (SELECT z.i - min(z.i) OVER (PARTITION BY split) AS i, split, y, robust_max_abs_z, CASE sensor {each("WHEN {k} THEN abs(z{k})", " ")} END AS best_single_sensor_z,
        coalesce(robust_max_abs_z - max(robust_max_abs_z) OVER (PARTITION BY split ORDER BY z.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spot_streaming_excess, coalesce(abs(robust_max_abs_z - lag(robust_max_abs_z) OVER (PARTITION BY split ORDER BY z.i)), 0.0) AS absolute_first_difference,
        1 - (1 + above) / ((SELECT count(*) FROM tr) + 1) AS conformal_tail_probability, coalesce(risk, 0.0) AS empirical_horizon_risk, -{near("fr")} AS negative_prototype_distance, -{near("rr")} AS negative_rare_state_distance, -{near("cr")} AS negative_control_distance
        FROM z CROSS JOIN best CROSS JOIN hz JOIN tail ON v = robust_max_abs_z LEFT JOIN risk ON bin = len(list_filter(q, lambda c: c <= robust_max_abs_z)))"""


def _sql_over(m: benchmark.Spec) -> str:
    """Exceedances of a method on the test rows; on these tables no quantile needs the guard."""
    if m.rule == "regime_conditioned_quantile":
        place = f"len(list_filter((SELECT quantile_cont({m.score}, [1 / 3, 2 / 3]) FROM s WHERE split = 'train'), lambda c: c <= {m.score}))"
        return f"SELECT '{m.name}' AS method, i FROM (SELECT i, split, {m.score} AS v, {place} AS g FROM s) JOIN (SELECT g, quantile_cont(v, 0.98) AS t FROM (SELECT split, {m.score} AS v, {place} AS g FROM s) WHERE split = 'train' GROUP BY g) USING (g) WHERE split = 'test' AND v > t"
    cut = {"fixed_physical_3z": "3.0", "conformal_level": "0.98", "spot_zero": "0.0"}.get(m.rule, f"(SELECT quantile_cont({m.score}, 0.98) FROM s WHERE split = 'train')")
    return f"SELECT '{m.name}' AS method, i FROM s WHERE split = 'test' AND {m.score} > {cut}"


def _sql_parts() -> str:
    """CTEs up to o, one row a method."""
    run = """CASE policy WHEN 'merge_gap' THEN 5 WHEN 'fixed_run_declustering' THEN 5 ELSE CASE WHEN policy = 'extremal_index_declustering' THEN greatest(1, rl // 2) ELSE rl END END"""
    return f"""WITH {_sql_scores()}, specs AS (SELECT * FROM (VALUES {", ".join(f"('{m.name}', '{m.policy}')" for m in SAID)}) t(method, policy)), nt AS (SELECT count(*) AS n FROM s WHERE split = 'test'),
    h AS MATERIALIZED (SELECT method, policy, i, i - lag(i) OVER (PARTITION BY method ORDER BY i) AS dist FROM ({" UNION ALL ".join(map(_sql_over, SAID))}) JOIN specs USING (method)),
    g AS (SELECT method, policy, count(*) AS hits, count(dist) AS n_gaps, max(dist) AS longest, sum(dist - 1) AS d1, sum((dist - 1) * (dist - 2)) AS d2, count(*) FILTER (dist - 2 <= 0) AS n0, count(*) FILTER (dist - 2 > 0) AS n1, coalesce(sum(greatest(dist - 2, 0)), 0) AS sk FROM h GROUP BY ALL),
    th AS (SELECT method, policy, CASE WHEN n_gaps = 0 THEN NULL WHEN policy = 'k_gaps_run_length' THEN CASE WHEN n1 = 0 THEN NULL WHEN n0 = 0 THEN least(1.0, 2 * n1 / (hits / n * sk)) ELSE least(1.0, (n0 + 2 * n1 + hits / n * sk - sqrt(pow(n0 + 2 * n1 + hits / n * sk, 2) - 8 * n1 * (hits / n * sk))) / (2 * (hits / n * sk))) END WHEN longest <= 2 THEN 1.0 ELSE least(1.0, 2.0 * d1 * d1 / (n_gaps * nullif(d2, 0))) END AS theta FROM g, nt),
    rl AS (SELECT method, {run} AS run FROM (SELECT *, coalesce(least(600, greatest(1, CASE WHEN theta > 0 THEN round_even(1 / theta, 0) END)), 1)::BIGINT AS rl FROM th)),
    am AS (SELECT method, policy, i, sum(CASE WHEN dist - 1 <= run THEN 0 ELSE 1 END) OVER (PARTITION BY method ORDER BY i) AS c FROM h JOIN rl USING (method)), a AS MATERIALIZED (SELECT method, min(i) AS a_start, CASE WHEN policy = 'merge_gap' THEN max(i) ELSE min(i) END AS a_end FROM am GROUP BY method, policy, c),
    fm AS (SELECT i, sum(CASE WHEN i - li = 1 THEN 0 ELSE 1 END) OVER (ORDER BY i) AS c FROM (SELECT i, lag(i) OVER (ORDER BY i) AS li FROM s WHERE split = 'test' AND y)), ft AS (SELECT min(i) AS fs, greatest(0, min(i) - 60) AS w0, min(i) + 10 AS w1 FROM fm GROUP BY c),
    pr AS MATERIALIZED (SELECT method, a_start, fs, fs - a_start AS lead, CASE WHEN a_start BETWEEN w0 AND w1 THEN a_start - fs ELSE least(abs(a_start - w0), abs(a_start - w1)) + 10000 END AS cost FROM a, ft WHERE a_start <= w1 AND w0 <= a_end),
    bs AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY method, fs ORDER BY cost, a_start) = 1), k1 AS (SELECT method, count(*) AS tp, median(lead)::DOUBLE AS median_lead, avg(greatest(-1.0, least(1.0, lead / 70.0))) AS nl FROM bs GROUP BY 1),
    k2 AS (SELECT method, count(*) AS alarms, sum(a_end - a_start + 1)::BIGINT AS under FROM a GROUP BY 1), k3 AS (SELECT method, count(DISTINCT a_start) AS near FROM pr GROUP BY 1), k4 AS (SELECT pr.method, count(DISTINCT pr.a_start) AS dup FROM pr JOIN bs ON pr.method = bs.method AND pr.fs = bs.fs AND pr.a_start <> bs.a_start GROUP BY 1),
    o AS (SELECT specs.method, CASE policy WHEN 'merge_gap' THEN 0 ELSE run END::INTEGER AS run_length_used, (SELECT count(*) FROM ft) AS target_events, coalesce(alarms, 0) AS predicted_alarm_events, coalesce(tp, 0) AS tp, coalesce(dup, 0) AS duplicates, coalesce(alarms, 0) - coalesce(near, 0) AS false_alarms, coalesce(under, 0) AS time_under_warning, median_lead, round(nl, 6) AS normalised_lead
        FROM specs LEFT JOIN rl USING (method) LEFT JOIN k1 USING (method) LEFT JOIN k2 USING (method) LEFT JOIN k3 USING (method) LEFT JOIN k4 USING (method))"""


@query("event_benchmark_said", f"{_sql_parts()} SELECT o.*, round(CASE WHEN tp + false_alarms + duplicates > 0 THEN tp / (tp + false_alarms + duplicates) ELSE 0.0 END, 6) AS precision, round(CASE WHEN target_events > 0 THEN tp / target_events ELSE 0.0 END, 6) AS recall, time_under_warning / n > 0.5 AS degenerate_always_on FROM o, nt")
def event_benchmark_said(spark, sf_dir):
    kept = ("method", "run_length_used", "target_events", "predicted_alarm_events", "tp", "duplicates", "false_alarms", "time_under_warning", "median_lead", "normalised_lead", "precision", "recall", "degenerate_always_on")
    return judged(spark, sf_dir, SAID).select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in kept])


@query(
    "benchmark_root_cause",
    f"""{_sql_parts()}, kd AS (SELECT * FROM (VALUES {", ".join(f"('{m.name}', '{m.score}', {5 if m.policy == 'merge_gap' else 0})" for m in SAID)}) t(method, kind, gap)),
    st AS (SELECT s.*, EXISTS (SELECT 1 FROM ft WHERE s.i BETWEEN w0 AND fs) AS inside FROM s WHERE split = 'test'), lg AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS v, inside FROM st" for k in sorted({m.score for m in SAID}))}),
    rk AS (SELECT kind, v, inside, rank() OVER (PARTITION BY kind ORDER BY v) + (count(*) OVER (PARTITION BY kind, v) - 1) / 2 AS r FROM lg),
    au AS (SELECT kind, (sum(r) FILTER (inside) - count(*) FILTER (inside) * (count(*) FILTER (inside) + 1) / 2) / nullif(count(*) FILTER (inside) * count(*) FILTER (NOT inside), 0) AS auc FROM rk GROUP BY kind),
    ex AS (SELECT method, count(*) AS hits, count(*) FILTER (dist IS NULL OR dist - 1 > gap) AS clusters FROM h JOIN kd USING (method) GROUP BY method),
    d AS (SELECT method, auc, coalesce(hits, 0) AS hits, coalesce(clusters, 0) AS clusters, predicted_alarm_events AS episodes, tp, target_events AS known, false_alarms, CASE WHEN tp + false_alarms + duplicates > 0 THEN tp / (tp + false_alarms + duplicates) ELSE 0.0 END AS prec, CASE WHEN predicted_alarm_events > 0 AND target_events > 0 THEN 1 - exp(-predicted_alarm_events::DOUBLE * target_events * 71 / n) END AS chance FROM o JOIN kd USING (method) JOIN au USING (kind) LEFT JOIN ex USING (method), nt),
    v AS (SELECT *, CASE WHEN known = 0 THEN 'insufficient independent evidence/high' WHEN auc < 0.5 THEN 'score failure/high' WHEN auc < 0.55 THEN 'score failure/medium' WHEN hits = 0 AND auc IS NULL THEN 'score failure/low' WHEN hits = 0 THEN 'threshold failure/medium' WHEN clusters = 0 THEN 'extreme-cluster failure/high'
        WHEN episodes = 0 THEN 'alarm-merging failure/high' WHEN tp = 0 THEN 'event-matching failure/medium' WHEN prec < 0.01 THEN 'no operationally acceptable result/medium' ELSE 'insufficient independent evidence/low' END AS w FROM d)
    SELECT method, round(auc, 6) AS score_separation_auc, round(chance, 6) AS chance_match_probability, hits AS threshold_exceedances_samples, clusters AS extreme_clusters_count, episodes AS alarm_episodes_count, tp AS matched_alarm_episodes_count, false_alarms AS false_alarm_episodes_count, split_part(w, '/', 1) AS layer, split_part(w, '/', 2) AS confidence FROM v""",
)
def benchmark_root_cause(spark, sf_dir):
    done = benchmark.run(machine(spark, sf_dir), SETUP, SAID)
    parts = benchmark.decomposition(done, written(benchmark.results(done, SETUP, SAID), "benchmark"), SETUP)
    kept = ("method", "score_separation_auc", "chance_match_probability", "threshold_exceedances_samples", "extreme_clusters_count", "alarm_episodes_count", "matched_alarm_episodes_count", "false_alarm_episodes_count", "layer", "confidence")
    return benchmark.root_cause(parts).select(*kept).withColumns({c: F.round(c, 6) for c in ("score_separation_auc", "chance_match_probability")})
