"""Reports: diagnostics of one measure, matching, selection of thresholds, sensors and methods, calibration by split, patterns, regions and transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.draws import number_sql
from crestline.operators import detectors, evaluation, matching, multivariate, preparation, regions, selection, univariate
from crestline.operators.recurrence import horizon_outcome
from crestline.operators.series import split_label
from crestline.plans.alarm_queries import ALL, GRID, PER_DAY, POLICY, P, alarms, failures, frontier, placed
from crestline.plans.data_queries import COMPONENTS, FLAGS, component_flags
from crestline.plans.episode_queries import BLOCKS, BY_USER, HITS, USER, by_user, hits, sizes
from crestline.plans.registry import query, table

LEVELS = [0.9, 0.95, 0.98]


@query(
    "threshold_diagnostics",
    f"""WITH q AS (SELECT unnest(quantile_cont(value, {LEVELS})) AS t, unnest({LEVELS})::DOUBLE AS quantile FROM events)
    SELECT quantile, round(t, 6) AS threshold, count(value) AS exceedances, round(avg(value - round(t, 6)), 6) AS mean_excess FROM q LEFT JOIN events ON value > round(t, 6) AND isfinite(value) GROUP BY quantile, t""",
)
def threshold_diagnostics(spark, sf_dir):
    return univariate.threshold_diagnostics(table(spark, sf_dir, "events"), "value", LEVELS).withColumn("mean_excess", F.round("mean_excess", 6))


@query(
    "estimator_report",
    f"""WITH {HITS}, {BLOCKS}, s AS (SELECT user_id, count(*) AS hits, count(dist) AS n_gaps, sum(CASE WHEN dist IS NULL OR dist - 1 > 2 THEN 1 ELSE 0 END) AS clusters, max(dist) AS longest, sum(dist - 1) AS d1, sum((dist - 1) * (dist - 2)) AS d2,
        count(*) FILTER (dist - 2 <= 0) AS n0, count(*) FILTER (dist - 2 > 0) AS n1, coalesce(sum(greatest(dist - 2, 0)), 0) AS s FROM d GROUP BY user_id),
    k AS (SELECT s.*, hits::DOUBLE / n * s AS a, n0 + 2 * n1 + hits::DOUBLE / n * s AS b FROM s JOIN n USING (user_id)),
    e AS (SELECT user_id, 'none' AS estimator, 1.0 AS t FROM s UNION ALL SELECT user_id, 'runs', clusters / hits FROM s
        UNION ALL SELECT user_id, 'intervals', CASE WHEN n_gaps = 0 THEN NULL WHEN longest <= 2 THEN 1.0 ELSE least(1.0, 2.0 * d1 * d1 / (n_gaps * nullif(d2, 0))) END FROM s
        UNION ALL SELECT user_id, 'k_gaps', CASE WHEN n1 = 0 THEN NULL WHEN n0 = 0 THEN least(1.0, 2 * n1 / a) ELSE least(1.0, (b - sqrt(b * b - 8 * n1 * a)) / (2 * a)) END FROM k
        UNION ALL SELECT user_id, 'blocks', CASE WHEN occupied >= blocks THEN 1.0 WHEN blocks > 0 THEN least(1.0, -ln(1 - occupied::DOUBLE / blocks) / (5.0 * o.hits / n)) END FROM s LEFT JOIN o USING (user_id)
        UNION ALL SELECT user_id, 'reciprocal_blocks', CASE WHEN occupied > 0 THEN occupied / inside END FROM s LEFT JOIN o USING (user_id))
    SELECT user_id, estimator, round(t, 6) AS estimate, CASE WHEN t IS NULL THEN 'failed' ELSE 'succeeded' END AS status, round(CASE WHEN t > 0 THEN 1 / t END, 6) AS mean_cluster_size,
        coalesce(least(600, greatest(1, CASE WHEN t > 0 THEN round_even(1 / t, 0) END)), 1)::INTEGER AS derived_run_length FROM e""",
)
def estimator_report(spark, sf_dir):
    out = univariate.estimates(hits(spark, sf_dir), sizes(spark, sf_dir), USER, 2, 5)
    return out.withColumns({c: F.round(c, 6) for c in ("estimate", "mean_cluster_size")})


RUNS = [0, 2, 5]


@query(
    "stability_pivot",
    f"""WITH p AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), q AS (SELECT unnest(quantile_cont(value, {LEVELS})) AS t, unnest({LEVELS})::DOUBLE AS quantile FROM events),
    d AS (SELECT quantile, i - lag(i) OVER (PARTITION BY quantile ORDER BY i) AS dist FROM p, q WHERE value > round(t, 6))
    SELECT quantile, {', '.join(f"round(avg(CASE WHEN dist IS NULL OR dist - 1 > {k} THEN 1.0 ELSE 0.0 END), 6) AS run_{k}" for k in RUNS)} FROM d GROUP BY quantile""",
)
def stability_pivot(spark, sf_dir):
    from crestline.operators import extremal

    grid = extremal.stability(placed(spark, sf_dir), LEVELS, RUNS)
    return univariate.pivoted(grid, RUNS).select("quantile", *[F.round(f"run_{k}", 6).alias(f"run_{k}") for k in RUNS])


# --- matching


def pairs(spark, sf_dir) -> DataFrame:
    return evaluation.eligible(alarms(spark, sf_dir), failures(spark, sf_dir), POLICY)


#: SQL: pairs gone through in order, skipping what is taken.
WALK = "{name} AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS ua, []::BIGINT[] AS uf, 0::BIGINT AS a, 0::BIGINT AS f, false AS took UNION ALL SELECT o.r, CASE WHEN t THEN list_append(ua, o.alarm_id) ELSE ua END, CASE WHEN t THEN list_append(uf, o.failure_id) ELSE uf END, o.alarm_id, o.failure_id, t FROM (SELECT g.*, NOT list_contains(ua, x.alarm_id) AND NOT list_contains(uf, x.failure_id) AS t, x AS o FROM {name} g JOIN {ordered} x ON x.r = g.r + 1))"


@query(
    "greedy_matching",
    f"""WITH RECURSIVE {ALL.removeprefix('WITH ')}, ord AS (SELECT *, row_number() OVER (ORDER BY cost, f_start, a_start, failure_id, alarm_id) AS r FROM pr), {WALK.format(name='g', ordered='ord')}
    SELECT pr.alarm_id, pr.failure_id, pr.lead, pr.cost, round(greatest(-1.0, least(1.0, pr.lead / 70.0)), 6) AS normalised_lead, (1.0 - 0.05 * greatest(0, -pr.lead))::DOUBLE AS utility FROM g JOIN pr ON pr.alarm_id = g.a AND pr.failure_id = g.f WHERE took""",
)
def greedy_matching(spark, sf_dir):
    lead = F.col("lead")
    return matching.matches(pairs(spark, sf_dir), "greedy").select("alarm_id", "failure_id", "lead", "cost", F.round(matching.normalised_lead(lead, POLICY), 6).alias("normalised_lead"), matching.assignment_utility(lead, 1.0, 0.05).alias("utility"))


@query("reuse_matching", f"{ALL} SELECT failure_id, alarm_id, lead FROM bs")
def reuse_matching(spark, sf_dir):
    return matching.matches(pairs(spark, sf_dir), reuse=True).select("failure_id", "alarm_id", "lead")


@query(
    "overlap_metrics",
    f"""WITH RECURSIVE {ALL.removeprefix('WITH ')}, ov AS (SELECT alarm_id, a_start, failure_id, f_start, abs(a_start - f_start) AS apart FROM a, f WHERE a_start <= f_end AND f_start <= a_end),
    ord AS (SELECT *, row_number() OVER (ORDER BY f_start, failure_id, apart, a_start, alarm_id) AS r FROM ov), {WALK.format(name='g', ordered='ord')},
    c AS (SELECT (SELECT count(*) FROM g WHERE took) AS tp, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM f) AS nf, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM ov GROUP BY failure_id)) AS dbl, (SELECT avg(f_start - s) FROM (SELECT f_start, min(a_start) AS s FROM ov GROUP BY failure_id, f_start)) AS mean_lead),
    x AS (SELECT *, CASE WHEN na > 0 THEN tp / na ELSE 0.0 END AS p_, CASE WHEN nf > 0 THEN tp / nf ELSE 0.0 END AS r_ FROM c)
    SELECT round(p_, 6) AS precision, round(r_, 6) AS recall, round(CASE WHEN p_ + r_ > 0 THEN 2 * p_ * r_ / (p_ + r_) ELSE 0.0 END, 6) AS f1, na - tp AS false_alarms, nf - tp AS missed, round(CASE WHEN nf > 0 THEN dbl / nf ELSE 0.0 END, 6) AS duplicate_rate, round(mean_lead, 6) AS mean_lead FROM x""",
)
def overlap_metrics(spark, sf_dir):
    out = matching.overlap_metrics(alarms(spark, sf_dir), failures(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "duplicate_rate", "mean_lead")})


@query(
    "alarm_decomposition",
    f"""{ALL}, cl AS (SELECT count(*) FILTER (li IS NULL OR i - li - 1 > 2) AS clusters, count(*) AS exceedances FROM (SELECT i, lag(i) OVER (ORDER BY i) AS li FROM ah))
    SELECT exceedances, clusters, (SELECT count(*) FROM a) AS episodes, (SELECT count(*) FROM a WHERE alarm_id NOT IN (SELECT alarm_id FROM pr)) AS false_episodes, (SELECT count(DISTINCT failure_id) FROM pr) AS detected FROM cl""",
)
def alarm_decomposition(spark, sf_dir):
    from crestline.operators import episodes, thresholds

    cut = thresholds.fit_global(table(spark, sf_dir, "events"), "value", 0.98).select("threshold")
    found = placed(spark, sf_dir).crossJoin(F.broadcast(cut)).where(thresholds.exceeds(F.col("value"), F.col("threshold"))).select("i")
    met = pairs(spark, sf_dir)
    stages = found.agg(F.count("*").alias("exceedances")).crossJoin(episodes.onsets(found, 2, []).agg(F.count("*").alias("clusters"))).crossJoin(alarms(spark, sf_dir).agg(F.count("*").alias("episodes")))
    return stages.crossJoin(met.agg(F.count_distinct("alarm_id").alias("_m"), F.count_distinct("failure_id").alias("detected"))).select("exceedances", "clusters", "episodes", (F.col("episodes") - F.col("_m")).alias("false_episodes"), "detected")


# --- splits, calibration and selection: the event stream in its global order

SPLIT = f"{P}, e AS (SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split, event_type = 'error' AS target FROM p, (SELECT count(*) AS n FROM events))"


def in_splits(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return placed(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("split", split_label(F.col("i"), F.col("n"))).withColumn("target", F.col("event_type") == "error").drop("n")


@query("split_summary", f"WITH {SPLIT} SELECT split, count(*) AS n, count(*) FILTER (target) AS positives, count(DISTINCT event_type) AS regimes FROM e GROUP BY split")
def split_summary(spark, sf_dir):
    return evaluation.split_summary(in_splits(spark, sf_dir), "split", "target", "event_type")


SHARES = f"{SPLIT}, v AS (SELECT value, count(*) FILTER (split = 'train') AS c FROM e WHERE value IS NOT NULL GROUP BY value), c AS (SELECT value, sum(c) OVER (ORDER BY value) / sum(c) OVER () AS share FROM v), s AS (SELECT e.*, share FROM e JOIN c USING (value))"
Z = 1.959963984540054


@query(
    "split_calibration",
    f"""WITH {SHARES}, b AS (SELECT split, least(9, {' + '.join(f'(share >= {k / 10})::INT' for k in range(1, 10))}) AS bin, share, target::INT AS o FROM s), g AS (SELECT split, bin, count(*) AS n, avg(share) AS m, avg(o) AS r FROM b GROUP BY ALL)
    SELECT split, bin, n, round(m, 6) AS mean_probability, round(r, 6) AS event_rate, round(greatest(0.0, (r + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z}*sqrt(r*(1-r)/n + {Z}*{Z}/(4.0*n*n)) / (1 + {Z}*{Z}/n)), 6) AS low, round(least(1.0, (r + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z}*sqrt(r*(1-r)/n + {Z}*{Z}/(4.0*n*n)) / (1 + {Z}*{Z}/n)), 6) AS high FROM g
    UNION ALL SELECT split, -1, count(*), round(avg(pow(share - o, 2)), 6), round(avg(o), 6), NULL, NULL FROM b GROUP BY split""",
)
def split_calibration(spark, sf_dir):
    rows = detectors.train_share(in_splits(spark, sf_dir).withColumn("train", F.col("split") == "train"), "value", "train")
    out = evaluation.split_calibration(rows, "split", "share", "target")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_probability", "event_rate", "low", "high")})


@query(
    "suffix_risk",
    f"""WITH {SPLIT}, v AS (SELECT value, count(*) FILTER (split = 'validation') AS c, count(*) FILTER (split = 'validation' AND target) AS k FROM e WHERE value IS NOT NULL GROUP BY value),
    r AS (SELECT value, sum(c) OVER w AS c, sum(k) OVER w AS k, sum(k) OVER () / sum(c) OVER () AS rate FROM v WINDOW w AS (ORDER BY value DESC)) SELECT event_id, round(CASE WHEN c > 0 THEN k / c ELSE rate END, 6) AS risk FROM e LEFT JOIN r USING (value) WHERE split = 'test'""",
)
def suffix_risk(spark, sf_dir):
    rows = in_splits(spark, sf_dir).withColumn("calibration", F.col("split") == "validation")
    return detectors.suffix_rate(rows, "value", "target", "calibration").where("split = 'test'").select("event_id", F.round("risk", 6).alias("risk"))


CANDIDATES = [20.0, 50.0, 80.0, 100.0, 150.0]
OBJECTIVES = f"{SPLIT}, k AS (SELECT unnest({CANDIDATES})::DOUBLE AS threshold, unnest([0, 1, 2, 3, 4])::INTEGER AS place), v AS (SELECT * FROM e WHERE split = 'validation')"
F1 = "CASE WHEN count(*) FILTER (value >= threshold) + count(*) FILTER (target) > 0 THEN 2.0 * count(*) FILTER (value >= threshold AND target) / (count(*) FILTER (value >= threshold) + count(*) FILTER (target)) ELSE 0.0 END"


@query("threshold_objectives", f"WITH {OBJECTIVES} SELECT place, threshold, count(*) AS n, round({F1}, 9) AS objective FROM k, v GROUP BY place, threshold")
def threshold_objectives(spark, sf_dir):
    return selection.objectives(in_splits(spark, sf_dir).where("split = 'validation'"), "value", CANDIDATES, "target")


@query("selected_threshold", f"WITH {OBJECTIVES}, o AS (SELECT place, threshold, round({F1}, 9) AS objective FROM k, v GROUP BY place, threshold) SELECT threshold, objective FROM o ORDER BY objective DESC, place LIMIT 1")
def selected_threshold(spark, sf_dir):
    return selection.selected(threshold_objectives(spark, sf_dir)).select("threshold", "objective")


@query("selected_threshold_by_rate", f"WITH {OBJECTIVES}, o AS (SELECT place, threshold, round(-abs(count(*) FILTER (value >= threshold) / count(*) - 0.02), 9) AS objective FROM k, v GROUP BY place, threshold) SELECT threshold, objective FROM o ORDER BY objective DESC, place LIMIT 1")
def selected_threshold_by_rate(spark, sf_dir):
    return selection.selected(selection.objectives(in_splits(spark, sf_dir).where("split = 'validation'"), "value", CANDIDATES)).select("threshold", "objective")


@query(
    "engineering_predictions",
    f"WITH {OBJECTIVES}, o AS (SELECT place, threshold, round({F1}, 9) AS objective FROM k, v GROUP BY place, threshold), t AS (SELECT threshold FROM o ORDER BY objective DESC, place LIMIT 1) SELECT event_id, i, 'engineering_threshold' AS method, value AS score, threshold, coalesce(value >= threshold, false) AS alarm FROM e, t WHERE split = 'test'",
)
def engineering_predictions(spark, sf_dir):
    chosen = selected_threshold(spark, sf_dir).first()["threshold"]
    return selection.prediction_table(in_splits(spark, sf_dir).where("split = 'test'"), "engineering_threshold", "value", chosen, ["event_id"])


@query("horizon_rmse", f"WITH {BY_USER}, x AS (SELECT event_type, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY i), 0) AS d FROM u) SELECT event_type, round(sqrt(avg(d * d)), 6) AS rmse FROM x GROUP BY event_type")
def horizon_rmse(spark, sf_dir):
    from pyspark.sql.window import Window

    error = F.col("value") - F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("i")), F.lit(0.0))
    return by_user(spark, sf_dir).withColumn("error", error).groupBy("event_type").agg(F.round(evaluation.rmse(F.col("error")), 6).alias("rmse"))


@query(
    "lag_features",
    f"WITH {BY_USER}, m AS (SELECT quantile_cont(value, 0.5) AS m FROM u WHERE i < 20) SELECT event_id, coalesce(lag(value) OVER w, m) AS value__lag_1, coalesce(lag(value, 3) OVER w, m) AS value__lag_3 FROM u, m WINDOW w AS (PARTITION BY user_id ORDER BY i)",
)
def lag_features(spark, sf_dir):
    return preparation.lag_features(by_user(spark, sf_dir), ["value"], [1, 3], "i < 20", USER).select("event_id", "value__lag_1", "value__lag_3")


@query("degraded_orders", "SELECT o_orderkey, o_orderstatus IS DISTINCT FROM 'O' OR o_orderpriority IS DISTINCT FROM '5-LOW' AS is_degraded FROM orders")
def degraded_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", preparation.deviates({"o_orderstatus": "O", "o_orderpriority": "5-LOW"}).alias("is_degraded"))


# --- methods compared

METRICS = f"{GRID}, w AS (SELECT quantile, CASE WHEN quantile >= 0.98 THEN 'strict' ELSE 'loose' END AS category, n_alarms, detected, false_alarms, 2.0 * detected / (n_alarms + (SELECT count(*) FROM f)) AS f1, under / (SELECT count(*) FROM events) > 0.5 AS degenerate FROM m)"


def compared(spark, sf_dir) -> DataFrame:
    n, known = table(spark, sf_dir, "events").agg(F.count("*").alias("_n")), failures(spark, sf_dir).agg(F.count("*").alias("_f"))
    rows = frontier(spark, sf_dir).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(known))
    return rows.select("quantile", "n_alarms", "detected", "false_alarms", (2 * F.col("detected") / (F.col("n_alarms") + F.col("_f"))).alias("f1"), (F.col("under") / F.col("_n") > 0.5).alias("degenerate"))


@query("compact_benchmark", f"{METRICS} SELECT category, quantile, round(f1, 6) AS f1, false_alarms, degenerate FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY degenerate, round(f1, 9) DESC, false_alarms, quantile) AS r FROM w) WHERE r = 1")
def compact_benchmark(spark, sf_dir):
    rows = compared(spark, sf_dir).withColumn("f1", F.round("f1", 9))
    best = selection.best_of_category(rows, F.when(F.col("quantile") >= 0.98, "strict").otherwise("loose"), burden="false_alarms", tie="quantile")
    return best.select("category", "quantile", F.round("f1", 6).alias("f1"), "false_alarms", "degenerate")


@query("full_benchmark", f"{METRICS} SELECT quantile, n_alarms, detected, false_alarms, round(f1, 6) AS f1, degenerate, NULL::VARCHAR AS note FROM w")
def full_benchmark(spark, sf_dir):
    out = selection.full_benchmark(compared(spark, sf_dir), ["quantile", "n_alarms", "detected", "false_alarms", "f1", "degenerate", "note"], ["quantile"])
    return out.withColumn("f1", F.round("f1", 6)).withColumn("note", F.col("note").cast("string"))


# --- sensors

LABELLED = "l AS (SELECT l_returnflag = 'R' AS y, unnest([" + ", ".join(f"{{'k': {k}, 'c': '{c}', 'x': abs({c})}}" for k, c in enumerate(COMPONENTS)) + "]) AS e FROM lineitem)"
SEPARATED = f"{LABELLED}, s AS (SELECT e.k::INTEGER AS place, e.c AS sensor, quantile_cont(e.x, 0.98) > quantile_cont(e.x, 0.5) AS eligible, round((quantile_cont(e.x, 0.5) FILTER (y) - quantile_cont(e.x, 0.5) FILTER (NOT y)) / CASE WHEN stddev_pop(e.x) FILTER (NOT y) > 0 THEN stddev_pop(e.x) FILTER (NOT y) ELSE 1.0 END, 6) AS separation FROM l GROUP BY e.k, e.c)"


def labelled_items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*COMPONENTS, (F.col("l_returnflag") == "R").alias("failing"))


@query("sensor_separation", f"WITH {SEPARATED} SELECT place, sensor, eligible, separation FROM s")
def sensor_separation(spark, sf_dir):
    return selection.sensor_separation(labelled_items(spark, sf_dir), COMPONENTS, "failing")


@query("best_sensor", f"WITH {SEPARATED} SELECT sensor, separation FROM s WHERE eligible OR NOT (SELECT bool_or(eligible) FROM s) ORDER BY separation DESC, place LIMIT 1")
def best_sensor(spark, sf_dir):
    return selection.best_sensor(selection.sensor_separation(labelled_items(spark, sf_dir), COMPONENTS, "failing")).select("sensor", "separation")


@query("single_sensor_score", f"WITH {SEPARATED}, b AS (SELECT sensor FROM s WHERE eligible OR NOT (SELECT bool_or(eligible) FROM s) ORDER BY separation DESC, place LIMIT 1) SELECT l_suppkey, round(max(abs(CASE sensor {' '.join(f"WHEN '{c}' THEN {c}" for c in COMPONENTS)} END)), 6) AS score, count(*) AS n FROM lineitem, b GROUP BY l_suppkey")
def single_sensor_score(spark, sf_dir):
    chosen = best_sensor(spark, sf_dir).first()["sensor"]
    scored = selection.single_sensor_score(table(spark, sf_dir, "lineitem"), chosen, "score")
    return scored.groupBy("l_suppkey").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n"))


@query("rarest_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 16")
def rarest_orders(spark, sf_dir):
    return detectors.rarest(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 16, ["o_orderkey"])


@query("mean_square_residual", f"SELECT l_suppkey, round(avg(({' + '.join(f'{c} * {c}' for c in COMPONENTS)}) / 4), 4) AS residual FROM lineitem GROUP BY l_suppkey")
def mean_square_residual(spark, sf_dir):
    # without a component a projection leaves all of a row over
    rows = detectors.projection_residual(table(spark, sf_dir, "lineitem"), COMPONENTS, [])
    return rows.groupBy("l_suppkey").agg(F.round(F.avg("residual"), 4).alias("residual"))


@query("projection_residual")
def projection_residual(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    rows = detectors.projection_residual(items, COMPONENTS, detectors.principal_components(items, COMPONENTS, 3))
    return rows.groupBy("l_suppkey").agg(F.round(F.avg("residual"), 4).alias("residual"))


# --- patterns of two components

MAX_LAG = 3
LONG = f"{FLAGS}, x AS (" + " UNION ALL ".join(f"SELECT l_suppkey, i, '{c}' AS component FROM f WHERE {c}" for c in COMPONENTS) + f"), dt AS (SELECT a.l_suppkey, a.component AS source, b.component AS target, b.i - a.i AS lag, a.i FROM x a JOIN x b ON a.l_suppkey = b.l_suppkey AND b.i - a.i BETWEEN 0 AND {MAX_LAG} AND a.component <> b.component)"


def pattern_hits(spark, sf_dir) -> DataFrame:
    each = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in COMPONENTS]), lambda c: c.isNotNull())
    return component_flags(spark, sf_dir).select("l_suppkey", "i", F.explode(each).alias("component"))


@query(
    "pattern_report",
    f"""WITH {LONG}, m AS (SELECT *, max(i + lag) OVER (PARTITION BY source, target, lag, l_suppkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM dt)
    SELECT source, target, lag, count(*) AS n, count(*) FILTER (reach IS NULL OR i - reach - 1 > 0) AS clusters, round(count(*) FILTER (reach IS NULL OR i - reach - 1 > 0) / count(*), 6) AS theta FROM m GROUP BY source, target, lag""",
)
def pattern_report(spark, sf_dir):
    found = multivariate.lag_detections(pattern_hits(spark, sf_dir), ["l_suppkey"], MAX_LAG)
    return multivariate.pattern_report(found, ["l_suppkey"]).withColumn("theta", F.round("theta", 6))


CONTAINED = "sz AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)"


@query("masked_pattern_counts", f"WITH {LONG}, {CONTAINED} SELECT source, target, lag, count(*) AS n FROM dt JOIN sz USING (l_suppkey) WHERE i + lag < floor(0.6 * sz.n) GROUP BY source, target, lag")
def masked_pattern_counts(spark, sf_dir):
    # a detection counts if the whole window lies in the training share of its supplier
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    found = multivariate.lag_detections(pattern_hits(spark, sf_dir), ["l_suppkey"], MAX_LAG).join(n, "l_suppkey")
    return found.where(F.col("i") + F.col("lag") < F.floor(0.6 * F.col("n"))).groupBy("source", "target", "lag").agg(F.count("*").alias("n"))


@query("contained_windows", f"WITH {FLAGS}, {CONTAINED}, cw AS (SELECT l_suppkey, count(*) FILTER (i < floor(0.6 * n)) OVER (PARTITION BY l_suppkey ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 AS inside FROM f JOIN sz USING (l_suppkey)) SELECT l_suppkey, count(*) FILTER (inside) AS windows FROM cw GROUP BY l_suppkey")
def contained_windows(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = component_flags(spark, sf_dir).join(n, "l_suppkey").withColumn("train", F.col("i") < F.floor(0.6 * F.col("n")))
    return multivariate.contained(rows, "train", 4, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count_if("contained").alias("windows"))


# --- regions and transfer

FIRST = "st AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), rf AS (SELECT vec_id AS ref_id, e AS r FROM st WHERE e[1] >= (SELECT quantile_cont(e[1], 0.98) FROM st)), ds AS (SELECT st.vec_id, min(list_distance(e, r)) AS d FROM st, rf GROUP BY st.vec_id)"


@query("region_scores", f"WITH {FIRST} SELECT vec_id, round(d, 5) AS distance_to_dangerous_region, round(-ln(greatest(d, 1e-12)), 4) AS dangerous_region_observable, d <= 1e-12 AS exact_reference_duplicate, d <= 1e-6 AS small_metric_scale FROM ds")
def region_scores(spark, sf_dir):
    from crestline.operators.series import quantiles

    states = regions.check_states(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    cut = quantiles(states, F.col("embedding")[0], [0.98], []).select(F.col("q")[0].alias("_cut"))
    refs = regions.from_constraint(states.crossJoin(F.broadcast(cut)), F.col("embedding")[0] >= F.col("_cut")).select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    out = regions.scored(states, refs, "vec_id", "embedding")
    return out.withColumn("distance_to_dangerous_region", F.round("distance_to_dangerous_region", 5)).withColumn("dangerous_region_observable", F.round("dangerous_region_observable", 4))


#: SQL of a transfer: parts of one type are the source, those of a second train the destination, which the others test.
FEATURES = ["p_size", "p_retailprice"]
_SCALES = "{n}s AS (SELECT [quantile_cont(p_size, 0.5), quantile_cont(p_retailprice, 0.5)] AS c, [CASE WHEN quantile_cont(p_size, 0.75) <> quantile_cont(p_size, 0.25) THEN quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) ELSE 1 END, CASE WHEN quantile_cont(p_retailprice, 0.75) <> quantile_cont(p_retailprice, 0.25) THEN quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) ELSE 1 END] AS s FROM {t})"
_PICKED = "{n}p AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS m FROM {t} WHERE failing) WHERE m <= 16 OR list_contains([floor(k * ((m - 1) / 15.0::DOUBLE))::BIGINT for k in range(16)], r))"
_DIST = "{n} AS (SELECT p_partkey, any_value(failing) AS failing, min(sqrt(pow((p_size - c[1]) / s[1] - (a - c[1]) / s[1], 2) + pow((p_retailprice - c[2]) / s[2] - (b - c[2]) / s[2], 2))) AS d FROM {t}, {s}s, {p}p GROUP BY p_partkey)"
TRANSFER = ", ".join(
    [
        "pt AS (SELECT *, p_size > 45 AS failing FROM part), so AS (SELECT * FROM pt WHERE p_type = 'ECONOMY'), tr AS (SELECT * FROM pt WHERE p_type = 'STANDARD'), te AS (SELECT * FROM pt WHERE p_type NOT IN ('ECONOMY', 'STANDARD'))",
        _SCALES.format(n="so", t="so"), _SCALES.format(n="tr", t="tr"), _PICKED.format(n="so", t="so"), _PICKED.format(n="tr", t="tr"),
        _DIST.format(n="d1", t="so", s="so", p="so"), _DIST.format(n="d2", t="tr", s="tr", p="so"), _DIST.format(n="d3", t="tr", s="tr", p="tr"), _DIST.format(n="e1", t="te", s="so", p="so"), _DIST.format(n="e2", t="te", s="tr", p="so"), _DIST.format(n="e3", t="te", s="tr", p="tr"),
        "cu AS (SELECT (SELECT quantile_cont(d, 0.02) FROM d1) AS far, (SELECT quantile_cont(d, 0.02) FROM d2) AS moved, (SELECT quantile_cont(d, 0.02) FROM d3) AS own)",
        "al AS (SELECT 'direct' AS protocol, failing, d <= far AS alarm FROM e1, cu UNION ALL SELECT 'rescaled', failing, d <= far FROM e2, cu UNION ALL SELECT 'recalibrated', failing, d <= moved FROM e2, cu UNION ALL SELECT 'refit', failing, d <= own FROM e3, cu)",
        "su AS (SELECT protocol, count(*) FILTER (alarm) AS alarms, count(*) FILTER (alarm AND failing) AS hits, count(*) FILTER (failing) AS failing, count(*) AS n FROM al GROUP BY protocol), ra AS (SELECT *, CASE WHEN alarms + failing > 0 THEN 2 * hits / (alarms + failing) ELSE 0.0 END AS f1 FROM su)",
    ]
)


@query(
    "transfer_protocols",
    f"WITH {TRANSFER} SELECT protocol, alarms, hits, failing, n, round(CASE WHEN alarms > 0 THEN hits / alarms ELSE 0.0 END, 6) AS precision, round(CASE WHEN failing > 0 THEN hits / failing ELSE 0.0 END, 6) AS recall, round(alarms / n, 6) AS occupancy, round(f1, 6) AS f1, round((SELECT f1 FROM ra WHERE protocol = 'refit') - f1, 6) AS degradation FROM ra",
)
def transfer_protocols(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("failing", F.col("p_size") > 45)
    source, train, test = parts.where("p_type = 'ECONOMY'"), parts.where("p_type = 'STANDARD'"), parts.where("p_type not in ('ECONOMY', 'STANDARD')")
    out = regions.transferred(source, train, test, FEATURES, "failing", "p_partkey")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "occupancy", "f1", "degradation")})


@query("standardised_parts", f"WITH {TRANSFER} SELECT p_partkey, round(coalesce((p_size - c[1]) / s[1], 0), 6) AS size, round(coalesce((p_retailprice - c[2]) / s[2], 0), 6) AS price FROM te, trs")
def standardised_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    train, test = parts.where("p_type = 'STANDARD'"), parts.where("p_type not in ('ECONOMY', 'STANDARD')")
    out = regions.standardised(test, FEATURES, regions.scales_of(train, FEATURES))
    return out.select("p_partkey", F.round(F.col("state")[0], 6).alias("size"), F.round(F.col("state")[1], 6).alias("price"))


@query("down_sampled", f"SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {number_sql(7, 'event_id')}, event_id) <= 100")
def down_sampled(spark, sf_dir):
    return selection.down_sampled(table(spark, sf_dir, "events"), 100, ["event_type"], ["event_id"]).select("event_id", "event_type", "value")
