"""Alarms against failures, calibration, and tables of compared methods.

Roles: high values of the event stream (its position order is the clock) are alarms, long runs of
errors are failures; the length rank of documents plays a probability of their quality label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.operators import detectors, episodes, evaluation, extremal, thresholds
from crestline.operators.evaluation import Policy
from crestline.operators.series import Series, running_sum, with_position
from crestline.plans.registry import query, table
from crestline.session import written

POLICY = Policy(horizon=60, before=0, after=10)
PER_DAY = 1_000


def placed(spark, sf_dir) -> DataFrame:
    return with_position(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), Series((), ("ts", "event_id")))


def alarms(spark, sf_dir) -> DataFrame:
    """High values merged over gaps of 5; alarm_id is the start."""
    cut = thresholds.fit_global(table(spark, sf_dir, "events"), "value", 0.98).select("threshold")
    hits = placed(spark, sf_dir).crossJoin(F.broadcast(cut)).where(thresholds.exceeds(F.col("value"), F.col("threshold"))).select(F.col("i").alias("start"), F.col("i").alias("end"))
    return written(episodes.merged(hits, 5, []).select(F.col("start").alias("alarm_id"), "start", "end"), "alarms")


def failures(spark, sf_dir) -> DataFrame:
    """Three errors that follow at once, merged while at most 120 samples lie between; failure_id is the start."""
    return failures_of(placed(spark, sf_dir))


def failures_of(rows: DataFrame) -> DataFrame:
    """failures() among the event stream's rows with their positions."""
    errors = rows.where("event_type = 'error'").select("i")
    runs = episodes.merged(errors.select(F.col("i").alias("start"), F.col("i").alias("end")), 0, []).where(F.col("end") - F.col("start") >= 2)
    return written(episodes.merged(runs, 120, []).select(F.col("start").alias("failure_id"), "start", "end"), "failures")


P = "p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)"
ALARMS = """cut AS (SELECT round(quantile_cont(value, 0.98), 6) AS t FROM events), ah AS (SELECT i FROM p, cut WHERE value > t),
    ag AS (SELECT i, sum(CASE WHEN i - li - 1 <= 5 THEN 0 ELSE 1 END) OVER (ORDER BY i) AS g FROM (SELECT i, lag(i) OVER (ORDER BY i) AS li FROM ah)),
    a AS (SELECT min(i) AS alarm_id, min(i) AS a_start, max(i) AS a_end FROM ag GROUP BY g)"""
FAILURES = """fh AS (SELECT i, i + 2 AS e FROM (SELECT i, event_type, lead(event_type) OVER w AS e1, lead(event_type, 2) OVER w AS e2 FROM p WINDOW w AS (ORDER BY i)) WHERE event_type = 'error' AND e1 = 'error' AND e2 = 'error'),
    fg AS (SELECT i, e, sum(CASE WHEN i - m - 1 <= 120 THEN 0 ELSE 1 END) OVER (ORDER BY i) AS g FROM (SELECT i, e, max(e) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fh)),
    f AS (SELECT min(i) AS failure_id, min(i) AS f_start, max(e) AS f_end, greatest(0, min(i) - 60) AS w_start, min(i) + 10 AS w_end FROM fg GROUP BY g)"""
PAIRS = """pr AS (SELECT alarm_id, a_start, a_end, failure_id, f_start, f_start - a_start AS lead, CASE WHEN a_start BETWEEN w_start AND w_end THEN a_start - f_start ELSE least(abs(a_start - w_start), abs(a_start - w_end)) + 10000 END AS cost FROM a, f WHERE a_start <= w_end AND w_start <= a_end)"""
BEST = "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY cost, a_start, alarm_id) AS r FROM pr) WHERE r = 1)"
ALL = f"WITH {P}, {ALARMS}, {FAILURES}, {PAIRS}, {BEST}"
OUTCOMES = """oc AS (SELECT 'true_positive' AS kind, failure_id AS id FROM bs UNION ALL SELECT 'false_alarm', alarm_id FROM a WHERE alarm_id NOT IN (SELECT alarm_id FROM pr)
    UNION ALL SELECT DISTINCT 'duplicate', pr.alarm_id FROM pr JOIN bs USING (failure_id) WHERE pr.alarm_id <> bs.alarm_id UNION ALL SELECT 'missed', failure_id FROM f WHERE failure_id NOT IN (SELECT failure_id FROM bs))"""


@query("alarm_intervals", f'{ALL} SELECT alarm_id, a_start AS start, a_end AS "end" FROM a')
def alarm_intervals(spark, sf_dir):
    return alarms(spark, sf_dir)


@query("warning_windows", f'{ALL} SELECT failure_id, f_start AS start, f_end AS "end", w_start, w_end FROM f')
def warning_windows(spark, sf_dir):
    return evaluation.windows(failures(spark, sf_dir), POLICY)


@query("eligible_pairs", f"{ALL} SELECT * FROM pr")
def eligible_pairs(spark, sf_dir):
    return evaluation.eligible(alarms(spark, sf_dir), failures(spark, sf_dir), POLICY)


@query("event_outcomes", f"{ALL}, {OUTCOMES} SELECT kind, id FROM oc")
def event_outcomes(spark, sf_dir):
    return evaluation.outcomes(alarms(spark, sf_dir), failures(spark, sf_dir), POLICY)


@query(
    "event_evaluation",
    f"""{ALL}, {OUTCOMES}, c AS (SELECT count(*) FILTER (kind = 'true_positive') AS tp, count(*) FILTER (kind = 'false_alarm') AS false_alarms, count(*) FILTER (kind = 'duplicate') AS duplicates, count(*) FILTER (kind = 'missed') AS missed FROM oc),
    l AS (SELECT max(lead)::DOUBLE AS earliest_lead, quantile_cont(lead, 0.5)::DOUBLE AS median_lead, coalesce(sum(greatest(0, -lead)), 0) AS late, avg(greatest(-1.0, least(1.0, lead / 70.0))) AS norm FROM bs), rk AS (SELECT i, value, i >= floor(0.6 * count(*) OVER ()) AS test FROM p), rt AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE i BETWEEN f_start - 60 AND f_start) AS o FROM rk WHERE isfinite(value)),
    rv AS (SELECT value, count(*) FILTER (NOT test) AS c, count(*) FILTER (o AND NOT test) AS e FROM rt GROUP BY value), rs AS (SELECT value, sum(c) OVER w AS c, sum(e) OVER w AS e FROM rv WINDOW w AS (ORDER BY value DESC)), rp AS (SELECT test, o, CASE WHEN rs.c > 0 THEN rs.e / rs.c ELSE (SELECT sum(e) / sum(c) FROM rv) END AS pb FROM rt JOIN rs USING (value) WHERE test), hb AS (SELECT round(avg(pow(pb - o::INT, 2)), 6) AS horizon_brier FROM rp),
    cb AS (SELECT string_agg(bin || ':' || n || ':' || e, ',' ORDER BY bin) AS calibration FROM (SELECT least(9, (pb >= 1/10.0)::INT + (pb >= 2/10.0)::INT + (pb >= 3/10.0)::INT + (pb >= 4/10.0)::INT + (pb >= 5/10.0)::INT + (pb >= 6/10.0)::INT + (pb >= 7/10.0)::INT + (pb >= 8/10.0)::INT + (pb >= 9/10.0)::INT) AS bin, count(*) AS n, count(*) FILTER (o) AS e FROM rp GROUP BY 1)), w AS (SELECT coalesce(sum(a_end - a_start + 1), 0)::BIGINT AS time_under_warning FROM a), n AS (SELECT count(*) AS n FROM events),
    x AS (SELECT *, CASE WHEN tp + false_alarms + duplicates > 0 THEN tp / (tp + false_alarms + duplicates) ELSE 0.0 END AS pr_, CASE WHEN tp + missed > 0 THEN tp / (tp + missed) ELSE 0.0 END AS rc FROM c, l, w, n, hb, cb)
    SELECT tp, false_alarms, duplicates, missed, round(pr_, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr_ + rc > 0 THEN 2 * pr_ * rc / (pr_ + rc) ELSE 0.0 END, 6) AS f1, round(false_alarms * 1000 / n, 6) AS false_alarms_per_day, earliest_lead, median_lead, time_under_warning, round(norm, 6) AS normalised_lead, round(CASE WHEN tp + missed > 0 THEN duplicates / (tp + missed) ELSE 0.0 END, 6) AS duplicates_per_failure, horizon_brier, calibration,
    round((tp - 0.05 * late - 0.2 * false_alarms - 2.0 * missed - 0.1 * duplicates)::DOUBLE, 6) AS utility FROM x""",
)
def event_evaluation(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    known = failures(spark, sf_dir)
    reach = known.select(F.greatest(F.lit(0).cast("long"), F.col("start") - POLICY.horizon).alias("start"), F.col("start").alias("end"))
    rows = written(episodes.within(placed(spark, sf_dir), episodes.merged(reach, 0, []), "outcome").withColumn("fitted_on", F.col("i") < int(0.6 * n)), "outcomes")
    risk = detectors.suffix_rate(rows.where(F.abs("value") < float("inf")), "value", "outcome", "fitted_on").where("not fitted_on").select(F.col("risk").alias("probability"), "outcome")
    out = evaluation.evaluated(alarms(spark, sf_dir), known, POLICY, n, PER_DAY, risk=risk)
    bins = F.array_join(F.transform("calibration_bins", lambda b: F.concat_ws(":", b["bin"], b["n"], F.round(b["n"] * b["event_rate"]).cast("long"))), ",")
    return out.withColumn("calibration", bins).drop("calibration_bins").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "false_alarms_per_day", "utility", "normalised_lead", "duplicates_per_failure", "horizon_brier")})


@query("optimal_matching")
def optimal_matching(spark, sf_dir):
    return evaluation.matched(evaluation.eligible(alarms(spark, sf_dir), failures(spark, sf_dir), POLICY))


@query(
    "warning_separation",
    f"""WITH {P}, {FAILURES}, s AS (SELECT value, EXISTS (SELECT 1 FROM f WHERE i BETWEEN f_start - 60 AND f_start) AS inside FROM p WHERE value IS NOT NULL AND NOT isnan(value)),
    v AS (SELECT value, count(*) AS c, count(*) FILTER (inside) AS k FROM s GROUP BY value), r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS mid FROM v),
    t AS (SELECT sum(mid * k) AS r, sum(k) AS a, sum(c - k) AS b FROM r) SELECT round(CASE WHEN a > 0 AND b > 0 THEN (r - a * (a + 1) / 2) / (a * b) END, 6) AS auc, a::BIGINT AS n_inside, b::BIGINT AS n_outside FROM t""",
)
def warning_separation(spark, sf_dir):
    reach = failures(spark, sf_dir).select(F.greatest(F.lit(0).cast("long"), F.col("start") - 60).alias("start"), F.col("start").alias("end"))
    rows = episodes.within(placed(spark, sf_dir), episodes.merged(reach, 0, []), "inside")
    return evaluation.separation(rows, "value", "inside").withColumn("auc", F.round("auc", 6))


@query("chance_match", f"{ALL}, n AS (SELECT count(*) AS n FROM events) SELECT n_alarms, n_failures, round(1 - exp(-n_alarms::DOUBLE * n_failures * 71 / n), 6) AS chance FROM (SELECT count(*) AS n_alarms FROM a), (SELECT count(*) AS n_failures FROM f), n")
def chance_match(spark, sf_dir):
    counts = alarms(spark, sf_dir).agg(F.count("*").alias("n_alarms")).crossJoin(failures(spark, sf_dir).agg(F.count("*").alias("n_failures"))).crossJoin(table(spark, sf_dir, "events").agg(F.count("*").alias("n")))
    return counts.select("n_alarms", "n_failures", F.round(evaluation.chance_match(F.col("n_alarms"), F.col("n_failures"), POLICY, F.col("n")), 6).alias("chance"))


GAPS, AFTER = [0, 2, 5, 10], [0, 5, 10, 20, 40]


@query(
    "tolerance_surface",
    f"""WITH {P}, {FAILURES}, cut AS (SELECT round(quantile_cont(value, 0.98), 6) AS t FROM events), ah AS (SELECT i, lag(i) OVER (ORDER BY i) AS li FROM p, cut WHERE value > t),
    ag AS (SELECT gap, i, sum(CASE WHEN i - li - 1 <= gap THEN 0 ELSE 1 END) OVER (PARTITION BY gap ORDER BY i) AS g FROM ah, (SELECT unnest({GAPS})::INTEGER AS gap)),
    a AS (SELECT gap, min(i) AS a_start, max(i) AS a_end FROM ag GROUP BY gap, g),
    x AS (SELECT gap, tolerance, count(DISTINCT f_start) AS detected, count(DISTINCT a_start) AS matched_alarms FROM a, f, (SELECT unnest({AFTER})::INTEGER AS tolerance) WHERE a_start <= f_start + tolerance AND greatest(0, f_start - 60) <= a_end GROUP BY ALL)
    SELECT gap, tolerance, n_alarms, detected, n_alarms - matched_alarms AS false_alarms FROM x JOIN (SELECT gap, count(*) AS n_alarms FROM a GROUP BY gap) USING (gap)""",
)
def tolerance_surface(spark, sf_dir):
    cut = thresholds.fit_global(table(spark, sf_dir, "events"), "value", 0.98).select("threshold")
    hits = placed(spark, sf_dir).crossJoin(F.broadcast(cut)).where(thresholds.exceeds(F.col("value"), F.col("threshold"))).select(F.col("i").alias("start"), F.col("i").alias("end"))
    found = None
    for gap in GAPS:
        one = episodes.merged(hits, gap, []).select(F.lit(gap).alias("gap"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
        found = one if found is None else found.unionByName(one)
    found = written(found, "merged")
    grid = failures(spark, sf_dir).select(F.col("start").alias("f_start"), F.explode(F.array(*map(F.lit, AFTER))).alias("tolerance"))
    cell = POLICY.horizon + max(AFTER) + 1
    left = found.withColumn("_c", F.explode(F.sequence(F.floor(F.col("a_start") / cell), F.floor(F.col("a_end") / cell))))
    right = grid.withColumn("w_start", F.greatest(F.lit(0).cast("long"), F.col("f_start") - POLICY.horizon)).withColumn("w_end", F.col("f_start") + F.col("tolerance")).withColumn("_c", F.explode(F.sequence(F.floor(F.col("w_start") / cell), F.floor(F.col("w_end") / cell))))
    met = left.join(right, "_c").where((F.col("a_start") <= F.col("w_end")) & (F.col("w_start") <= F.col("a_end")))
    counts = met.groupBy("gap", "tolerance").agg(F.count_distinct("f_start").alias("detected"), F.count_distinct("a_start").alias("matched"))
    return counts.join(found.groupBy("gap").agg(F.count("*").alias("n_alarms")), "gap").select("gap", "tolerance", "n_alarms", "detected", (F.col("n_alarms") - F.col("matched")).alias("false_alarms"))


RANKED = "v AS (SELECT n_chars, count(*) AS c FROM documents GROUP BY 1), r AS (SELECT n_chars, (coalesce(sum(c) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2) / (SELECT count(*) FROM documents) AS p FROM v), s AS (SELECT doc_id, r.p, quality = 1 AS outcome FROM documents JOIN r USING (n_chars) JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scored_documents(spark, sf_dir) -> DataFrame:
    """Percentile rank (average of ties) of each labelled document's length, and its quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lengths = docs.groupBy("n_chars").agg(F.count("*").alias("c"))
    total = lengths.agg(F.sum("c").alias("n"))
    ranks = running_sum(lengths.where("n_chars is not null"), "n_chars", F.col("c"), "below").crossJoin(F.broadcast(total)).select("n_chars", ((F.col("below") + (F.col("c") + 1) / 2) / F.col("n")).alias("p"))
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("outcome"))
    return docs.join(labels, "doc_id").join(ranks, "n_chars").select("doc_id", "p", "outcome")


@query("brier_score", f"WITH {RANKED} SELECT round(avg(pow(p - outcome::INT, 2)), 6) AS brier, count(*) AS n FROM s")
def brier_score(spark, sf_dir):
    return evaluation.brier(scored_documents(spark, sf_dir), "p", "outcome").withColumn("brier", F.round("brier", 6))


Z = 1.959963984540054


@query(
    "reliability_bins",
    f"""WITH {RANKED}, b AS (SELECT least(4, (p >= 0.2)::INT + (p >= 0.4)::INT + (p >= 0.6)::INT + (p >= 0.8)::INT) AS bin, p, outcome::INT AS o FROM s), g AS (SELECT bin, count(*) AS n, avg(p) AS m, avg(o) AS e FROM b GROUP BY bin)
    SELECT bin, n, round(m, 6) AS mean_probability, round(e, 6) AS event_rate, round(greatest(0.0, (e + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z}*sqrt(e*(1-e)/n + {Z}*{Z}/(4.0*n*n)) / (1 + {Z}*{Z}/n)), 6) AS low, round(least(1.0, (e + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z}*sqrt(e*(1-e)/n + {Z}*{Z}/(4.0*n*n)) / (1 + {Z}*{Z}/n)), 6) AS high FROM g""",
)
def reliability_bins(spark, sf_dir):
    out = evaluation.reliability(scored_documents(spark, sf_dir), "p", "outcome", 5)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_probability", "event_rate", "low", "high")})


#: A table of compared methods: the grid of thresholds and merge gaps, scored on the event stream.
GRID = f"""WITH {P}, {FAILURES}, q AS (SELECT unnest(quantile_cont(value, [0.95, 0.97, 0.98, 0.99])) AS t, unnest([0.95, 0.97, 0.98, 0.99])::DOUBLE AS quantile FROM events),
    ah AS (SELECT quantile, i, lag(i) OVER (PARTITION BY quantile ORDER BY i) AS li FROM p, q WHERE value > round(t, 6)),
    ag AS (SELECT quantile, i, sum(CASE WHEN i - li - 1 <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY quantile ORDER BY i) AS g FROM ah), a AS (SELECT quantile, min(i) AS a_start, max(i) AS a_end FROM ag GROUP BY quantile, g),
    hit AS (SELECT quantile, a_start, f_start FROM a, f WHERE a_start <= f_start + 10 AND greatest(0, f_start - 60) <= a_end),
    m AS (SELECT quantile, n_alarms, under, (SELECT count(DISTINCT f_start) FROM hit WHERE hit.quantile = x.quantile) AS detected, n_alarms - (SELECT count(DISTINCT a_start) FROM hit WHERE hit.quantile = x.quantile) AS false_alarms, (SELECT median(f_start - a_start) FROM hit WHERE hit.quantile = x.quantile) AS lead FROM (SELECT quantile, count(*) AS n_alarms, sum(a_end - a_start + 1) AS under FROM a GROUP BY quantile) x)"""


def frontier(spark, sf_dir) -> DataFrame:
    levels = [0.95, 0.97, 0.98, 0.99]
    cuts = extremal.cuts_at(table(spark, sf_dir, "events"), F.col("value"), levels).select("quantile", F.col("threshold").alias("t"))
    hits = placed(spark, sf_dir).crossJoin(F.broadcast(cuts)).where(F.col("value") > F.col("t")).select("quantile", F.col("i").alias("start"), F.col("i").alias("end"))
    found = episodes.merged(hits, 5, ["quantile"])
    numbered = found.withColumn("alarm_id", F.struct("quantile", "start"))
    met = evaluation.eligible(numbered, failures(spark, sf_dir), POLICY).select("alarm_id.quantile", "a_start", "failure_id", "lead")
    sums = found.groupBy("quantile").agg(F.count("*").alias("n_alarms"), F.sum(F.col("end") - F.col("start") + 1).alias("under"))
    of = met.groupBy("quantile").agg(F.count_distinct("failure_id").alias("detected"), F.count_distinct("a_start").alias("_m"), F.percentile("lead", F.lit(0.5)).alias("lead"))
    return sums.join(of, "quantile", "left").select("quantile", "n_alarms", "under", F.coalesce("detected", F.lit(0)).alias("detected"), (F.col("n_alarms") - F.coalesce("_m", F.lit(0))).alias("false_alarms"), "lead")


@query("threshold_frontier", f"{GRID} SELECT quantile, n_alarms, under::BIGINT AS under, detected, false_alarms, lead FROM m")
def threshold_frontier(spark, sf_dir):
    return frontier(spark, sf_dir)


@query(
    "utility_sensitivity",
    f"""{GRID}, w AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 5.0])::DOUBLE AS multiplier), n AS (SELECT count(*) AS n FROM events)
    SELECT quantile, multiplier, round((CASE WHEN detected > 0 THEN 100.0 ELSE 0.0 END - multiplier * (false_alarms * 1000.0 / n) - 10.0 * (under / n) + CASE WHEN detected > 0 AND lead IS NOT NULL THEN 5.0 * least(greatest(lead, 0.0), 7200.0) / 7200.0 ELSE 0.0 END)::DOUBLE, 6) AS utility FROM m, w, n""",
)
def utility_sensitivity(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    grid = frontier(spark, sf_dir).withColumn("multiplier", F.explode(F.array(*map(F.lit, [0.0, 0.5, 1.0, 2.0, 5.0]))))
    per_day, coverage = F.col("false_alarms") * float(PER_DAY) / n, F.col("under") / n
    return grid.select("quantile", "multiplier", F.round(evaluation.joint_utility(F.col("detected") > 0, F.col("multiplier") * per_day, coverage, F.col("lead")), 6).alias("utility"))


@query("best_method", f"{GRID} SELECT quantile, n_alarms, detected, false_alarms FROM m ORDER BY detected DESC, false_alarms, quantile LIMIT 1")
def best_method(spark, sf_dir):
    order = Window.orderBy(F.desc("detected"), "false_alarms", "quantile")
    return frontier(spark, sf_dir).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("quantile", "n_alarms", "detected", "false_alarms")


@query(
    "fairness_signatures",
    f"""{GRID}, s AS (SELECT detected, min(quantile) AS first_quantile, count(*) AS methods FROM m GROUP BY detected) SELECT detected, first_quantile, methods FROM s""",
)
def fairness_signatures(spark, sf_dir):
    return frontier(spark, sf_dir).groupBy("detected").agg(F.min("quantile").alias("first_quantile"), F.count("*").alias("methods"))


METHODS = [
    detectors.Method("value_98", "value", 0.98, merge_gap=5), detectors.Method("value_95", "value", 0.95, merge_gap=5), detectors.Method("difference_98", "difference_score", 0.98, merge_gap=5),
    detectors.Method("value_runs", "value", 0.98, "decluster", run_length=10), detectors.Method("excess_99", "excess_score", 0.99, merge_gap=0),
]


def _sql_method(m: detectors.Method, k: int) -> str:
    col = {"value": "value", "difference_score": "ds", "excess_score": "es"}[m.score]
    gap, end = (m.merge_gap, "max(i)") if m.policy == "flags" else (m.run_length, "min(i)")
    return f"SELECT '{m.name}' AS method, min(i) AS start, {end} AS \"end\" FROM (SELECT i, sum(CASE WHEN i - li - 1 <= {gap} THEN 0 ELSE 1 END) OVER (ORDER BY i) AS g FROM (SELECT i, lag(i) OVER (ORDER BY i) AS li FROM s, c WHERE NOT train AND {col} > round(t{k}, 9) AND r{k} <= 0.5)) GROUP BY g"


_COLUMN = {"value": "value", "difference_score": "ds", "excess_score": "es"}


@query(
    "benchmark_alarms",
    f"WITH {P}, s AS (SELECT i, value, coalesce(abs(value - lag(value) OVER (ORDER BY i)), 0.0) AS ds, coalesce(value - max(value) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS es, i < floor(0.6 * count(*) OVER ()) AS train FROM p), q AS (SELECT {', '.join(f'quantile_cont({_COLUMN[m.score]}, {m.quantile}) AS t{k}' for k, m in enumerate(METHODS))} FROM s WHERE train), c AS (SELECT any_value(t0) AS t0, {', '.join(f'any_value(t{k}) AS t{k}' for k in range(1, len(METHODS)))}, {', '.join(f'avg(({_COLUMN[m.score]} > t{k})::INT) AS r{k}' for k, m in enumerate(METHODS))} FROM s, q WHERE train) "
    + " UNION ALL ".join(_sql_method(m, k) for k, m in enumerate(METHODS)),
)
def benchmark_alarms(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    rows = detectors.running_excess(detectors.difference_score(written(placed(spark, sf_dir), "placed"), "value", []), "value", [])
    return detectors.benchmark_alarms(rows, METHODS, f"i < {int(0.6 * n)}", f"i >= {int(0.6 * n)}")
