"""Negative controls and timelines of the event stream's alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.operators import controls, statespace, timeline
from crestline.plans.alarm_queries import ALARMS, FAILURES, PER_DAY, POLICY, P, alarms, failures, placed
from crestline.plans.episode_queries import USER, by_user
from crestline.plans.registry import query, table

DRAWS = 40
STEPS = f"""WITH {P}, {ALARMS}, {FAILURES}, n AS (SELECT count(*) AS n FROM events), k AS (SELECT unnest(range(0, {DRAWS})) AS draw),
    s AS (SELECT draw, (a_start + (draw + 1) * (n // {DRAWS}) % n) % n AS x, (a_end + (draw + 1) * (n // {DRAWS}) % n) % n AS y, n FROM a, k, n),
    w AS (SELECT draw, x AS start, y AS e FROM s WHERE x <= y UNION ALL SELECT draw, 0, y FROM s WHERE x > y UNION ALL SELECT draw, x, n - 1 FROM s WHERE x > y),
    o AS (SELECT *, sum(CASE WHEN start - r - 1 <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY draw ORDER BY start, e) AS g FROM (SELECT *, max(e) OVER (PARTITION BY draw ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w)),
    m AS (SELECT draw, min(start) AS start, max(e) AS e FROM o GROUP BY draw, g), h AS (SELECT draw, count(DISTINCT failure_id) AS detected, count(DISTINCT start) AS met FROM m, f WHERE start <= w_end AND w_start <= e GROUP BY draw),
    j AS (SELECT draw, count(*) AS alarms, sum(e - start + 1) AS under FROM m GROUP BY draw)"""


def stepped(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    seen = alarms(spark, sf_dir).select("start", "end")
    draws = controls.drawn(seen, seen, n, DRAWS, families=(controls.Family("stepped", "in_turn"),))
    return controls.judged(draws, failures(spark, sf_dir), ["family", "draw"], POLICY, n, PER_DAY), n, seen


@query(
    "control_draws",
    f"{STEPS} SELECT j.draw::INTEGER AS draw, alarms, coalesce(detected, 0) AS detected, alarms - coalesce(met, 0) AS false_alarms, under::BIGINT AS time_under_warning FROM j LEFT JOIN h USING (draw)",
)
def control_draws(spark, sf_dir):
    return stepped(spark, sf_dir)[0].select("draw", "alarms", "detected", "false_alarms", "time_under_warning")


@query(
    "control_summary",
    f"""{STEPS}, ob AS (SELECT (SELECT count(DISTINCT failure_id) FROM a, f WHERE a_start <= w_end AND w_start <= a_end) / (SELECT count(*) FROM f) AS recall), d AS (SELECT coalesce(detected, 0) / (SELECT count(*) FROM f) AS recall FROM j LEFT JOIN h USING (draw))
    SELECT round(any_value(ob.recall), 6) AS observed_value, round(quantile_cont(d.recall, 0.5), 6) AS median, round(avg((d.recall <= ob.recall)::INT), 6) AS percentile, round((1 + count(*) FILTER (d.recall >= ob.recall)) / (count(*) + 1), 6) AS p, count(*) AS draws FROM d, ob""",
)
def control_summary(spark, sf_dir):
    draws, n, seen = stepped(spark, sf_dir)
    observed = controls.judged(seen.withColumn("all", F.lit(0)), failures(spark, sf_dir), ["all"], POLICY, n, PER_DAY)
    out = controls.summary(draws, observed, ("recall",))
    return out.select(*[F.round(c, 6).alias(c) for c in ("observed_value", "median", "percentile", "p")], "draws")


@query("control_families")
def control_families(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    seen = alarms(spark, sf_dir).select("start", "end")
    draws = controls.judged(controls.drawn(seen, seen.where("end > start"), n, 25), failures(spark, sf_dir), ["family", "draw"], POLICY, n, PER_DAY)
    observed = controls.judged(seen.withColumn("all", F.lit(0)), failures(spark, sf_dir), ["all"], POLICY, n, PER_DAY)
    return controls.conditions(draws, observed).groupBy("family", "condition").agg(F.count("*").alias("draws"), F.avg("recall").alias("recall"), F.percentile("false_alarms_per_day", F.lit(0.5)).alias("false_alarms_per_day"))


@query(
    "timeline_overview",
    f"""WITH {P}, {ALARMS}, {FAILURES}, n AS (SELECT count(*) AS n FROM events), b AS (SELECT k AS bin, n * k // 240 AS first, n * (k + 1) // 240 - 1 AS last FROM n, (SELECT unnest(range(0, 240)) AS k))
    SELECT bin::INTEGER AS bin, first, last, (SELECT count(*) FROM a WHERE a_start BETWEEN first AND last) AS alarm_episodes, coalesce((SELECT sum(least(a_end, last) - greatest(a_start, first) + 1) FROM a WHERE a_start <= last AND a_end >= first), 0)::BIGINT AS under_warning,
    (SELECT count(*) FROM ah WHERE i BETWEEN first AND last) AS exceedances, EXISTS (SELECT 1 FROM f WHERE f_start BETWEEN first AND last) AS failure_onset, EXISTS (SELECT 1 FROM f WHERE f_end BETWEEN first AND last) AS reset FROM b""",
)
def timeline_overview(spark, sf_dir):
    from crestline.operators import thresholds

    cut = thresholds.fit_global(table(spark, sf_dir, "events"), "value", 0.98).select("threshold")
    hits = placed(spark, sf_dir).crossJoin(F.broadcast(cut)).where(thresholds.exceeds(F.col("value"), F.col("threshold"))).select("i")
    return timeline.overview(table(spark, sf_dir, "events").count(), alarms(spark, sf_dir), failures(spark, sf_dir), hits)


@query("last_alarm_before_failure", f"WITH {P}, {ALARMS}, {FAILURES} SELECT failure_id, a_start AS alarm_start, a_end AS alarm_end FROM f ASOF LEFT JOIN a ON f_start >= a_start")
def last_alarm_before_failure(spark, sf_dir):
    return timeline.last_before(alarms(spark, sf_dir), failures(spark, sf_dir))


_RISK = " UNION ALL ".join(f"SELECT {h} AS horizon, round(avg((coalesce(nx - i <= {h}, false))::INT), 6) AS probability, round(avg(pow(coalesce(s{h}, 0) / greatest(1, c{h}) - (coalesce(nx - i <= {h}, false))::INT, 2)), 6) AS brier FROM y" for h in (2, 6))


@query(
    "horizon_risk",
    "WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, abs(value - 50) <= 5 AS hit FROM events), x AS (SELECT *, min(CASE WHEN hit THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM u), y AS (SELECT *, "
    + ", ".join(f"sum(hit::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS s{h}, count(*) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS c{h}" for h in (2, 6))
    + f" FROM x) {_RISK}",
)
def horizon_risk(spark, sf_dir):
    rows = by_user(spark, sf_dir).withColumn("distance", F.abs(F.col("value") - 50))
    return statespace.horizon_risk(rows, "distance", USER, 5.0, [2, 6]).select("horizon", F.round("probability", 6).alias("probability"), F.round("brier", 6).alias("brier"))


@query("mahalanobis_states")
def mahalanobis_states(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return statespace.whitened(rows, ["l_quantity", "l_extendedprice", "l_discount"]).select("l_orderkey", "l_linenumber", "white_0", "white_1", "white_2")


@query("medoid_references")
def medoid_references(spark, sf_dir):
    return statespace.medoids(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 16).select("vec_id")
