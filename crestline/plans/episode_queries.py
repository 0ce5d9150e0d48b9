"""Thresholds, episodes, extremal indices and recurrence of the event stream.

A user's events in time order are a series; the flagship takes all events as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators import episodes, extremal, recurrence, thresholds
from crestline.operators.series import Series, with_position
from crestline.plans.registry import query, table

USER = ["user_id"]
#: SQL: events numbered by user, with the global threshold of a quantile.
BY_USER = "u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
CUT = "cut AS (SELECT round(quantile_cont(value, {q}), 6) AS threshold FROM events WHERE isfinite(value))"
HITS = f"{BY_USER}, {CUT.format(q=0.9)}, h AS (SELECT u.* FROM u, cut WHERE value > threshold AND NOT isnan(value)), d AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS dist FROM h), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"


def by_user(spark, sf_dir: str) -> DataFrame:
    return with_position(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), Series(("user_id",), ("ts", "event_id")))


def flagged(spark, sf_dir: str, q: float = 0.9) -> DataFrame:
    events = by_user(spark, sf_dir)
    cut = thresholds.fit_global(table(spark, sf_dir, "events"), "value", q).select("threshold")
    return events.crossJoin(F.broadcast(cut)).withColumn("hit", thresholds.exceeds(F.col("value"), F.col("threshold")))


def hits(spark, sf_dir: str, q: float = 0.9) -> DataFrame:
    return flagged(spark, sf_dir, q).where("hit")


def sizes(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))


#: SQL: thresholds by event type, and what holds for types that weren't fitted or aren't known.
FIT = """g AS (SELECT round(quantile_cont(value, 0.98) FILTER (isfinite(value)), 6) AS t, count(*) FILTER (isfinite(value)) AS n FROM events),
    r AS (SELECT coalesce(event_type, '<NA>') AS regime, CASE WHEN count(*) FILTER (isfinite(value)) >= 100 THEN round(quantile_cont(value, 0.98) FILTER (isfinite(value)), 6) ELSE (SELECT t FROM g) END AS threshold, count(*) FILTER (isfinite(value)) AS n, count(*) FILTER (isfinite(value)) >= 100 AS own FROM events GROUP BY ALL)"""


@query(
    "flagship_episodes",
    f"""WITH {FIT}, p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
    h AS (SELECT p.i, p.value FROM g, p LEFT JOIN r ON coalesce(p.event_type, '<NA>') = r.regime WHERE p.value > coalesce(r.threshold, g.t) AND NOT isnan(p.value)),
    c AS (SELECT *, sum(CASE WHEN i - lag_i - 1 <= 10 THEN 0 ELSE 1 END) OVER (ORDER BY i) - 1 AS cluster_id FROM (SELECT *, lag(i) OVER (ORDER BY i) AS lag_i FROM h))
    SELECT cluster_id::BIGINT AS cluster_id, min(i) AS start, max(i) AS "end", max(i) - min(i) + 1 AS duration, count(*) AS size, max(value) AS max_value FROM c GROUP BY cluster_id""",
)
def flagship_episodes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    placed = with_position(events, Series((), ("ts", "event_id")))
    fitted = thresholds.fit_regimes(events, "value", "event_type", 0.98)
    found = thresholds.apply_regimes(placed, fitted, "value", "event_type").where("exceeds").select("i", "value")
    return episodes.clusters(found, 10, [], value="value").select("cluster_id", "start", "end", "duration", "size", "max_value")


@query("global_threshold", "SELECT round(quantile_cont(value, 0.98), 6) AS threshold, count(*) AS n FROM events WHERE isfinite(value)")
def global_threshold(spark, sf_dir):
    return thresholds.fit_global(table(spark, sf_dir, "events"), "value", 0.98)


@query("regime_thresholds", f"WITH {FIT} SELECT regime, threshold, n, own FROM r UNION ALL SELECT '<ANY>', t, n, false FROM g")
def regime_thresholds(spark, sf_dir):
    return thresholds.fit_regimes(table(spark, sf_dir, "events"), "value", "event_type", 0.98)


@query("regime_exceedances", f"WITH {FIT} SELECT event_id, event_type, value, coalesce(threshold, t) AS threshold FROM g, events LEFT JOIN r ON coalesce(event_type, '<NA>') = regime WHERE value > coalesce(threshold, t) AND NOT isnan(value)")
def regime_exceedances(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return thresholds.apply_regimes(events, thresholds.fit_regimes(events, "value", "event_type", 0.98), "value", "event_type").where("exceeds").select("event_id", "event_type", "value", "threshold")


@query(
    "regime_fallback",
    """WITH e AS (SELECT *, CASE WHEN event_type <> 'view' THEN event_type END AS regime FROM events), f AS (SELECT * FROM e WHERE regime IS NULL OR regime <> 'error'),
    g AS (SELECT round(quantile_cont(value, 0.95) FILTER (isfinite(value)), 6) AS t FROM f), r AS (SELECT coalesce(regime, '<NA>') AS r, round(quantile_cont(value, 0.95) FILTER (isfinite(value)), 6) AS threshold FROM f GROUP BY ALL HAVING count(*) FILTER (isfinite(value)) >= 100)
    SELECT event_id, event_type, coalesce(threshold, t) AS threshold FROM g, e LEFT JOIN r ON coalesce(regime, '<NA>') = r WHERE value > coalesce(threshold, t) AND NOT isnan(value)""",
)
def regime_fallback(spark, sf_dir):
    # views have no regime, and no error is among the training rows
    events = table(spark, sf_dir, "events").withColumn("regime", F.when(F.col("event_type") != "view", F.col("event_type")))
    fitted = thresholds.fit_regimes(events.where("regime is null or regime <> 'error'"), "value", "regime", 0.95)
    return thresholds.apply_regimes(events, fitted, "value", "regime").where("exceeds").select("event_id", "event_type", "threshold")


@query(
    "component_thresholds",
    """WITH l AS (SELECT l_returnflag AS regime, unnest([{'c': 'l_quantity', 'x': l_quantity}, {'c': 'l_extendedprice', 'x': l_extendedprice}, {'c': 'l_discount', 'x': l_discount}, {'c': 'l_tax', 'x': l_tax}]) AS e FROM lineitem)
    SELECT e.c AS component, regime, round(quantile_cont(e.x, 0.95), 6) AS threshold, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT e.c, '<ANY>', round(quantile_cont(e.x, 0.95), 6), count(*) FROM l GROUP BY ALL""",
)
def component_thresholds(spark, sf_dir):
    return thresholds.fit_components(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag", 0.95)


@query(
    "shrinkage_thresholds",
    """WITH g AS (SELECT quantile_cont(value, 0.95) AS g FROM events), r AS (SELECT event_type AS regime, quantile_cont(value, 0.95) AS r FROM events GROUP BY event_type)
    SELECT regime, round(r, 6) AS regime_threshold, round(g, 6) AS global_threshold, round(0.7 * r + 0.3 * g, 6) AS shrunk_threshold, round(r - g, 6) AS gap FROM r, g""",
)
def shrinkage_thresholds(spark, sf_dir):
    return thresholds.shrunk(table(spark, sf_dir, "events"), "value", "event_type", 0.95, 0.3)


CLUSTERED = f"{HITS}, c AS (SELECT *, sum(CASE WHEN dist - 1 <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) - 1 AS cluster_id FROM d)"


@query("clusters_by_user", f'WITH {CLUSTERED} SELECT user_id, cluster_id::BIGINT AS cluster_id, min(i) AS start, max(i) AS "end", max(i) - min(i) + 1 AS duration, count(*) AS size, max(value) AS max_value FROM c GROUP BY ALL')
def clusters_by_user(spark, sf_dir):
    return episodes.clusters(hits(spark, sf_dir), 2, USER, value="value")


@query("cluster_members", f"WITH {CLUSTERED} SELECT event_id, user_id, i, cluster_id::BIGINT AS cluster_id FROM c")
def cluster_members(spark, sf_dir):
    return episodes.clustered(hits(spark, sf_dir), 2, USER).select("event_id", "user_id", "i", "cluster_id")


@query("declustered_onsets", f"WITH {HITS} SELECT event_id, user_id, i FROM d WHERE dist IS NULL OR dist - 1 > 2")
def declustered_onsets(spark, sf_dir):
    return episodes.onsets(hits(spark, sf_dir), 2, USER).select("event_id", "user_id", "i")


@query(
    "episode_ids",
    f"WITH {CLUSTERED} SELECT u.event_id, u.user_id, coalesce(c.cluster_id, -1)::BIGINT AS episode_id FROM u LEFT JOIN c USING (event_id)",
)
def episode_ids(spark, sf_dir):
    members = episodes.clustered(hits(spark, sf_dir), 2, USER).select("event_id", "cluster_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(members, "event_id", "left").select("event_id", "user_id", F.coalesce("cluster_id", F.lit(-1)).alias("episode_id"))


MERGED = """iv AS (SELECT user_id, i AS start, i + CAST(floor(abs(value)) AS BIGINT) % 4 AS "end" FROM h),
    o AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    g AS (SELECT *, sum(CASE WHEN start - reach - 1 <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS grp FROM o),
    m AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY user_id, grp)"""


def _spans(spark, sf_dir):
    return hits(spark, sf_dir).select("user_id", F.col("i").alias("start"), (F.col("i") + F.floor(F.abs("value")) % 4).alias("end"))


@query("merge_intervals", f'WITH {HITS}, {MERGED.format(gap=1)} SELECT user_id, start, "end" FROM m')
def merge_intervals(spark, sf_dir):
    return episodes.merged(_spans(spark, sf_dir), 1, USER)


@query("time_under_warning", f'WITH {HITS}, {MERGED.format(gap=0)} SELECT user_id, sum("end" - start + 1)::BIGINT AS samples FROM m GROUP BY user_id')
def time_under_warning(spark, sf_dir):
    return episodes.covered(_spans(spark, sf_dir), USER)


@query(
    "circular_shift",
    f"""WITH {HITS}, {MERGED.format(gap=0)}, s AS (SELECT user_id, n, (start + 7) % n AS a, (least("end", n - 1) + 7) % n AS b FROM m JOIN n USING (user_id))
    SELECT user_id, a AS start, b AS "end" FROM s WHERE a <= b UNION ALL SELECT user_id, 0, b FROM s WHERE a > b UNION ALL SELECT user_id, a, n - 1 FROM s WHERE a > b""",
)
def circular_shift(spark, sf_dir):
    # around each user's own length; what a span claims beyond the last sample isn't there to be rolled
    spans = episodes.merged(_spans(spark, sf_dir), 0, USER).join(sizes(spark, sf_dir), USER)
    return episodes.shifted(spans.withColumn("end", F.least("end", F.col("n") - 1)), F.col("n"), 7).select("user_id", "start", "end")


@query("ei_runs", f"WITH {HITS} SELECT user_id, round(sum(CASE WHEN dist IS NULL OR dist - 1 > 2 THEN 1 ELSE 0 END) / count(*), 6) AS theta, count(*) AS n_hits FROM d GROUP BY user_id")
def ei_runs(spark, sf_dir):
    return extremal.runs_index(hits(spark, sf_dir), USER, 2).withColumn("theta", F.round("theta", 6))


@query(
    "ei_intervals",
    f"""WITH {HITS}, s AS (SELECT user_id, count(*) AS n_gaps, max(dist) AS longest, sum(dist - 1) AS d1, sum((dist - 1) * (dist - 2)) AS d2 FROM d WHERE dist IS NOT NULL GROUP BY user_id)
    SELECT user_id, round(CASE WHEN longest <= 2 THEN 1.0 ELSE least(1.0, 2.0 * d1 * d1 / (n_gaps * nullif(d2, 0))) END, 6) AS theta, n_gaps FROM s""",
)
def ei_intervals(spark, sf_dir):
    return extremal.intervals_index(hits(spark, sf_dir), USER).withColumn("theta", F.round("theta", 6))


@query(
    "ei_k_gaps",
    f"""WITH {HITS}, s AS (SELECT user_id, count(*) AS hits, count(*) FILTER (greatest(dist - 2, 0) = 0 AND dist IS NOT NULL) AS n0, count(*) FILTER (dist - 2 > 0) AS n1, coalesce(sum(greatest(dist - 2, 0)) FILTER (dist IS NOT NULL), 0) AS s FROM d GROUP BY user_id),
    k AS (SELECT s.*, hits::DOUBLE / n * s AS a, n0 + 2 * n1 + hits::DOUBLE / n * s AS b FROM s JOIN n USING (user_id))
    SELECT user_id, round(CASE WHEN n0 + n1 = 0 THEN NULL WHEN n1 = 0 THEN NULL WHEN n0 = 0 THEN least(1.0, 2 * n1 / a) ELSE least(1.0, (b - sqrt(b * b - 8 * n1 * a)) / (2 * a)) END, 6) AS theta, n0, n1 FROM k""",
)
def ei_k_gaps(spark, sf_dir):
    return extremal.k_gaps_index(hits(spark, sf_dir), sizes(spark, sf_dir), USER).withColumn("theta", F.round("theta", 6))


BLOCKS = "b AS (SELECT user_id, n, n // 5 AS blocks, i // 5 AS b, count(*) AS c FROM h JOIN n USING (user_id) GROUP BY ALL), o AS (SELECT user_id, n, blocks, sum(c) AS hits, count(*) FILTER (b < blocks) AS occupied, coalesce(sum(c) FILTER (b < blocks), 0) AS inside FROM b WHERE blocks > 0 GROUP BY ALL)"


@query(
    "ei_blocks",
    f"WITH {HITS}, {BLOCKS} SELECT user_id, round(CASE WHEN occupied >= blocks THEN 1.0 ELSE least(1.0, -ln(1 - occupied::DOUBLE / blocks) / (5.0 * hits / n)) END, 6) AS theta, occupied, blocks::BIGINT AS blocks FROM o",
)
def ei_blocks(spark, sf_dir):
    return extremal.blocks_index(hits(spark, sf_dir), sizes(spark, sf_dir), USER, 5).withColumn("theta", F.round("theta", 6))


@query("ei_reciprocal_blocks", f"WITH {HITS}, {BLOCKS} SELECT user_id, round(occupied / inside, 6) AS theta FROM o WHERE occupied > 0")
def ei_reciprocal_blocks(spark, sf_dir):
    return extremal.reciprocal_index(hits(spark, sf_dir), sizes(spark, sf_dir), USER, 5).withColumn("theta", F.round("theta", 6))


@query(
    "ei_by_regime",
    f"""WITH {FIT}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
    d AS (SELECT event_type, i - lag(i) OVER (PARTITION BY event_type ORDER BY i) AS dist FROM g, p LEFT JOIN r ON coalesce(event_type, '<NA>') = regime WHERE value > coalesce(threshold, t) AND NOT isnan(value))
    SELECT event_type, round(sum(CASE WHEN dist IS NULL OR dist - 1 > 10 THEN 1 ELSE 0 END) / count(*), 6) AS theta, count(*) AS n_hits FROM d GROUP BY event_type""",
)
def ei_by_regime(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    placed = with_position(events, Series(("event_type",), ("ts", "event_id")))
    found = thresholds.apply_regimes(placed, thresholds.fit_regimes(events, "value", "event_type", 0.98), "value", "event_type").where("exceeds")
    return extremal.runs_index(found, ["event_type"], 10).withColumn("theta", F.round("theta", 6))


QS, RUNS = [0.9, 0.95, 0.97, 0.98, 0.99], [0, 2, 5, 10, 20]


@query(
    "threshold_run_stability",
    f"""WITH p AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), q AS (SELECT unnest({QS}) AS quantile),
    t AS (SELECT quantile, round((SELECT quantile_cont(value, quantile) FROM events), 6) AS threshold FROM q),
    t2 AS (SELECT q.quantile, round(list_extract(x.l, idx), 6) AS threshold FROM (SELECT quantile_cont(value, {QS}) AS l FROM events) x, (SELECT unnest({QS}) AS quantile, unnest([1, 2, 3, 4, 5]) AS idx) q),
    d AS (SELECT quantile, threshold, i - lag(i) OVER (PARTITION BY quantile ORDER BY i) AS dist FROM p, t2 WHERE value > threshold)
    SELECT quantile::DOUBLE AS quantile, threshold, run_length, count(*) AS hits, sum(CASE WHEN dist IS NULL OR dist - 1 > run_length THEN 1 ELSE 0 END)::BIGINT AS clusters, round(sum(CASE WHEN dist IS NULL OR dist - 1 > run_length THEN 1 ELSE 0 END) / count(*), 6) AS theta
    FROM d, (SELECT unnest({RUNS})::INTEGER AS run_length) GROUP BY ALL""".replace("t AS (SELECT quantile, round((SELECT quantile_cont(value, quantile) FROM events), 6) AS threshold FROM q),\n    ", "").replace(", q AS (SELECT unnest([0.9, 0.95, 0.97, 0.98, 0.99]) AS quantile)", ""),
)
def threshold_run_stability(spark, sf_dir):
    placed = with_position(table(spark, sf_dir, "events").select("event_id", "ts", "value"), Series((), ("ts", "event_id")))
    return extremal.stability(placed, QS, RUNS).withColumn("theta", F.round("theta", 6))


@query("return_times", f"WITH {HITS} SELECT event_id, user_id, dist AS return_time FROM d WHERE dist IS NOT NULL")
def return_times(spark, sf_dir):
    return recurrence.return_times(hits(spark, sf_dir), USER).select("event_id", "user_id", "return_time")


@query("first_hit", f"WITH {HITS}, f AS (SELECT user_id, min(i) - 3 AS wait FROM h WHERE i >= 3 GROUP BY user_id) SELECT n.user_id, wait FROM n LEFT JOIN f USING (user_id)")
def first_hit(spark, sf_dir):
    return recurrence.first_hit(flagged(spark, sf_dir), "hit", USER, 3)


AHEAD = f"{BY_USER}, {CUT.format(q=0.9)}, f AS (SELECT u.*, coalesce(value > threshold AND NOT isnan(value), false) AS hit, count(*) OVER (PARTITION BY user_id) AS n FROM u, cut), x AS (SELECT *, min(CASE WHEN hit THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN {{first}} AND UNBOUNDED FOLLOWING) AS nx FROM f)"


@query("horizon_outcomes", f"WITH {AHEAD.format(first='1 FOLLOWING')} SELECT event_id, coalesce(nx - i <= 6, false) AS outcome FROM x")
def horizon_outcomes(spark, sf_dir):
    return recurrence.horizon_outcome(flagged(spark, sf_dir), "hit", USER, 6).select("event_id", "outcome")


@query("future_positive", f"WITH {AHEAD.format(first='CURRENT ROW')} SELECT event_id, coalesce(nx - i <= 6, false) AS outcome FROM x")
def future_positive(spark, sf_dir):
    return recurrence.horizon_outcome(flagged(spark, sf_dir), "hit", USER, 6, inclusive=True).select("event_id", "outcome")


@query("hit_probability", f"WITH {AHEAD.format(first='1 FOLLOWING')} SELECT user_id, count(*) AS starts, round(avg(CASE WHEN nx - i <= 6 THEN 1.0 ELSE 0.0 END), 6) AS probability FROM x WHERE i < n - 6 GROUP BY user_id")
def hit_probability(spark, sf_dir):
    return recurrence.hit_probability(flagged(spark, sf_dir), "hit", USER, 6).withColumn("probability", F.round("probability", 6))


@query(
    "forward_hit_rate",
    f"WITH {AHEAD.format(first='1 FOLLOWING')} SELECT event_id, round(coalesce(sum(hit::INT) OVER w, 0) / greatest(1, count(*) OVER w), 6) AS rate FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)",
)
def forward_hit_rate(spark, sf_dir):
    return recurrence.forward_rate(flagged(spark, sf_dir), "hit", USER, 6).select("event_id", F.round("rate", 6).alias("rate"))
