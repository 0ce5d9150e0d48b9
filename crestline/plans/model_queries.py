"""Fits, resamples, null models and sequential detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.functions.draws import number_sql, share_sql
from crestline.operators import forest, multivariate, resampling, tails
from crestline.plans.data_queries import AXIS, COMPONENTS, FLAGS, LONG, one_axis
from crestline.plans.episode_queries import HITS, USER, by_user, hits, sizes
from crestline.plans.registry import query, table

#: Replicates of intervals, and of null models.
REPLICATES, NULLS = 200, 199


@query("gpd_return_levels")
def gpd_return_levels(spark, sf_dir):
    return tails.pareto_by(table(spark, sf_dir, "events"), "value", ["event_type"], 0.9, 0.99)


@query("spot_thresholds")
def spot_thresholds(spark, sf_dir):
    return tails.adaptive_thresholds(by_user(spark, sf_dir), "value", USER, ["i"])


#: SQL: the interval of the runs index from blocks of length b whose starts are drawn below a bound, replicate by replicate.
def _blocks_sql(b: str, bound: str, run_length: int = 2, replicates: int = REPLICATES) -> str:
    start = f"{number_sql(7, 'user_id', 'replicate', 'k')} % {bound}"
    return f"""WITH {HITS}, nb AS (SELECT user_id, n, ({b})::BIGINT AS b FROM n),
    dr AS (SELECT user_id, n, b, replicate, k, {start} AS s, least(b, n - k * b) AS len FROM nb, (SELECT unnest(range(1, {replicates + 1})) AS replicate), LATERAL (SELECT unnest(range(0, (n - 1) // b + 1)) AS k)),
    re AS (SELECT dr.user_id, replicate, k * b + (h.i - s + n) % n AS spot FROM dr JOIN h ON h.user_id = dr.user_id AND (h.i - s + n) % n < len),
    op AS (SELECT user_id, replicate, coalesce(spot - lag(spot) OVER (PARTITION BY user_id, replicate ORDER BY spot) - 1 > {run_length}, true) AS opens FROM re),
    th AS (SELECT user_id, replicate, count(*) FILTER (opens) / count(*) AS theta FROM op GROUP BY ALL),
    ci AS (SELECT user_id, quantile_cont(theta, 0.025) AS low, quantile_cont(theta, 0.975) AS high, count(*)::INT AS valid FROM th GROUP BY user_id),
    ob AS (SELECT user_id, count(*) FILTER (coalesce(dist - 1 > {run_length}, true)) / count(*) AS theta FROM d GROUP BY user_id)
    SELECT user_id, round(theta, 9) AS theta, round(low, 9) AS low, round(high, 9) AS high, coalesce(valid, 0) AS valid FROM nb LEFT JOIN ci USING (user_id) LEFT JOIN ob USING (user_id)"""


def _interval(spark, sf_dir, circular: bool):
    out = resampling.bootstrap_index(hits(spark, sf_dir).select("user_id", "i"), sizes(spark, sf_dir), USER, 2, REPLICATES, circular=circular)
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in ("theta", "low", "high")], "valid")


@query("bootstrap_extremal_index", _blocks_sql("greatest(2, round(n ** (1 / 3)))", "n"))
def bootstrap_extremal_index(spark, sf_dir):
    return _interval(spark, sf_dir, circular=True)


@query("moving_block_interval", _blocks_sql("greatest(3, floor(sqrt(n)))", "greatest(1, n - b + 1)"))
def moving_block_interval(spark, sf_dir):
    return _interval(spark, sf_dir, circular=False)


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *COMPONENTS)
    return forest.isolation_scores(rows, COMPONENTS, trees=50).select("l_orderkey", "l_linenumber", "isolation_score")


# --- lagged patterns against null models: line items on one axis, in the validation part of it

MAX_LAG = 3
VALIDATION = "floor(m * 0.6), floor(m * 0.6) + floor(m * 0.2) - 1"
PAIRS = "ca AS (SELECT a.c AS source, b.c AS target, lag FROM (SELECT unnest(" + str(COMPONENTS) + ") AS c) a, (SELECT unnest(" + str(COMPONENTS) + f") AS c) b, (SELECT unnest(range(0, {MAX_LAG + 1})) AS lag) WHERE a.c <> b.c)"


def _turned_sql(seed: int = 7) -> str:
    return f"""os AS (SELECT component, replicate, {number_sql(seed, 'component', 'replicate')} % m AS o FROM (SELECT DISTINCT component FROM y), m, (SELECT unnest(range(1, {NULLS + 1})) AS replicate)),
    z AS (SELECT 0 AS replicate, component, i FROM y UNION ALL SELECT replicate, component, (i + o) % m FROM y JOIN os USING (component), m)"""


def _shuffled_sql(seed: int = 7) -> str:
    gap = lambda *keys: f"floor(-ln(1 - {share_sql(seed, *keys)}) * {resampling.GAP_UNITS})::BIGINT + 1"
    return f"""ru AS (SELECT component, min(i) AS s, count(*) AS l FROM (SELECT component, i, i - row_number() OVER (PARTITION BY component ORDER BY i) AS g FROM y) GROUP BY component, g),
    fr AS (SELECT component, m - sum(l)::BIGINT - CASE WHEN sum(l) + count(*) - 1 <= m THEN count(*) - 1 ELSE 0 END AS free, CASE WHEN sum(l) + count(*) - 1 <= m THEN 1 ELSE 0 END AS apart FROM ru, m GROUP BY component, m),
    tu AS (SELECT component, replicate, s, l, {number_sql(seed, 'component', "'turn'", 'replicate', 's')} AS t, {gap('component', "'gap'", 'replicate', 's')} AS g FROM ru, (SELECT unnest(range(1, {NULLS + 1})) AS replicate)),
    su AS (SELECT component, replicate, l, sum(g) OVER w AS gs, sum(l) OVER w - l AS ls, row_number() OVER w - 1 AS nth, sum(g) OVER (PARTITION BY component, replicate) AS al FROM tu WINDOW w AS (PARTITION BY component, replicate ORDER BY t, s)),
    mv AS (SELECT component, replicate, l, (floor(free * gs::DOUBLE / (al + {gap('component', "'last'", 'replicate', "''")})) + ls + apart * nth)::BIGINT AS s FROM su JOIN fr USING (component)),
    z AS (SELECT 0 AS replicate, component, i FROM y UNION ALL SELECT replicate, component, unnest(range(s, s + l)) FROM mv)"""


def _tests_sql(nulls: str, name: str = "ev", inside: str = VALIDATION, asked: str = "ca") -> str:
    """(source, target, lag, n, clusters, theta, p, adjusted) as a table by name, with helpers whose names begin with it."""
    first, last = inside.split(", ")
    return f"""{nulls}, {name}_z AS MATERIALIZED (SELECT replicate, component, i FROM z, m WHERE i >= {first} AND i <= {last}),
    {name}_k AS MATERIALIZED (SELECT a.replicate, a.component AS source, b.component AS target, lag, count(*) AS n FROM {name}_z a, (SELECT unnest(range(0, {MAX_LAG + 1})) AS lag), {name}_z b WHERE b.replicate = a.replicate AND b.i = a.i + lag AND a.component <> b.component GROUP BY ALL),
    {name}_o AS (SELECT {asked}.source, {asked}.target, {asked}.lag, coalesce(k.n, 0) AS n FROM {asked} LEFT JOIN {name}_k k ON k.replicate = 0 AND k.source = {asked}.source AND k.target = {asked}.target AND k.lag = {asked}.lag),
    {name}_p AS (SELECT o.*, (1 + CASE WHEN o.n = 0 THEN {NULLS} ELSE (SELECT count(*) FROM {name}_k k WHERE k.replicate > 0 AND k.source = o.source AND k.target = o.target AND k.lag = o.lag AND k.n >= o.n) END) / {NULLS + 1} AS p FROM {name}_o o),
    {name}_b AS (SELECT *, least(1.0, min(p * c / r) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted0 FROM (SELECT *, count(*) OVER () AS c, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM {name}_p)),
    {name}_d AS (SELECT a.component AS source, b.component AS target, lag, a.i FROM y a, (SELECT unnest(range(0, {MAX_LAG + 1})) AS lag), y b, m WHERE b.i = a.i + lag AND a.component <> b.component AND a.i BETWEEN {first} AND {last}),
    {name}_c AS (SELECT source, target, lag, count(*) FILTER (coalesce(i - before - lag - 1 > 0, true)) AS clusters, count(*) AS c FROM (SELECT *, lag(i) OVER (PARTITION BY source, target, lag ORDER BY i) AS before FROM {name}_d) GROUP BY ALL),
    {name} AS (SELECT b.source, b.target, b.lag, n, coalesce(clusters, 0) AS clusters, round(clusters / {name}_c.c, 9) AS theta, round(p, 9) AS p, round(min(adjusted0) OVER (PARTITION BY p), 9) AS adjusted FROM {name}_b b LEFT JOIN {name}_c ON b.source = {name}_c.source AND b.target = {name}_c.target AND b.lag = {name}_c.lag)"""


def _axis(spark, sf_dir):
    """(component, i) of the exceedances, samples, and the ends of the validation and the test part."""
    n = table(spark, sf_dir, "lineitem").count()
    a, b = int(n * 0.6), int(n * 0.6) + int(n * 0.2)
    return multivariate.exceedances_long(one_axis(spark, sf_dir), COMPONENTS), n, (a, b - 1), (b, n - 1)


def _rounded(reports):
    return reports.withColumns({c: F.round(c, 9) for c in ("theta", "p", "adjusted")})


@query("pattern_null_time_shift", f"WITH {FLAGS}, {LONG}, {AXIS}, {PAIRS}, {_tests_sql(_turned_sql())} SELECT * FROM ev")
def pattern_null_time_shift(spark, sf_dir):
    hits, n, validation, _ = _axis(spark, sf_dir)
    return _rounded(multivariate.evaluated(hits, COMPONENTS, n, MAX_LAG, "time_shift", NULLS, validation))


@query("cluster_permutation_null", f"WITH {FLAGS}, {LONG}, {AXIS}, {PAIRS}, {_tests_sql(_shuffled_sql())} SELECT * FROM ev")
def cluster_permutation_null(spark, sf_dir):
    hits, n, validation, _ = _axis(spark, sf_dir)
    return _rounded(multivariate.evaluated(hits, COMPONENTS, n, MAX_LAG, "cluster_permutation", NULLS, validation))


@query("top_patterns", f"WITH {FLAGS}, {LONG}, {AXIS}, {PAIRS}, {_tests_sql(_turned_sql())} SELECT * FROM ev WHERE adjusted <= 1 AND n > 0 ORDER BY adjusted, n DESC, lag, source, target LIMIT 5")
def top_patterns(spark, sf_dir):
    hits, n, validation, _ = _axis(spark, sf_dir)
    return multivariate.top_patterns(_rounded(multivariate.evaluated(hits, COMPONENTS, n, MAX_LAG, "time_shift", NULLS, validation)), 5, 1.0)


@query(
    "nested_patterns",
    f"""WITH {FLAGS}, {LONG}, {AXIS}, {PAIRS}, {_tests_sql(_turned_sql())}, ch AS (SELECT * FROM ev WHERE adjusted <= 1 AND n > 0 ORDER BY adjusted, n DESC, lag, source, target LIMIT 5),
    {_tests_sql(_turned_sql(8).replace("os AS", "os2 AS").replace("JOIN os USING", "JOIN os2 USING").replace("z AS (", "z2 AS ("), "he", "floor(m * 0.6) + floor(m * 0.2), m - 1", "ch").replace("FROM z, m", "FROM z2, m")}
    SELECT *, 'validation' AS split FROM ch UNION ALL SELECT *, 'heldout' FROM he""",
)
def nested_patterns(spark, sf_dir):
    hits, n, validation, heldout = _axis(spark, sf_dir)
    return _rounded(multivariate.nested_selection(hits, COMPONENTS, n, MAX_LAG, validation, heldout, 5, 1.0, null_model="time_shift", replicates=NULLS))


@query(
    "group_bootstrap",
    f"""WITH s AS (SELECT user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY user_id), pl AS (SELECT user_id, row_number() OVER (ORDER BY {number_sql(7, "'place'", "user_id")}, user_id) - 1 AS place FROM s),
    dr AS (SELECT replicate, {number_sql(7, "'draw'", "replicate", "k")} % (SELECT count(*) FROM s) AS place FROM (SELECT unnest(range(0, (SELECT count(*) FROM s))) AS k), (SELECT unnest(range(1, 51)) AS replicate))
    SELECT replicate::INT AS replicate, count(*)::BIGINT AS drawn, round(sum(s) / sum(n), 6) AS mean_value FROM dr JOIN pl USING (place) JOIN s USING (user_id) GROUP BY replicate""",
)
def group_bootstrap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "value")
    times = resampling.group_resamples(events, "user_id", 50)
    sums = events.groupBy("user_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    means = times.join(sums, "user_id").groupBy("replicate").agg(F.sum("times").alias("drawn"), (F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean_value"))
    return means.select("replicate", "drawn", F.round("mean_value", 6).alias("mean_value"))
