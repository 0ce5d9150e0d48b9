"""Preparation, regimes, state space, several components and transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators import detectors, multivariate, preparation, regimes, statespace, thresholds, transfer
from crestline.operators.series import Series, running_sum, split_label, with_position
from crestline.plans.episode_queries import BY_USER, USER, by_user
from crestline.plans.registry import query, table
from crestline.session import scratch
from crestline.sources import tables

# --- preparation


def failure_intervals(spark) -> DataFrame:
    """Labelled intervals; where they overlap the later one counts."""
    rows = [("2024-01-02 00:00:00", "2024-01-04 12:00:00", "air leak", 0), ("2024-01-04 00:00:00", "2024-01-05 00:00:00", "oil leak", 1), ("2024-02-01 00:00:00", "2024-02-03 00:00:00", "air leak", 2)]
    return spark.createDataFrame(rows, "start string, end string, kind string, rank int").withColumns({c: F.to_timestamp_ntz(F.col(c)) for c in ("start", "end")})


@query(
    "interval_labels",
    """WITH f AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04 12:00:00', 'air leak', 0), (TIMESTAMP '2024-01-04', TIMESTAMP '2024-01-05', 'oil leak', 1), (TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-03', 'air leak', 2)) v(s, e, kind, rank))
    SELECT event_id, count(kind) > 0 AS is_failure, max_by(kind, rank) AS failure_type FROM events LEFT JOIN f ON ts BETWEEN s AND e GROUP BY event_id""",
)
def interval_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return preparation.label_intervals(events, failure_intervals(spark), "ts").select("event_id", "is_failure", "failure_type")


@query(
    "counter_increments",
    """SELECT o_orderkey, CASE WHEN s >= 0 THEN round(s, 6) END AS o_totalprice__increment, coalesce(s < 0, false) AS counter_reset FROM (SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM orders)""",
)
def counter_increments(spark, sf_dir):
    out = preparation.increments(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.round("o_totalprice__increment", 6).alias("o_totalprice__increment"), "counter_reset")


@query("metadata_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def metadata_join(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    keyed = preparation.unique_join(orders.withColumnRenamed("o_custkey", "c_custkey"), customer, "c_custkey")
    return keyed.join(nation, keyed["c_nationkey"] == nation["n_nationkey"], "left").select("o_orderkey", "c_mktsegment", "n_name")


@query(
    "vehicle_condition",
    """WITH d AS (SELECT o_custkey, abs(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS s, o_orderpriority FROM orders)
    SELECT o_custkey, round(coalesce(max(s), 0), 6) AS score, bool_or(o_orderpriority = '1-URGENT') AS target, count(*) AS readouts FROM d GROUP BY o_custkey""",
)
def vehicle_condition(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, sf_dir, "orders").select("o_custkey", F.abs(F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("s"), "o_orderpriority")
    return steps.groupBy("o_custkey").agg(F.round(F.coalesce(F.max("s"), F.lit(0.0)), 6).alias("score"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("target"), F.count("*").alias("readouts"))


@query(
    "time_quality",
    """WITH s AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS s FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (s = 0) AS duplicates, count(*) FILTER (s < 0) AS backward, count(*) FILTER (s > 3600) AS gaps, round(quantile_cont(s, 0.5) FILTER (s > 0), 3) AS cadence FROM s GROUP BY user_id""",
)
def time_quality(spark, sf_dir):
    return preparation.time_quality(table(spark, sf_dir, "events"), "ts", USER, ["event_id"], 3600).withColumn("cadence", F.round("cadence", 3))


@query(
    "column_statistics",
    """SELECT 'o_custkey' AS "column", 'bigint' AS kind, count(*) AS n, count(*) - count(o_custkey) AS missing, min(o_custkey)::VARCHAR AS low, max(o_custkey)::VARCHAR AS high, count(DISTINCT o_custkey) AS "distinct" FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', count(*), count(*) - count(o_orderpriority), min(o_orderpriority), max(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders""",
)
def column_statistics(spark, sf_dir):
    return preparation.column_statistics(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], exact=True)


@query("split_labels", f"WITH {BY_USER}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT event_id, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM u JOIN n USING (user_id)")
def split_labels(spark, sf_dir):
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy("user_id"))
    return by_user(spark, sf_dir).withColumn("n", n).select("event_id", split_label(F.col("i"), F.col("n")).alias("split"))


@query("split_leakage", "SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 2 = 1)")
def split_leakage(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return preparation.leaked_ids(events.where("event_id % 2 = 0"), events.where("event_type = 'purchase' and event_id % 2 = 1"), "user_id")


@query(
    "trace_summary",
    "SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_samp(e), 6) AS std, round(list_min(e), 6) AS low, round(list_max(e), 6) AS high, round(e[-1], 6) AS last FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
)
def trace_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return preparation.trace_summary(rows, "e").select("vec_id", *[F.round(f"e_{a}", 6).alias(b) for a, b in (("mean", "mean"), ("std", "std"), ("min", "low"), ("max", "high"), ("last", "last"))])


# --- regimes


def ruled(spark, sf_dir) -> DataFrame:
    return regimes.by_rules(by_user(spark, sf_dir), "value", "value", USER, 20.0, 30.0)


RULED = f"{BY_USER}, g AS (SELECT *, CASE WHEN value <= 20 THEN 'off' WHEN coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY i), 0) >= 30 THEN 'recovery' ELSE 'loaded' END AS regime FROM u)"


@query("rule_regime", f"WITH {RULED} SELECT event_id, regime FROM g")
def rule_regime(spark, sf_dir):
    return ruled(spark, sf_dir).select("event_id", "regime")


@query(
    "changepoint_regime",
    f"""WITH {BY_USER}, w AS (SELECT *, count(value) OVER b AS c, avg(value) OVER b AS m, stddev_pop(value) OVER b AS s FROM u WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT event_id, CASE WHEN c < 8 THEN 'stable' WHEN s = 0 AND value > m THEN 'high_shift' WHEN s = 0 AND value < m THEN 'low_shift' WHEN s > 0 AND (value - m) / s >= 3 THEN 'high_shift' WHEN s > 0 AND (value - m) / s <= -3 THEN 'low_shift' ELSE 'stable' END AS regime FROM w""",
)
def changepoint_regime(spark, sf_dir):
    return regimes.by_changepoint(by_user(spark, sf_dir), "value", USER, 8, 3.0).select("event_id", "regime")


@query("quantile_regime", "WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events) SELECT event_id, (value >= q[1])::INT + (value >= q[2])::INT + (value >= q[3])::INT AS regime FROM events, q")
def quantile_regime(spark, sf_dir):
    return regimes.by_quantiles(table(spark, sf_dir, "events"), "value", [0.25, 0.5, 0.75]).select("event_id", "regime")


@query("regime_occupancy", f"WITH {RULED} SELECT regime, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY regime")
def regime_occupancy(spark, sf_dir):
    return regimes.occupancy(ruled(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("regime_transitions", f"WITH {RULED}, t AS (SELECT lag(regime) OVER (PARTITION BY user_id ORDER BY i) AS previous, regime AS current FROM g) SELECT previous, current, count(*) AS n FROM t WHERE previous IS NOT NULL GROUP BY ALL")
def regime_transitions(spark, sf_dir):
    return regimes.transitions(ruled(spark, sf_dir), USER)


@query(
    "regime_durations",
    f"""WITH {RULED}, b AS (SELECT *, CASE WHEN regime = lag(regime) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS b FROM g), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY i) AS run FROM b)
    SELECT user_id, regime, min(i) AS start, count(*) AS duration FROM r GROUP BY user_id, regime, run""",
)
def regime_durations(spark, sf_dir):
    return regimes.durations(ruled(spark, sf_dir), USER)


@query("regime_pooling", f"WITH {RULED}, o AS (SELECT regime, count(*) / (SELECT count(*) FROM g) AS s FROM g GROUP BY regime) SELECT event_id, CASE WHEN s < 0.3 THEN 'pooled' ELSE regime END AS regime FROM g JOIN o USING (regime)")
def regime_pooling(spark, sf_dir):
    return regimes.pooled(ruled(spark, sf_dir), 0.3, "pooled").select("event_id", "regime")


# --- several components: line items of a supplier in shipping order

COMPONENTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SUPPLIER = ["l_suppkey"]
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
FLAGS = """c AS (SELECT round(quantile_cont(l_quantity, 0.9), 6) AS a, round(quantile_cont(l_extendedprice, 0.9), 6) AS b, round(quantile_cont(l_discount, 0.9), 6) AS c, round(quantile_cont(l_tax, 0.9), 6) AS d FROM lineitem),
    f AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_quantity > c.a AS l_quantity, l_extendedprice > c.b AS l_extendedprice, l_discount > c.c AS l_discount, l_tax > c.d AS l_tax FROM lineitem, c)"""


def component_flags(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", *dict.fromkeys((*ORDER, *COMPONENTS)))
    rows = with_position(items, Series(("l_suppkey",), ORDER))
    cuts = statespace.column_quantile(items, COMPONENTS, 0.9, "_").select(*[F.round(f"_{c}", 6).alias(f"_{c}") for c in COMPONENTS])
    return rows.crossJoin(F.broadcast(cuts)).select("l_suppkey", "i", *[thresholds.exceeds(F.col(c), F.col(f"_{c}")).alias(c) for c in COMPONENTS])


@query(
    "simultaneous_vectors",
    f"""WITH {FLAGS}, v AS (SELECT concat_ws('+', CASE WHEN l_quantity THEN 'l_quantity' END, CASE WHEN l_extendedprice THEN 'l_extendedprice' END, CASE WHEN l_discount THEN 'l_discount' END, CASE WHEN l_tax THEN 'l_tax' END) AS v FROM f)
    SELECT CASE WHEN v = '' THEN 'none' ELSE v END AS vector, count(*) AS n FROM v GROUP BY v""",
)
def simultaneous_vectors(spark, sf_dir):
    return multivariate.simultaneous(component_flags(spark, sf_dir), COMPONENTS)


@query(
    "tail_dependence",
    f"WITH {FLAGS}, s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} AND {b}) AS joint, count(*) FILTER ({a}) AS n_left, count(*) FILTER ({b}) AS n_right FROM f" for k, a in enumerate(COMPONENTS) for b in COMPONENTS[k + 1 :])
    + ') SELECT *, round(CASE WHEN n_left > 0 THEN joint / n_left ELSE 0.0 END, 6) AS right_given_left, round(CASE WHEN n_right > 0 THEN joint / n_right ELSE 0.0 END, 6) AS left_given_right FROM s',
)
def tail_dependence(spark, sf_dir):
    out = multivariate.tail_dependence(component_flags(spark, sf_dir), COMPONENTS)
    return out.withColumns({c: F.round(c, 6) for c in ("right_given_left", "left_given_right")})


LONG = "x AS (" + " UNION ALL ".join(f"SELECT l_suppkey, i, '{c}' AS component FROM f WHERE {c}" for c in COMPONENTS) + ")"


@query(
    "lag_surface",
    f"WITH {FLAGS}, {LONG} SELECT a.component AS source, b.component AS target, b.i - a.i AS lag, count(*) AS n FROM x a JOIN x b ON a.l_suppkey = b.l_suppkey AND b.i >= a.i AND a.component <> b.component GROUP BY ALL",
)
def lag_surface(spark, sf_dir):
    hits = multivariate.exceedances_long(component_flags(spark, sf_dir), COMPONENTS, entity=SUPPLIER)
    return multivariate.whole_lag_surface(hits, COMPONENTS, SUPPLIER)


FOUND = f"WITH {FLAGS}, fd AS (SELECT l_suppkey, i FROM (SELECT l_suppkey, i, l_quantity AND coalesce(lead(l_extendedprice, 2) OVER (PARTITION BY l_suppkey ORDER BY i), false) AS ok FROM f) WHERE ok)"


@query("lagged_pattern", f"{FOUND} SELECT * FROM fd")
def lagged_pattern(spark, sf_dir):
    return multivariate.detections(component_flags(spark, sf_dir), ["l_quantity", "l_extendedprice"], [0, 2], SUPPLIER)


@query(
    "lagged_pattern_clusters",
    f"""{FOUND}, g AS (SELECT *, sum(CASE WHEN i - (li + 2) - 1 <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY l_suppkey ORDER BY i) AS li FROM fd))
    SELECT l_suppkey, min(i) AS start, max(i) + 2 AS "end" FROM g GROUP BY l_suppkey, g""",
)
def lagged_pattern_clusters(spark, sf_dir):
    found = multivariate.detections(component_flags(spark, sf_dir), ["l_quantity", "l_extendedprice"], [0, 2], SUPPLIER)
    return multivariate.pattern_clusters(found, 3, 1, SUPPLIER)


NULLS = 19


def one_axis(spark, sf_dir) -> DataFrame:
    """component_flags() with suppliers after each other: each begins where those of smaller keys end."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    begins = running_sum(counts, "l_suppkey", F.col("n"), "begin").select("l_suppkey", "begin")
    return component_flags(spark, sf_dir).join(begins, "l_suppkey").withColumn("i", F.col("begin") + F.col("i")).drop("begin")


#: SQL: exceedances on that axis, of m samples.
AXIS = "bg AS (SELECT l_suppkey, sum(count(*)) OVER (ORDER BY l_suppkey) - count(*) AS begin FROM lineitem GROUP BY l_suppkey), y AS (SELECT component, (begin + i)::BIGINT AS i FROM x JOIN bg USING (l_suppkey)), m AS (SELECT count(*) AS m FROM lineitem)"


@query(
    "time_shift_null",
    f"""WITH {FLAGS}, {LONG}, {AXIS},
    r AS (SELECT replicate, component, (i + (CASE component WHEN 'l_quantity' THEN 0 WHEN 'l_extendedprice' THEN 37 WHEN 'l_discount' THEN 101 ELSE 211 END) * replicate) % m AS i FROM y, m, (SELECT unnest(range(0, {NULLS + 1})) AS replicate)),
    j AS (SELECT a.replicate, a.component AS source, b.component AS target, count(*) AS n FROM r a JOIN r b ON a.replicate = b.replicate AND a.i = b.i AND a.component < b.component GROUP BY ALL)
    SELECT o.source, o.target, o.n, round((1 + (SELECT count(*) FROM j k WHERE k.replicate > 0 AND k.source = o.source AND k.target = o.target AND k.n >= o.n)) / {NULLS + 1}, 6) AS p FROM j o WHERE o.replicate = 0""",
)
def time_shift_null(spark, sf_dir):
    long = multivariate.exceedances_long(one_axis(spark, sf_dir), COMPONENTS)
    m = table(spark, sf_dir, "lineitem").count()
    steps = {"l_quantity": 0, "l_extendedprice": 37, "l_discount": 101, "l_tax": 211}
    offsets = spark.range(NULLS + 1).select(F.col("id").alias("replicate"), F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(k).alias("step")) for c, k in steps.items()])).alias("s")).select("replicate", "s.component", (F.col("s.step") * F.col("replicate")).alias("offset"))
    moved = multivariate.rolled(long, m, offsets)
    # one row for each sample that has an exceedance: components that meet there are counted together
    met = moved.groupBy("replicate", "i").agg(F.array_sort(F.collect_set("component")).alias("c")).where(F.size("c") > 1)
    pairs = met.select("replicate", F.posexplode("c").alias("k", "source"), "c").select("replicate", "source", F.explode(F.slice("c", F.col("k") + 2, F.lit(len(COMPONENTS)))).alias("target"))
    counts = pairs.groupBy("replicate", "source", "target").agg(F.count("*").alias("n"))
    return multivariate.right_tail(counts.where("replicate = 0").drop("replicate"), counts.where("replicate > 0"), ["source", "target"], NULLS).withColumn("p", F.round("p", 6))


@query(
    "bh_adjust",
    """WITH t AS (SELECT l_suppkey, round(1.0 / count(*), 9) AS p FROM lineitem WHERE l_tax > 0.07 GROUP BY l_suppkey), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS k, count(*) OVER () AS m FROM t)
    SELECT l_suppkey, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM r""",
)
def bh_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "lineitem").where("l_tax > 0.07").groupBy("l_suppkey").agg(F.round(1.0 / F.count("*"), 9).alias("p"))
    return multivariate.benjamini_hochberg(tests).select("l_suppkey", "p", F.round("adjusted", 6).alias("adjusted"))


# --- state space

SCALES = "sc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS center, CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1.0 END AS scale FROM lineitem" for c in COMPONENTS) + ")"


@query("robust_scales", f'WITH {SCALES} SELECT "column", round(center, 6) AS center, round(scale, 6) AS scale FROM sc')
def robust_scales(spark, sf_dir):
    return statespace.robust_scales(table(spark, sf_dir, "lineitem"), COMPONENTS).select("column", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query(
    "robust_max_z",
    f"WITH {SCALES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(" + ", ".join(f"abs({c} - (SELECT center FROM sc WHERE \"column\" = '{c}')) / (SELECT scale FROM sc WHERE \"column\" = '{c}')" for c in COMPONENTS) + "), 6) AS score FROM lineitem",
)
def robust_max_z(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return statespace.max_abs_z(rows, COMPONENTS, statespace.robust_scales(rows, COMPONENTS)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("score", 6).alias("score"))


REFERENCES = "vec_id % 40 = 0"
NEAREST = f"""d AS (SELECT e.vec_id, r.vec_id AS ref_id, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda k: (e.embedding[k]::DOUBLE - r.embedding[k]::DOUBLE) ** 2))) AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE {REFERENCES}) r),
    b AS (SELECT vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, ref_id) AS k FROM d) WHERE k = 1)"""


def _nearest(spark, sf_dir):
    states = table(spark, sf_dir, "embeddings")
    return statespace.nearest(states, states.where(REFERENCES).select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref")))


@query("nearest_reference", f"WITH {NEAREST} SELECT vec_id, round(distance, 5) AS distance FROM b")
def nearest_reference(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", F.round("distance", 5).alias("distance"))


TRACES = """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 5) AS mean FROM embeddings"""


def _as_traces(spark, sf_dir):
    """Lines of an id and the numbers of its vector."""
    return table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string"))).alias("value"))


def _trace_means(traces):
    x = F.slice("trace", 2, F.greatest(F.lit(0), F.size("trace") - 1))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return traces.select(F.col("trace")[0].cast("long").alias("vec_id"), F.size(x).cast("long").alias("n"), F.round(total / F.size(x), 5).alias("mean"))


@query("trace_lines", TRACES)
def trace_lines(spark, sf_dir):
    path = scratch(spark, "traces")
    _as_traces(spark, sf_dir).write.text(path)
    return _trace_means(tables.read_traces(spark, path))


@query("zipped_traces", TRACES)
def zipped_traces(spark, sf_dir):
    path = scratch(spark, "archives")
    tables.write_zipped(_as_traces(spark, sf_dir), path, "trace.txt")
    return _trace_means(tables.read_zipped(spark, path, "TRACE.txt"))


@query(
    "nearest_of_other_labels",
    """WITH d AS (SELECT e.vec_id, r.vec_id AS ref_id, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda k: (e.embedding[k]::DOUBLE - r.embedding[k]::DOUBLE) ** 2))) AS distance FROM embeddings e, embeddings r WHERE e.label % 2 = 0 AND r.label % 2 = 1)
    SELECT vec_id, ref_id, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, ref_id) AS k FROM d) WHERE k = 1""",
)
def nearest_of_other_labels(spark, sf_dir):
    # references grow with the table, so they are searched in blocks at any size
    rows = table(spark, sf_dir, "embeddings")
    refs = rows.where("label % 2 = 1").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    return statespace.nearest(rows.where("label % 2 = 0"), refs, most=0).withColumn("distance", F.round("distance", 5))


@query("distance_observable", f"WITH {NEAREST} SELECT vec_id, round(-ln(greatest(distance, 0.001)), 5) AS observable FROM b")
def distance_observable(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", F.round(statespace.observable(F.col("distance"), 0.001), 5).alias("observable"))


@query(
    "density_region",
    """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_extendedprice, 0.5) AS b FROM lineitem), s AS (SELECT quantile_cont(abs(l_quantity - a), 0.5) AS sa, quantile_cont(abs(l_extendedprice - b), 0.5) AS sb FROM lineitem, m),
    d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(((l_quantity - a) / sa) ** 2 + ((l_extendedprice - b) / sb) ** 2), 9) AS x FROM lineitem, m, s), q AS (SELECT round(quantile_cont(x, 0.97), 9) AS c FROM d)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 5) AS density_distance FROM d, q WHERE x >= c""",
)
def density_region(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = statespace.density_region(table(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 0.97)
    return out.where("in_region").select(*keys, F.round("density_distance", 5).alias("density_distance"))


@query("delay_embedding", f"WITH {BY_USER} SELECT event_id, lag(value, 1) OVER w AS value__lag_1, lag(value, 3) OVER w AS value__lag_3 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY i)")
def delay_embedding(spark, sf_dir):
    return statespace.delayed(by_user(spark, sf_dir), ["value"], [1, 3], USER).select("event_id", "value__lag_1", "value__lag_3")


# --- scores


@query("difference_score", f"WITH {BY_USER} SELECT event_id, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)), 0.0), 6) AS difference_score FROM u")
def difference_score(spark, sf_dir):
    return detectors.difference_score(by_user(spark, sf_dir), "value", USER).select("event_id", F.round("difference_score", 6).alias("difference_score"))


@query("running_excess", f"WITH {BY_USER} SELECT event_id, round(coalesce(value - max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS excess_score FROM u")
def running_excess(spark, sf_dir):
    return detectors.running_excess(by_user(spark, sf_dir), "value", USER).select("event_id", F.round("excess_score", 6).alias("excess_score"))


@query(
    "changepoint_score",
    f"""WITH {BY_USER}, w AS (SELECT event_id, count(value) OVER a AS ca, quantile_cont(value, 0.5) OVER a AS ma, count(value) OVER b AS cb, quantile_cont(value, 0.5) OVER b AS mb FROM u WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING))
    SELECT event_id, round(CASE WHEN ca >= 2 AND cb >= 2 THEN abs(ma - mb) ELSE 0.0 END, 6) AS changepoint_score FROM w""",
)
def changepoint_score(spark, sf_dir):
    return detectors.changepoint_score(by_user(spark, sf_dir), "value", USER, 5).select("event_id", F.round("changepoint_score", 6).alias("changepoint_score"))


@query(
    "conformal_tail",
    """WITH v AS (SELECT value, count(*) FILTER (event_id % 2 = 0) AS k FROM events GROUP BY value), r AS (SELECT value, sum(k) OVER (ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above, sum(k) OVER () AS n FROM v)
    SELECT event_id, round((1 + above) / (n + 1), 6) AS tail FROM events JOIN r USING (value)""",
)
def conformal_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), (F.col("event_id") % 2 == 0).alias("train"))
    return detectors.conformal_score(rows, "score", "train").select("event_id", F.round("tail", 6).alias("tail"))


@query("risk_bins", "WITH q AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM events) SELECT (value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT + (value > q[4])::INT AS bin, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS risk FROM events, q GROUP BY 1")
def risk_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value", (F.col("event_type") == "error").alias("outcome"))
    return detectors.risk_bins(rows, "value", "outcome").withColumn("risk", F.round("risk", 6))


@query("order_score", "SELECT event_id, round((row_number() OVER (ORDER BY value, event_id) - 1) / (count(*) OVER () - 1), 6) AS order_score FROM events")
def order_score(spark, sf_dir):
    return detectors.order_score(table(spark, sf_dir, "events"), "value", "event_id").select("event_id", F.round("order_score", 6).alias("order_score"))


# --- transfer: users of even ids are the source



def sided(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("side", F.col("user_id") % 2 == 0)


@query(
    "histogram_overlap",
    """WITH x AS (SELECT user_id % 2 = 0 AS s, value AS x FROM events WHERE isfinite(value)), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) FILTER (s) AS ns, count(*) FILTER (NOT s) AS nd FROM x),
    b AS (SELECT least(49, floor((x - lo) * 50 / (hi - lo))) AS bin, s, ns, nd FROM x, e), c AS (SELECT bin, count(*) FILTER (s) / any_value(ns) AS a, count(*) FILTER (NOT s) / any_value(nd) AS b FROM b GROUP BY bin) SELECT round(sum(least(a, b)), 6) AS overlap FROM c""",
)
def histogram_overlap(spark, sf_dir):
    return transfer.histogram_overlap(sided(spark, sf_dir), "value", "side").withColumn("overlap", F.round("overlap", 6))


LEVELS = str([k / 20 for k in range(1, 20)])
SHIFT = f"q AS (SELECT quantile_cont(value, {LEVELS}) FILTER (user_id % 2 = 0) AS a, quantile_cont(value, {LEVELS}) FILTER (user_id % 2 = 1) AS b FROM events), sh AS (SELECT list_sum(list_transform(range(1, 20), lambda k: abs(a[k] - b[k]))) / 19 AS shift, a[15] - a[5] AS spread FROM q)"


@query("quantile_shift", f"WITH {SHIFT} SELECT round(shift, 6) AS shift, round(shift / spread, 6) AS scaled_shift FROM sh")
def quantile_shift(spark, sf_dir):
    return transfer.quantile_shift(sided(spark, sf_dir), "value", "side").select(F.round("shift", 6).alias("shift"), F.round("scaled_shift", 6).alias("scaled_shift"))


@query("schema_compatibility", f"WITH {SHIFT} SELECT scaled_shift <= 3 AS compatible FROM (SELECT shift / spread AS scaled_shift FROM sh)")
def schema_compatibility(spark, sf_dir):
    return transfer.compatibility(sided(spark, sf_dir), "value", "side").select("compatible")
