"""Streams over more files than a batch takes, in shuffled order, against the SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.plans import stream_queries
from crestline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """A folder whose events lie in 40 files that are in no order of time or id."""
    folder = tmp_path_factory.mktemp("shuffled")
    spark.read.parquet(f"{SF}/events.parquet").repartition(40).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(stream_queries, "BATCH_ROWS", 150, raising=False)


@pytest.mark.parametrize("name", ["stream_exceedance_sessions", "stream_counter_increments", "stream_time_quality", "stream_lag_features"])
def test_any_order_of_files(spark, shuffled, small_batches, name):
    from tests.core.test_queries import plain

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    df = QUERIES[name](spark, shuffled)
    out = con.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    want = sorted((tuple(map(plain, r)) for r in out.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_adaptive_thresholds_equal_the_batch_form(spark, shuffled, small_batches):
    """Several batches, any order of files: the stream's thresholds are those of the whole series, and they move."""
    key = lambda r: (r["user_id"], int(r["i"]))
    want = {key(r): r for r in QUERIES["spot_thresholds"](spark, shuffled).collect()}
    got = {key(r): r for r in QUERIES["stream_adaptive_thresholds"](spark, shuffled).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["threshold"] == pytest.approx(r["threshold"], rel=1e-9) and got[k]["exceeds"] == r["exceeds"]
    by_user = {}
    for (user, _), r in got.items():
        by_user.setdefault(user, set()).add(r["threshold"])
    assert max(map(len, by_user.values())) > 2


def test_a_repeated_batch_leaves_its_rows_once(spark, tmp_path):
    rows = spark.range(10)
    rows.write.parquet(f"{tmp_path}/in")
    out = lambda k: stream_queries.drained(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "again", "append", f"{tmp_path}/state-{k}", f"{tmp_path}/out")
    assert out(1).count() == 10 and out(2).count() == 10  # another checkpoint: batch 0 comes again


@pytest.mark.parametrize("name", ["stream_counter_increments", "stream_time_quality", "stream_lag_features"])
def test_keys_share_calls(spark, shuffled, small_batches, monkeypatch, name):
    """Many keys in few groups, carried from batch to batch, missing keys and values too: as in groups of one key each."""
    from crestline.streaming import operators

    rows = stream_queries.event_rows(spark, shuffled).withColumns({"user_id": F.when(F.col("event_id") % 7 > 0, F.col("user_id")), "value": F.when(F.col("event_id") % 5 > 0, F.col("value"))})
    rows = rows.withColumn("ts", F.when(F.col("event_id") % 11 > 0, F.col("ts")))
    monkeypatch.setattr(stream_queries, "event_rows", lambda *_: rows)
    run = lambda: sorted(map(str, QUERIES[name](spark, shuffled).collect()))
    monkeypatch.setattr(operators, "BUCKETS", 100_000)
    apart = run()
    monkeypatch.setattr(operators, "BUCKETS", 3)
    assert run() == apart
    w = Window.partitionBy("user_id").orderBy("event_id")
    if name == "stream_counter_increments":
        change = F.col("value") - F.lag("value").over(w)
        want = rows.select("user_id", F.col("event_id").cast("double").alias("event_id"), F.round(F.when(change >= 0, change), 6).alias("increment"), F.coalesce(change < 0, F.lit(False)).alias("reset"))
        assert sorted(map(str, want.collect())) == apart
