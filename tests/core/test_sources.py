from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from crestline.functions import scalar
from crestline.operators import preparation
from crestline.sources import tables


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    tables.write_table(df, f"{tmp_path}/t.parquet")
    assert tables.read_table(spark, f"{tmp_path}/t.parquet", ["v"]).columns == ["v"]
    tables.write_report(df, f"{tmp_path}/t.csv")
    assert tables.read_table(spark, f"{tmp_path}/t.csv", schema=df.schema).count() == 2
    digests = tables.file_digests(spark, f"{tmp_path}/t.csv").where(F.col("path").endswith(".csv")).collect()
    assert all(len(r["sha256"]) == 64 for r in digests) and digests
    body = json.loads(tables.manifest(preparation.column_statistics(df, ["k", "v"]), "t"))
    assert body["columns"]["k"]["low"] == "1" and len(body["digest"]) == 16


def test_traces_and_archives(spark, tmp_path):
    (tmp_path / "TS1.txt").write_text("10 11\n12\t13\n")
    got = tables.read_traces(spark, f"{tmp_path}/TS1.txt").orderBy("line").collect()
    assert [list(r["trace"]) for r in got] == [[10.0, 11.0], [12.0, 13.0]]
    with zipfile.ZipFile(tmp_path / "rig.zip", "w") as z:
        z.writestr("deep/ps1.TXT", "1 2 3\n4 5 6\n")
        z.writestr("profile.txt", "100 100 0 130 1\n")
    got = tables.read_zipped(spark, str(tmp_path), "PS1.txt").orderBy("line").collect()
    assert [list(r["trace"]) for r in got] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]


def test_local_time(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("02/01/2024 03:04:05",), ("nonsense",), (None,)], "t string")
    got = [r["t"] and r["t"].isoformat() for r in tables.with_local_time(df, "t").collect()]
    assert got == ["2024-01-02T03:04:05", "2024-01-02T03:04:05", None, None]


def test_scalars(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.number(F.col("s"))).collect()] == [1.5, None, None, None]
    one = spark.range(1).select(scalar.half_even(F.lit(2.5)), scalar.clip(F.lit(9.0), 0, 5), scalar.ratio(F.lit(1.0), F.lit(0.0)), scalar.between_bins(F.lit(10.0), 0, 10, 5), scalar.close(F.lit(1.0), F.lit(1.0 + 1e-7))).first()
    assert tuple(one) == (2, 5.0, 0.0, 4, True)


def test_traces_of_a_file_in_splits(spark, tmp_path):
    """Numbers of lines are those of the file, whatever splits it is read in; blank lines count, no number is null."""
    rows = [f"{k} {k / 2}\t{-k}" if k % 7 else "  " for k in range(5_000)]
    (tmp_path / "a.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.txt").write_bytes(b"1 x\r\n\r\n 2 3 \r\n")
    (tmp_path / "c.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        df = tables.read_traces(spark, str(tmp_path))
        assert spark.read.text(f"{tmp_path}/a.txt").rdd.getNumPartitions() > 5
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): list(r["trace"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = {("a.txt", k): [k, k / 2, -k] for k in range(5_000) if k % 7}
    assert got == want | {("b.txt", 0): [1.0, None], ("b.txt", 2): [2.0, 3.0]}


def test_archives_in_batches(spark, tmp_path):
    """Archives in folders, members in several batches, blank lines, words, an archive without the member."""
    (tmp_path / "deep").mkdir()
    for place, n in (("a.zip", 120_000), ("deep/b.ZIP", 3)):
        with zipfile.ZipFile(tmp_path / place, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x/PS1.txt", "\n".join(f"{k} 1 x" if k % 5 else "" for k in range(n)))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("other.txt", "1\n")
    got = tables.read_zipped(spark, str(tmp_path), "ps1.TXT", "t").groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).agg(F.count("*").alias("n"), F.max("line").alias("last"), F.count_if(F.col("t")[0] == F.col("line")).alias("same"), F.count_if(F.col("t")[2].isNull()).alias("words")).collect()
    assert {tuple(r) for r in got} == {("a.zip", 96_000, 119_999, 96_000, 96_000), ("b.ZIP", 2, 2, 2, 2)}
    (tmp_path / "none").mkdir()
    assert tables.read_zipped(spark, f"{tmp_path}/none", "PS1.txt").count() == 0


def test_written_archives(spark, tmp_path):
    df = spark.range(0, 1_000, 1, 3).selectExpr("concat(id, ' ', id + 1) AS value")
    for _ in range(2):  # written again, they are there once
        tables.write_zipped(df, f"{tmp_path}/out", "t.txt")
    got = tables.read_zipped(spark, f"{tmp_path}/out", "t.txt")
    assert sorted(tuple(r["trace"]) for r in got.collect()) == [(k, k + 1) for k in range(1_000)]
    assert got.select("file").distinct().count() == 3
