"""Tables by suffix, traces of white-space separated numbers, telemetry with source-local time, zipped members, and atomic sinks."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crestline.operators.series import carried
from crestline.sources.zipped import ZippedTraces, opened


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """csv, parquet or pq by suffix; a schema spares csv its inference pass. Columns are pruned at the scan."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        reader = spark.read.option("header", "true")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    elif suffix in (".parquet", ".pq"):
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    else:
        raise ValueError(f"neither csv nor parquet: {path}")
    return df.select(*columns) if columns else df


def read_traces(spark: SparkSession, path: str, name: str = "trace") -> DataFrame:
    """Lines of white-space separated numbers as (file, line, array<double>); files below the path, each numbered on its own.

    Large files are read in splits, as many tasks as they have. A line's number in its split is
    shifted by the lines of the file's splits before, of which one row each is known. Blank lines
    count but aren't rows; what is no number is null.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")) - 1
    placed = carried(lines.withColumn("_inside", inside), ["file"], "_block", "_before", F.count("*"), F.sum)
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    numbers = F.transform(words, lambda x: x.try_cast("double"))
    return placed.where(F.size(words) > 0).select("file", (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long").alias("line"), numbers.alias(name))


def read_zipped(spark: SparkSession, path: str, member: str, name: str = "trace") -> DataFrame:
    """The member of each archive below the path (base name, upper and lower case alike) as (file, line, array<double>).

    Archives are dealt out to tasks by size, and a task decodes a member as it reads it: neither the
    archive nor the member is ever whole in memory.
    """
    spark.dataSource.register(ZippedTraces)
    return spark.read.format(ZippedTraces.name()).option("path", path).option("member", member).load().withColumnRenamed("trace", name)


def with_local_time(df: DataFrame, column: str, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "M/d/yyyy H:mm")) -> DataFrame:
    """df with the column as a timestamp without zone, by the first format that fits; null if none does."""
    return df.withColumn(column, F.coalesce(*[F.expr(f"try_to_timestamp({column}, \"{f}\")").cast("timestamp_ntz") for f in formats]))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet with zstd; the job's commit makes it whole or not there."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_zipped(df: DataFrame, path: str, member: str, line: str = "value") -> None:
    """One archive a partition, each with a member of the partition's lines, in their order. Archives get their name when they are whole, so a repeated task leaves one."""

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        place, folder = opened(path)
        place.create_dir(folder)
        made, final = f"{folder}/.part-{task.taskAttemptId()}.tmp", f"{folder}/part-{task.partitionId():05d}.zip"
        with place.open_output_stream(made) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as lines:
            for batch in parts:
                lines.write("".join(f"{'' if x is None else x}\n" for x in batch.column(0).to_pylist()).encode())
        place.move(made, final)
        yield pa.RecordBatch.from_pydict({"file": [final]})

    df.select(line).mapInArrow(packed, "file string").write.format("noop").mode("overwrite").save()


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one csv file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5, sha256) of the files below a path, hashed in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def manifest(statistics: DataFrame, name: str, **more) -> str:
    """JSON of a table's column statistics, with a short digest of its content."""
    columns = {r["column"]: {k: r[k] for k in r.asDict() if k != "column"} for r in statistics.collect()}
    body = {"dataset": name, "columns": columns} | more
    return json.dumps(body | {"digest": stable_hash(body)}, sort_keys=True, default=str)


def stable_hash(body: dict) -> str:
    """First 16 hex digits of the SHA-256 of sorted JSON."""
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()[:16]
