"""What the operators of this subpackage share: the shared folder, written tables and small helpers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; whole texts may be long, so batches are kept short.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. In local mode, where one machine does all, the warehouse stands in."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/crestline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(path: str):
    """(file system, path in it), for what tasks write or read without Spark's own sources."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def new_folder(path: str) -> None:
    """Makes a folder for a job's files; one that holds files already is refused."""
    from pyarrow import fs

    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    if store.get_file_info(fs.FileSelector(folder)):
        raise FileExistsError(path)


@contextmanager
def whole_file(path: str):
    """A stream to a file that gets its name when it is whole.

    A task that is repeated after a loss, or runs twice, leaves one file: what is there under the
    name already is an earlier attempt's and holds the same records.
    """
    from pyarrow import fs

    store, final = open_store(path)
    folder, _, name = final.rpartition("/")
    temporary = f"{folder}/_{name}-{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    try:
        with store.open_output_stream(temporary, compression=None) as out:
            yield out
        if store.get_file_info(final).type == fs.FileType.NotFound:
            store.move(temporary, final)
    finally:
        if store.get_file_info(temporary).type != fs.FileType.NotFound:
            store.delete_file(temporary)


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drawn(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """About ``most`` rows, the same ones whenever asked, with the number that drew them in ``_draw``.

    The draw is a hash of the columns, which name a row and not only its content, so that of
    copies a part is drawn. What is made of the rows goes through at_most() before it is collected.
    """
    n = rows.count()
    marked = rows.withColumn("_draw", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return marked.where(F.shiftrightunsigned("_draw", 33) / F.lit(float(1 << 31)) < 1.1 * most / n) if n > most else marked


def at_most(rows: DataFrame, most: int) -> DataFrame:
    """The first rows by draw: a hard bound, also where rows repeat in all that drew them."""
    return rows.orderBy("_draw").limit(most).drop("_draw")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no column of that name."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def id_remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text (null: empty), mod 5; 0 marks the held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
