"""Shards by fixed virtual slots (DataFrame functions only).

A record's slot is a hash of its id; there are some thousands, and their number never changes.
Bytes and rows are added up by slot, and a versioned map says which shard holds each slot. The
first version deals the slots out evenly; rebalancing writes a further version in which slots are
moved until the shards' bytes are near equal, and growing one in which slots move to the new shard
only. Whole records, never parts of one, are in a shard.

A slot that holds over half a shard's share, and so repeats of one id, is mapped in pieces: its
rows are dealt over them by their place in the table. A null id counts as the empty string, a null
text has no bytes. Each row counts 1 byte besides its text. Rows that repeat an id are in one
shard unless their slot is split. An empty table gives an empty result; further columns are
passed on by sharded() only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.shared import free_names, written

SLOTS, PIECES = 4096, 64
#: A slot of fewer rows isn't split.
LEAST_SPLIT = 16
UNIT = "array<struct<bytes:bigint,slot:int,piece:int,shard:int>>"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % slots).cast("int")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, slot, place: one narrow row a record, written."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), size_of(F.col(text)).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), slot_of(F.col(id_col), slots).alias("slot"))
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "records")


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 (slot, piece, shard): runs of slots of equal number."""
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("piece"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"))


def pieces_of(records: DataFrame, shards: int) -> Column:
    """The piece of a record's slot: 0, but for the (at most 2 * shards) slots that are split."""
    by_slot = records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total = by_slot.agg(F.sum("bytes")).first()[0] or 0
    hot = [r["slot"] for r in by_slot.where((F.col("bytes") * (2 * shards) > total) & (F.col("rows") >= LEAST_SPLIT)).select("slot").collect()]
    return F.when(F.col("slot").isin(hot), F.pmod("place", F.lit(PIECES)).cast("int")).otherwise(0) if hot else F.lit(0)


def units(records: DataFrame, known: DataFrame) -> DataFrame:
    """(slot, piece, bytes, rows, shard): what a map places, with the shard that holds it; new pieces are where their slot is."""
    sums = records.groupBy("slot", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    at_slot = known.groupBy("slot").agg(F.min_by("shard", "piece").alias("of_slot"))
    return sums.join(known, ["slot", "piece"], "left").join(at_slot, "slot", "left").select("slot", "piece", "bytes", "rows", F.coalesce("shard", "of_slot").alias("shard"))


def _raised(loads: Column, shard: Column, bytes_: Column) -> Column:
    return F.transform(loads, lambda x, k: F.when(k == shard, x + bytes_).otherwise(x))


def edited(placed: DataFrame, shards: int, grown: bool = False) -> DataFrame:
    """(slot, piece, shard): units() with as few moved as the balance asks for.

    Largest first, a unit stays where it is if its shard does not exceed an equal share; the
    others go, largest first, to the least loaded shard (ties: the first). With grown, the last
    shard is new and takes all of those. The fold runs over slots and pieces, whose number is fixed.
    """
    state = f"struct<loads:array<bigint>,out:{UNIT},gone:{UNIT}>"
    none = F.array().cast(UNIT)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("bytes"), "slot", "piece", "shard")))
    one = placed.agg(F.sum("bytes").alias("total"), ordered.alias("all")).select("total", F.transform("all", lambda u: F.struct((-u["bytes"]).alias("bytes"), u["slot"].alias("slot"), u["piece"].alias("piece"), u["shard"].alias("shard"))).cast(UNIT).alias("all"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), none.alias("out"), none.alias("gone")).cast(state)

    def stay(acc: Column, u: Column) -> Column:
        fits = (F.get(acc["loads"], u["shard"]) + u["bytes"]) * shards <= F.col("total")
        return F.struct(
            F.when(fits, _raised(acc["loads"], u["shard"], u["bytes"])).otherwise(acc["loads"]).alias("loads"),
            F.when(fits, F.concat(acc["out"], F.array(u))).otherwise(acc["out"]).alias("out"),
            F.when(fits, acc["gone"]).otherwise(F.concat(acc["gone"], F.array(u))).alias("gone"),
        ).cast(state)

    moved = "struct<loads:array<bigint>,out:" + UNIT + ">"

    def move(acc: Column, u: Column) -> Column:
        to = F.lit(shards - 1) if grown else (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        at = F.struct(u["bytes"].alias("bytes"), u["slot"].alias("slot"), u["piece"].alias("piece"), to.alias("shard"))
        return F.struct(_raised(acc["loads"], to, u["bytes"]).alias("loads"), F.concat(acc["out"], F.array(at)).alias("out")).cast(moved)

    kept = one.select(F.aggregate("all", start, stay).alias("k"))
    rest = F.aggregate(F.col("k.gone"), F.struct("k.loads", "k.out").cast(moved), move)
    return kept.select(F.explode(rest["out"]).alias("u")).select("u.slot", "u.piece", "u.shard")


def publish(placed: DataFrame, path: str, version: int) -> DataFrame:
    """Writes a map as one version; a version is never changed."""
    placed.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return at_version(placed.sparkSession, path, version)


def at_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").select("slot", "piece", "shard")


def rebalance(records: DataFrame, path: str, version: int, shards: int, grown: bool = False) -> DataFrame:
    """Edits a version of the map for the records (with column piece) and publishes the next; slots without records stay."""
    known = at_version(records.sparkSession, path, version)
    new = edited(units(records, known), shards, grown)
    same = known.join(new.select("slot").distinct(), "slot", "left_anti")
    return publish(new.unionByName(same), path, version + 1)


def assigned(records: DataFrame, known: DataFrame) -> DataFrame:
    """records (with column piece) with shard and place_in_shard, gapless from 0 in each shard.

    Rows are numbered within their slot; the rows of the slots before, by shard, are added.
    """
    order = Window.partitionBy("shard").orderBy("slot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = units(records, known).withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0))).select("slot", "piece", "shard", "before")
    within = F.row_number().over(Window.partitionBy("slot", "piece").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size", "place"))
    return records.withColumn("_nth", within).join(F.broadcast(firsts), ["slot", "piece"]).withColumn("place_in_shard", (F.col("before") + F.col("_nth") - 1).cast("long")).drop("_nth", "before")


def balanced(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, place_in_shard: version 1 of a map below path deals the slots out, version 2 is balanced by bytes."""
    records = measured(docs, id_col, text, slots)
    publish(even_map(docs.sparkSession, shards, slots), path, 1)
    records = records.withColumn("piece", pieces_of(records, shards))
    return assigned(records, rebalance(records, path, 1, shards)).select("doc_id", "size", "text_crc32", "shard", "place_in_shard", F.col("slot").alias("virtual_slot"))


def sharded(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with column shard, by a map: what new records get. Those of a split slot are dealt over its pieces."""
    slot, pieces = free_names(docs, "_slot", "_pieces")
    held = known.groupBy("slot").agg(F.array_sort(F.collect_list("shard")).alias(pieces)).withColumnRenamed("slot", slot)
    out = docs.drop("shard").withColumn(slot, slot_of(F.col(id_col), slots)).join(F.broadcast(held), slot, "left")
    nth = F.pmod(F.monotonically_increasing_id(), F.size(pieces)).cast("int")
    return out.withColumn("shard", F.get(pieces, nth)).drop(slot, pieces)
