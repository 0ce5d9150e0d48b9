"""Resampling towards a target distribution: array-scored weights, ranks by parallel sorting by regular sampling.

Features are runs of words, hashed into a fixed number of buckets. A bucket's gain is the log
ratio of its smoothed share in the target and in the raw documents; the gains are one array of
fixed size, and a document's weight is the mean of them over its features. With Gumbel noise from
a hash of the id, the highest scores are a draw without replacement by weight.

Ranks come from a parallel sort. Every partition is sorted and written as a run. Rows at regular
places of the runs, in order, give the splitters; the segments between two splitters are exchanged
and merged, and the counts of the segments before give each its first rank. Segments beyond the
draw are counted and not exchanged. Rows that are equal in all else are told apart by their place,
so a score or an id that a third of all rows share is split like any other.

A text that is null or has no word has no features and weight 0. Ties go to the smaller id, rows
without id come last, rows that repeat an id have each a rank of their own. An empty target gives
the gains of its smoothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.shared import short_batches, written

BUCKETS = 10_000
#: ASCII letters in lower case and digits stay, all other ASCII parts words; bytes of other characters belong to words.
LETTERS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()
#: Bytes of a text that are taken apart at a time.
CHUNK = 1 << 20
#: Features whose bucket a worker keeps.
KEPT = 200_000
#: Rows of a segment, at least, where there are enough for every task, and samples for each.
SEGMENT_ROWS, SAMPLES = 1_000_000, 32
#: monotonically_increasing_id() is the partition's number and, in the lower 33 bits, the place in it.
IN_RUN = (1 << 33) - 1


def in_order() -> list[Column]:
    """How runs are sorted and rows ranked."""
    return [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]


class Buckets(dict):
    """feature -> bucket, worked out when first met."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[feature] = crc32(feature) % self.n
        return found


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists; none of them spans the end of a list."""
    plain = text.translate(LETTERS) if text else b""
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= CHUNK else plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        if words := plain[at:end].split():
            yield words
        at = end + 1


def buckets_of(text: bytes | None, known: Buckets, longest: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them), for the lists of words_of()."""
    before: list[bytes] = []
    for words in words_of(text):
        found = list(map(known.__getitem__, words))
        joined = before + words
        for n in range(2, longest + 1):
            first = max(0, len(before) - n + 1)
            found += [known[b" ".join(joined[k : k + n])] for k in range(first, len(joined) - n + 1)]
        before = joined[len(joined) - longest + 1 :] if longest > 1 else []
        yield len(words), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket; a partition sends one row a bucket at most."""
    short_batches(texts.sparkSession)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for part in parts:
            for x in part["t"]:
                for _, found in buckets_of(x, known, longest):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return texts.select(F.col(text).cast("binary").alias("t")).mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket in thousandths, from two tables of bucket_counts(); one number a bucket, whatever the input's size."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, raw), (t, target)):
        for b, n in df.collect():
            counts[b] = n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t, strict=True)], np.int64)


def weighed(text: Column, gain: np.ndarray, df: DataFrame, longest: int = 1) -> Column:
    """struct(n_words, n_features, weight) of whole texts; weight is the floored mean of the features' gains."""
    short_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        array = shared.value
        known = Buckets(len(array))
        for part in parts:
            out = []
            for x in part:
                n_words = n = total = 0
                for k, found in buckets_of(x, known, longest):
                    n_words, n, total = n_words + k, n + len(found), total + int(array[found].sum())
                out.append((n_words, n, total // n if n else 0))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"], dtype="int64")

    return of(text.cast("binary"))


def gumbel(key: Column, seed: int) -> Column:
    """Noise in thousandths from a hash of the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, least_words: int = 20, seed: int = 2024, longest: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, eligible (enough words), place; each partition is a sorted run, eligible rows first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), weighed(F.col(text), gain, docs, longest).alias("w"))
    rows = rows.select("doc_id", "w.n_features", "w.weight", (F.col("w.weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("w.n_words") >= least_words).alias("eligible"))
    return written(rows.sortWithinPartitions(*in_order()[:3]).withColumn("place", F.monotonically_increasing_id()), "runs")


def splitters(runs: DataFrame, n: int, segments: int) -> pd.DataFrame:
    """The borders of the segments: rows at regular places of the sorted runs, in order, taken at regular places again.

    Some SAMPLES a segment and one a run are brought to the driver, as four numbers each.
    """
    stride = max(1, n // (segments * SAMPLES))
    regular = runs.where(F.col("eligible") & (F.col("place").bitwiseAND(F.lit(IN_RUN)) % stride == stride // 2))
    sample = pd.DataFrame([tuple(r) for r in regular.orderBy(*in_order()).select("score", "doc_id", "place").collect()], columns=["score", "doc_id", "place"], dtype=object)
    step = max(1, -(-len(sample) // segments))
    return sample.iloc[step::step] if len(sample) else sample


def segment(rows: DataFrame, borders: pd.DataFrame) -> DataFrame:
    """rows with column segment: the number of borders that come before the row, or are it."""
    none = borders["doc_id"].isna().to_numpy(bool)
    cuts = [borders["place"].to_numpy(np.int64), borders["doc_id"].where(~borders["doc_id"].isna(), 0).to_numpy(np.int64), none, -borders["score"].to_numpy(np.int64)]
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def of(score: pd.Series, doc_id: pd.Series, none: pd.Series, place: pd.Series) -> pd.Series:
        cuts = shared.value
        keys = [np.concatenate([c, x.to_numpy()]) for c, x in zip(cuts, (place, doc_id, none, -score), strict=True)]
        order = np.lexsort(keys)  # stable: a border comes before the row that it is
        before = np.cumsum(order < len(cuts[0]))
        out = np.empty(len(order), np.int64)
        out[order] = before
        return pd.Series(out[len(cuts[0]) :])

    return rows.withColumn("segment", of("score", F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "place"))


def ranked(runs: DataFrame, share: tuple[int, int] = (10, 100), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """runs with rank: 1, 2, 3... for the share's part of the eligible rows with the highest scores, null for all others."""
    spark = runs.sparkSession
    n = runs.where("eligible").count()
    drawn = share[0] * n // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return runs.select(*columns, F.lit(None).cast("long").alias("rank"))
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // segment_rows))
    borders = splitters(runs, n, segments)
    sizes = dict(segment(runs.where("eligible"), borders).groupBy("segment").agg(F.count("*")).collect())
    firsts, before = [], 0
    for k in range(len(borders) + 1):
        if before < drawn and sizes.get(k):
            firsts.append((k, before))
        before += sizes.get(k, 0)
    last = firsts[-1][0]
    # rows of the segments that the draw reaches; those that are surely beyond it aren't even read
    near = runs.where("eligible") if last >= len(borders) else runs.where(F.col("eligible") & (F.col("score") >= int(borders["score"].iloc[last])))
    sent = segment(near, borders).join(F.broadcast(spark.createDataFrame(firsts, "segment long, before long")), "segment")
    merged = sent.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("segment").orderBy(*in_order())))
    top = written(merged.where(F.col("rank") <= drawn).select(*columns, "place", F.col("rank").cast("long").alias("rank")), "drawn")
    end = top.where(F.col("rank") == drawn).first()
    tied = F.col("doc_id").isNull() & (F.col("place") > end["place"])
    if end["doc_id"] is not None:
        tied = F.col("doc_id").isNull() | (F.col("doc_id") > end["doc_id"]) | ((F.col("doc_id") == end["doc_id"]) & (F.col("place") > end["place"]))
    rest = runs.where(~F.col("eligible") | (F.col("score") < end["score"]) | ((F.col("score") == end["score"]) & tied))
    return top.select(*columns, "rank").unionAll(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, longest: int = 1, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), buckets)
    return ranked(scored(docs, gain, least_words, seed, longest, id_col, text), share)
