"""SimHash near duplicates by segment popcounts.

A fingerprint is cut into 32 segments of two bits. The vector of the segments' bit counts is an
embedding whose Manhattan distance never exceeds the Hamming distance of the fingerprints. Pairs
within the radius are found by a grid range join on that embedding: its coordinates form groups,
and two vectors within a distance of 3 lie in the same unit cell of at least three of six groups.
The Manhattan distance over all coordinates is the lower bound that drops most candidates; the
Hamming distance of the fingerprints decides.

Texts that are null or have no word have fingerprint zero, linked like any other. Only different
fingerprints are joined, so equal texts, however many, cost one row. Rows that repeat a doc_id
each appear in the result, with what their own text gives; rows without one link others, and their
component_id is null only if no row of the component has a doc_id. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.components import connected
from crestline.llm.shared import short_batches, written

RADIUS = 3
GROUPS = 6
#: Low bit of every segment.
LOW = 0x5555555555555555
#: Shingles of one text that are counted at a time.
CHUNK = 200_000


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 if it has no word."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(n, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        a, b = starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist()
        h = np.fromiter([digest(plain[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64, len(a))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * total[k] > len(starts)))


def fingerprint(text: Column, df: DataFrame, n: int = 3, seed: int = 42) -> Column:
    """Fingerprints of whole texts as (signed) longs."""
    short_batches(df.sparkSession)

    @F.pandas_udf("long")
    def marks(part: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint_of(x, n, seed)) for x in part], dtype="int64")

    return marks(text)


def embedding(fp: Column) -> Column:
    """Bit counts of all two-bit segments, each in unary (00, 01, 11), so that the bit count of two embeddings' XOR is their Manhattan distance."""
    half = F.shiftrightunsigned(fp, 1)
    any_set = fp.bitwiseOR(half).bitwiseAND(F.lit(LOW))
    both_set = fp.bitwiseAND(half).bitwiseAND(F.lit(LOW))
    return any_set.bitwiseOR(F.shiftleft(both_set, 1))


def _masks() -> list[int]:
    cut = [round(k * 32 / GROUPS) for k in range(GROUPS + 1)]
    return [sum(3 << (2 * s) for s in range(cut[k], cut[k + 1])) for k in range(GROUPS)]


def near_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in column fp that differ in at most 3 bits, each once."""
    if not 0 <= radius <= GROUPS - 3:
        raise ValueError(f"radius must be from 0 to {GROUPS - 3}")
    masks, same = _masks(), GROUPS - radius
    cells = list(combinations(range(GROUPS), same))
    mask = {c: sum(masks[g] for g in c) for c in cells}
    # each pair counts in the first of the cells that it shares: groups before the cell's last one that aren't in it must differ
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), F.col("m").bitwiseAND(F.lit(signed(mask[c]))).alias("at")) for k, c in enumerate(cells)]))
    placed = fps.select("fp", embedding(F.col("fp")).alias("m")).select("fp", "m", grid.alias("g")).select("fp", "m", F.col("g.cell").alias("cell"), F.col("g.at").alias("at"))
    a, b = placed.alias("a"), placed.alias("b")
    apart = F.col("a.m").bitwiseXOR(F.col("b.m"))
    first = F.lit(False)
    for k, c in enumerate(cells):
        others = [apart.bitwiseAND(F.lit(signed(masks[g]))) != 0 for g in range(c[-1]) if g not in c]
        test = F.col("a.cell") == k
        for o in others:
            test = test & o
        first = first | test
    joined = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= radius) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius) & first)
    return joined.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, itself included), n_links (other fingerprints linked directly)."""
    marked = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text), docs).alias("fp")), "simhash")
    reps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    pairs = written(near_pairs(reps.select("fp"), radius), "simhash-pairs")
    ends = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    # components are those of fingerprints: rows without doc_id, or with a repeated one, neither break nor make a link
    of = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "fp")
    placed = written(reps.join(of, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "simhash-classes")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = placed.join(least, "component").join(ends, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "n_links")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
