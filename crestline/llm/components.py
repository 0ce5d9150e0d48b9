"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: a node's larger (large) or smaller neighbours and itself are hung on the smallest of them."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.join(low, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each end of a link in (src, dst), the smallest node it can reach.

    Large-star and small-star steps alternate until every node hangs on its component's smallest
    one. Each round is written to the shared folder. Loops and repeated links don't matter; an
    empty link table gives an empty result.
    """
    edges = written(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")
