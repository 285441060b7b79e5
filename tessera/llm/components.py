"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns a, b. Returns (node, label): each node
    that has an edge to another one, with the smallest node it can reach.

    Minima are aggregated map-side before each join and a hub's own edges are
    only ever joined (so adaptive skew splitting applies), never collected
    into one group. The edge table is rewritten to the shared folder each
    round, so lineage stays one round deep, and the round before is deleted.
    Each round lowers labels until none moves, so it always ends. Self-loops and nulls are ignored;
    an empty table gives an empty result."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, "cc")
    mark = _mark(e)
    while mark[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = staged(sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, last = mark, e
        e = staged(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "cc")
        released(last)
        released(large)
        mark = _mark(e)
        if before == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
