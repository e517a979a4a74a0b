"""Connected components of a large graph of few-byte nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the undirected edges (u, v); root is the smallest node it can reach.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours, and
    is written to the shared folder; about log^2 of the longest path rounds are needed. Minima are
    pre-aggregated and joined back, so a node with very many neighbours is split like any skewed join.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("low", "u").alias("low"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), "low")
        hung = large.join(low, F.col("u") == F.col("w"))
        small = hung.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(small.where("u <> v").distinct(), "edges")
        if mark == (now := _mark(edges)):
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
