"""Cluster profiles: lift, largest category, distinctive holdings, concentration, association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lift_table(df: DataFrame, cluster: str, category: str, weight: Column, min_n: int = 20, top: int = 3) -> DataFrame:
    """Share of a category in a cluster over its share in all, rounded, at least min_n rows, the top ones of each cluster."""
    cells = df.where(F.col(category).isNotNull()).groupBy(cluster, F.col(category).alias("category")).agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n"))
    by_cluster = cells.groupBy(cluster).agg(F.sum("s").alias("cluster_sum"))
    by_category = cells.groupBy("category").agg(F.sum("s").alias("category_sum"))
    whole = cells.agg(F.sum("s").alias("whole"))
    rows = cells.where(F.col("n") >= min_n).join(by_cluster, cluster).join(by_category, "category").join(F.broadcast(whole), F.lit(True))
    share = F.col("s") / F.col("cluster_sum")
    rows = rows.withColumn("share_pct", F.round(100 * share, 4)).withColumn("lift", F.round(share / (F.col("category_sum") / F.col("whole")), 4))
    nth = F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("lift").desc(), "category"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= top).select(cluster, "category", "n", "share_pct", "lift", "nth")


def largest_category(df: DataFrame, cluster: str, category: str, weight: Column) -> DataFrame:
    """The category with the largest weight in each cluster, and its share."""
    cells = df.groupBy(cluster, F.col(category).alias("category")).agg(F.sum(weight).alias("s"))
    w = Window.partitionBy(cluster)
    rows = cells.withColumn("pct", F.round(100 * F.col("s") / F.sum("s").over(w), 4)).withColumn("nth", F.row_number().over(w.orderBy(F.col("s").desc(), "category")))
    return rows.where("nth = 1").select(cluster, "category", "pct")


def concentration(df: DataFrame, cluster: str, owner: str, k: int = 3) -> DataFrame:
    """Share of the k owners with the most members in each cluster."""
    cells = df.groupBy(cluster, owner).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cluster)
    rows = cells.withColumn("nth", F.row_number().over(w.orderBy(F.col("n").desc(), owner)))
    return rows.groupBy(cluster).agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("owners"), F.round(100.0 * F.sum(F.when(F.col("nth") <= k, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("top_share_pct"))


def distinctive(positions: DataFrame, cluster: str, investor: str, issuer: str, least: float = 0.10, top: int = 8) -> DataFrame:
    """Issuers held by a larger share of a cluster's members than of all: the top ones by rounded lift. Counted, never weighted."""
    held = positions.select(cluster, investor, issuer).distinct()
    members = held.select(cluster, investor).distinct().groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    everyone = members.agg(F.sum("members").alias("everyone"))
    in_cluster = held.groupBy(cluster, issuer).agg(F.count(F.lit(1)).alias("k"))
    overall = in_cluster.groupBy(issuer).agg(F.sum("k").alias("k_all"))
    rows = in_cluster.join(F.broadcast(members), cluster).join(overall, issuer).join(F.broadcast(everyone), F.lit(True))
    p, q = F.col("k") / F.col("members"), F.col("k_all") / F.col("everyone")
    rows = rows.select(cluster, issuer, F.round(p, 4).alias("p_cluster"), F.round(q, 4).alias("p_all"), F.round(p / q, 1).alias("lift"), p.alias("p")).where(F.col("p") >= least)
    nth = F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("lift").desc(), F.col("p_cluster").desc(), issuer))
    return rows.withColumn("nth", nth).where(F.col("nth") <= top).drop("p")


def largest_share(df: DataFrame, key: str, group: str, weight: Column) -> DataFrame:
    """The largest group's share of each key's weight."""
    by = df.groupBy(key, group).agg(F.sum(weight).alias("s"))
    return by.groupBy(key).agg((F.max("s") / F.sum("s")).alias("largest_share"))
