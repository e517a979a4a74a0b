"""Alignment of yearly vector spaces: anchors, orthogonal rotations, chains, displacement, overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.stats import quantiles, row_numbers
from foliolens.functions.vectors import dot

STAYER = 0.85


def is_stayer(overlap, at: float = STAYER):
    """One rule for all uses: overlap of at least 0.85, or of another threshold."""
    return overlap >= at


def holdings_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str = "issuer_id", weight: str = "pw") -> DataFrame:
    """Sum of the smaller weights of shared items, for keys present on both sides; repeated items are summed first."""
    x = a.groupBy(*keys, item).agg(F.sum(weight).alias("w0"))
    y = b.groupBy(*keys, item).agg(F.sum(weight).alias("w1"))
    both = x.select(*keys).distinct().join(y.select(*keys).distinct(), keys)
    shared = x.join(y, [*keys, item]).groupBy(*keys).agg(F.sum(F.least("w0", "w1")).alias("s"))
    return both.join(shared, keys, "left").select(*keys, F.coalesce("s", F.lit(0.0)).alias("wt_overlap"))


def overlap_with_next(rows: DataFrame, key: str, item: str, year: str, weight: str) -> DataFrame:
    """key, year, wt_overlap: `holdings_overlap` of each key's items in a year and the next one, for keys present in both. Rows are dealt by
    key once; a row finds the same item's next year beside it, so that nothing is shuffled for the second side."""
    w = rows.select(key, item, year, weight).dropna(subset=[key, year]).repartition(key).groupBy(key, item, year).agg(F.sum(weight).alias("w"))
    later = F.lead(F.struct(F.col(year).alias("y"), "w")).over(Window.partitionBy(key, item).orderBy(year))
    w = w.withColumn("__next", later)
    shared = F.when(F.col(item).isNotNull() & (F.col("__next.y") == F.col(year) + 1), F.least("w", "__next.w"))
    books = w.groupBy(key, year).agg(F.coalesce(F.sum(shared), F.lit(0.0)).alias("wt_overlap"))
    books = books.withColumn("__next", F.lead(year).over(Window.partitionBy(key).orderBy(year)))
    return books.where(F.col("__next") == F.col(year) + 1).select(key, year, "wt_overlap")


def anchors(overlap: DataFrame, rule: str, year: str, key: str, stratum: str | None = None, least: int = 200, at: float = STAYER) -> DataFrame:
    """Anchor rows of each year: `all`, `stable_thr` (or the least most stable ones where too few pass), `stable_strat` (top quarter of each stratum, ties kept)."""
    if rule == "all":
        return overlap
    if rule == "stable_thr":
        few = overlap.groupBy(year).agg(F.sum(is_stayer(F.col("wt_overlap"), at).cast("int")).alias("__ok")).where(F.col("__ok") < least).select(year)
        enough = overlap.join(F.broadcast(few), year, "left_anti").where(is_stayer(F.col("wt_overlap"), at))
        # each task keeps its own best `least` rows of a year before they meet
        nth = F.row_number().over(Window.partitionBy(year).orderBy(F.col("wt_overlap").desc(), key))
        fallback = overlap.join(F.broadcast(few), year, "left_semi").withColumn("__nth", nth).where(F.col("__nth") <= least).drop("__nth")
        return enough.unionByName(fallback)
    q = quantiles(overlap, "wt_overlap", [0.75], [year, stratum], "__q")
    return overlap.join(q, [year, stratum]).where(F.col("wt_overlap") >= F.get("__q", F.lit(0))).drop("__q")


def gram(pairs: DataFrame, a: str, b: str, by: list[str]) -> dict[tuple, np.ndarray]:
    """Sum of outer products a b' for each group: d x d numbers a group and task, added up in a shuffle of few rows."""
    if not by:
        pairs, by = pairs.withColumn("__all", F.lit(0)), ["__all"]
    kinds = dict(pairs.dtypes)

    def sums(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, dropna=False):
                m = np.stack(g[a].to_numpy()).T @ np.stack(g[b].to_numpy())
                total[key] = total.get(key, 0) + m
        rows = [(*k, m.shape[0], i, m[i]) for k, m in total.items() for i in range(m.shape[0])]
        yield pd.DataFrame(rows, columns=[*by, "d", "i", "row"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", d int, i int, row array<double>"
    parts = pairs.select(*by, a, b).mapInPandas(sums, schema)
    d = len(pairs.select(a).first()[0])
    rows = parts.groupBy(*by, "i").agg(F.array(*[F.sum(F.get("row", j)) for j in range(d)]).alias("row")).collect()
    out: dict[tuple, np.ndarray] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in by), np.zeros((d, d)))[r["i"]] = r["row"]
    return out


def procrustes(m: np.ndarray) -> np.ndarray:
    """The orthogonal R that turns a onto b best, from the sum of a b' (reflections allowed)."""
    u, _, vt = np.linalg.svd(m)
    r = u @ vt
    if np.abs(r.T @ r - np.eye(len(r))).max() > 1e-8:
        raise ArithmeticError("the rotation is not orthogonal")
    return r


def shuffled_pairs(pairs: DataFrame, by: str, key: str, times: int) -> DataFrame:
    """by, seed, a, b: pairs (by, key, a, b) with each group's b dealt anew at random, `times` times: the null of no correspondence."""
    a = row_numbers(pairs.select(by, key, "a"), [by], [key], "n")
    b = pairs.select(F.col(by).alias("other"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("seed"))
    b = row_numbers(b.withColumn("h", F.xxhash64("k", "seed")), ["other", "seed"], ["h", "k"], "m").select("other", "k", "seed", "m")
    b = b.join(pairs.select(F.col(by).alias("__g"), F.col(key).alias("__id"), "b"), (F.col("other") == F.col("__g")) & (F.col("k") == F.col("__id"))).select("other", "seed", "m", "b")
    return a.join(b, (F.col(by) == F.col("other")) & (F.col("n") == F.col("m"))).select(by, "seed", "a", "b")


def noise_floor(a: DataFrame, b: DataFrame, key: str) -> tuple[np.ndarray, DataFrame]:
    """Two embeddings (key, vector) of the same holdings by models of different seeds: the rotation of b onto a, for
    which every shared key is an anchor, and key, displacement that is left."""
    both = a.select(key, F.col("embedding").alias("y")).join(b.select(key, F.col("embedding").alias("x")), key).withColumn("all", F.lit(0))
    r = procrustes(next(iter(gram(both, "x", "y", []).values())))
    moved = rotated(both, "x", {0: r}, "all", "turned")
    return r, moved.select(key, (1 - dot(F.col("turned"), F.col("y"))).alias("displacement"))


def chain(rotations: dict[int, np.ndarray], reference: int, years: list[int]) -> dict[int, np.ndarray]:
    """For each year the matrix into the reference year's space; rotations[y] takes year y to y + 1."""
    d = next(iter(rotations.values())).shape[0]
    out = {reference: np.eye(d)}
    for y in sorted((y for y in years if y < reference), reverse=True):
        out[y] = rotations[y] @ out[y + 1]
    for y in sorted(y for y in years if y > reference):
        out[y] = rotations[y - 1].T @ out[y - 1]
    return out


def effective_rank(m: np.ndarray) -> float:
    """Participation ratio of the squared singular values, from a Gram matrix: tr(G)^2 / |G|^2."""
    return float(np.trace(m) ** 2 / (m**2).sum())


def rotated(df: DataFrame, vec: str, rotations: dict, by: str, out: str) -> DataFrame:
    """df with x R of its group's rotation; rotations: a few d x d matrices."""
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {out} array<double>"

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy())
                y = np.empty_like(x)
                for g in pdf[by].unique():
                    rows = (pdf[by] == g).to_numpy()
                    y[rows] = x[rows] @ rotations[g] if g in rotations else np.nan
                yield pdf.assign(**{out: list(y)})

    return df.mapInPandas(run, schema)


def displacement(df: DataFrame, moved: str, target: str):
    return 1 - dot(df[moved], df[target])
