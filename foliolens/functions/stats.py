"""Statistics composed of built-in aggregates."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, by: list[str], prefix: str) -> Column:
    """Equality of group columns with those of a table that has them under a prefix; nulls are a group."""
    out = F.lit(True)
    for c in by:
        out = out & left[c].eqNullSafe(F.col(prefix + c))
    return out


def numbered(df: DataFrame, by: list[str], order: list, out: str, weight: Column | None = None) -> DataFrame:
    """df with the sum of the weights before each row in its group: without weights, row numbers from 0 on.

    No group is a task of its own: rows are laid out in ranges of group and order, stored, counted range by range, and
    numbered inside the ranges. The ties of `order` must be few, as equal rows stay together.
    """
    from foliolens.sources.durable import stored

    weight = F.lit(1) if weight is None else weight
    rows = stored(df.withColumn("__w", weight).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(*by, "__part").agg(F.sum("__w").alias("__s"))  # a row for each range and group in it
    before = F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__w").over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__inside", inside)
    rows = rows.join(starts, _same(rows, by, "__g_") & (F.col("__part") == F.col("__p")))
    return rows.withColumn(out, F.col("__before") + F.col("__inside")).drop("__w", "__part", "__p", "__before", "__inside", *[f"__g_{c}" for c in by])


def row_numbers(df: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """df with row numbers from 1 on within each group."""
    return numbered(df, by, order, out).withColumn(out, F.col(out) + 1)


def counted_values(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, x, __times, __smaller: each distinct value of a group, how often it occurs, and how many rows are smaller. NaN and null are left out."""
    ok = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    return numbered(ok.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__times")), by, [x], "__smaller", F.col("__times"))


def average_ranks(df: DataFrame, x: str, out: str, by: list[str] = ()) -> DataFrame:
    """df with the rank of x within its group, equal values sharing the mean of their ranks; rows without x are left out."""
    by = list(by)
    ranks = counted_values(df, by, x)
    ranks = ranks.select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col(x).alias("__x"), (F.col("__smaller") + (F.col("__times") + 1) / 2.0).alias(out))
    return df.join(ranks, _same(df, by, "__r_") & (df[x] == F.col("__x"))).drop("__x", *[f"__r_{c}" for c in by])


def quantiles(df: DataFrame, x: str, probs: list[float], by: list[str] = (), out: str = "q") -> DataFrame:
    """by and an array with x's quantiles (linear interpolation between order statistics) of each group.

    From counts of distinct values, so that no task holds a group's values; two of them are picked for each quantile.
    """
    by = list(by)
    values = counted_values(df, by, x)
    size = values.groupBy(*by).agg(F.sum("__times").alias("__n")).select(*[F.col(c).alias(f"__q_{c}") for c in by], "__n")
    values = values.join(F.broadcast(size) if not by else size, _same(values, by, "__q_"))
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p, i: F.struct(i.alias("i"), F.floor((F.col("__n") - 1) * p).alias("lo"), F.ceil((F.col("__n") - 1) * p).alias("hi"), ((F.col("__n") - 1) * p - F.floor((F.col("__n") - 1) * p)).alias("part")))
    here = lambda k: (k >= F.col("__smaller")) & (k < F.col("__smaller") + F.col("__times"))
    hits = values.withColumn("__h", F.explode(F.filter(at, lambda h: here(h["lo"]) | here(h["hi"]))))
    low, high = (F.max(F.when(here(F.col(f"__h.{c}")), F.col(x))) for c in ("lo", "hi"))
    picked = hits.groupBy(*by, "__h.i").agg(low.alias("lo"), high.alias("hi"), F.max("__h.part").alias("part"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    grouped = picked.groupBy(*(by or [F.lit(0).alias("__one")]))  # no rows of an empty table, grouped or not
    return grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias(out)).select(*by, out)


def clipped_logit(p: Column, least: float = 1e-4) -> Column:
    """The log-odds of a probability kept away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.log(q / (1 - q))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of ties to the even digit, as R does; F.round takes them away from zero."""
    return F.bround(x, digits)


def weighted_median(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """The smallest x at which the weights reach half; null x and weights of zero or less are left out."""
    ok = df.where(F.col(x).isNotNull() & (F.col(w) > 0)).groupBy(*keys, x).agg(F.sum(w).alias("__w"))
    part = Window.partitionBy(*keys)
    share = F.sum("__w").over(part.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__w").over(part)
    return ok.withColumn("__s", share).where("__s >= 0.5 - 1e-12").groupBy(*keys).agg(F.min(x).alias("weighted_median"))


def cramers_v(df: DataFrame, x: str, y: str, least: int = 50) -> DataFrame:
    """Bias-corrected Cramér's V as one row (n, cramers_v); null below the least size or with a single level."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("r")), cells.groupBy("y").agg(F.sum("n").alias("c"))
    sums = cells.join(rows, "x").join(cols, "y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    corrected = F.greatest(F.lit(0.0), F.col("s") - 1 - F.try_divide((r - 1) * (c - 1), n - 1))
    rc, cc = r - F.try_divide((r - 1) * (r - 1), n - 1), c - F.try_divide((c - 1) * (c - 1), n - 1)
    denom = F.least(rc, cc) - 1
    return sums.select(n.alias("n"), F.when((n >= least) & (F.least(r, c) >= 2) & (denom > 0), F.sqrt(F.try_divide(corrected, denom))).alias("cramers_v"))


def rank_eps_sq(df: DataFrame, x: str, group: str, least: int = 50) -> DataFrame:
    """Share of the variance of ranks of x that lies between groups, as one row (n, eps_sq)."""
    ok = average_ranks(df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).select(F.col(x).alias("x"), F.col(group).alias("g")), "x", "rank")
    by = ok.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("rank").alias("s"), F.sum(F.col("rank") * F.col("rank")).alias("q"))
    a = by.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - mean
    return a.select(F.col("n"), F.when((F.col("n") >= least) & (F.col("groups") >= 2) & (total > 0), F.try_divide(F.col("b") - mean, total)).alias("eps_sq"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index of two labellings, for each group of by: (n, ari)."""
    by = by or []
    two = lambda n: n * (n - 1) / 2
    cells = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("ra"))
    cols = cells.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("rb"))
    both = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("rc"))
    out = both.join(rows, by).join(cols, by) if by else both.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.try_divide(F.col("ra") * F.col("rb"), two(F.col("n")))
    most = (F.col("ra") + F.col("rb")) / 2
    return out.select(*by, "n", F.coalesce(F.try_divide(F.col("rc") - expected, most - expected), F.lit(1.0)).alias("ari"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(k, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return centre - half, centre + half


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman's rho for each group with a Fisher interval: n, rho, low, high; null below ten pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    ranked = average_ranks(average_ranks(ok.select(*by, x, y), x, "__rx", by), y, "__ry", by)
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("__rx", "__ry").alias("__c"), (F.stddev_pop("__rx") * F.stddev_pop("__ry")).alias("__s"))
    out = out.withColumn("rho", F.when(F.col("n") >= 10, F.try_divide(F.col("__c"), F.col("__s"))))
    z, se = F.atanh("rho"), F.sqrt(F.try_divide(F.lit(1.06), F.col("n") - 3))
    return out.select(*by, "n", "rho", F.tanh(z - 1.96 * se).alias("low"), F.tanh(z + 1.96 * se).alias("high"))


def quantile_breaks(df: DataFrame, x: str, bins: int = 10) -> list[float]:
    """Unique break points of a quantile cut (linear interpolation)."""
    found = quantiles(df, x, [i / bins for i in range(bins + 1)]).first()
    return sorted(set(found[0] if found else []))


def cut(x: Column, breaks: list[float]) -> Column:
    """Bin number, right-closed, the lowest included."""
    out = F.lit(None).cast("int")
    for i in range(len(breaks) - 1, 0, -1):
        out = F.when(x <= breaks[i], i).otherwise(out)
    return F.when(x >= breaks[0], out) if breaks else out


def bic(loglik: float, df: int, n: int) -> float:
    return -2 * loglik + df * math.log(n)


def _log_gamma_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
        if abs(term) < abs(total) * 1e-15:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 500):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    return 1 - _log_gamma_series(a, y) if y < a + 1 else _gamma_fraction(a, y)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (the modified Lentz method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return total * math.exp(front) / a


def t_two_sided(t: float, df: float) -> float:
    """The chance that a t statistic of df degrees of freedom is at least |t| away from zero."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def with_p(correlations: DataFrame, n: str = "n", rho: str = "rho") -> DataFrame:
    """correlations with the t statistic of rho against zero and its two-sided p; null where rho is, and below three pairs."""
    names = correlations.columns

    def run(batches):
        for batch in batches:
            rows = [(None, None) if r is None or k < 3 else (math.copysign(math.inf, r), 0.0) if abs(r) >= 1 else ((t := r * math.sqrt((k - 2) / (1 - r * r))), t_two_sided(t, k - 2)) for k, r in zip(batch.column(n).to_pylist(), batch.column(rho).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], type=pa.float64()) for i in range(2))], names=[*names, "t", "p"])

    return correlations.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in correlations.dtypes) + ", t double, p double")


def chi_square(table: np.ndarray) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of a contingency table without continuity correction."""
    t = np.asarray(table, dtype=float)
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    expected = np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()
    stat, df = float(((t - expected) ** 2 / expected).sum()), (t.shape[0] - 1) * (t.shape[1] - 1)
    return stat, df, chi2_sf(stat, df) if df else 1.0


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a small contingency table."""
    two = lambda n: float((n * (n - 1) / 2).sum())
    t = np.asarray(table, dtype=float)
    ra, rb, rc, n = two(t.sum(axis=1)), two(t.sum(axis=0)), two(t), float(t.sum())
    if n < 2:
        return 1.0
    expected, most = ra * rb / (n * (n - 1) / 2), (ra + rb) / 2
    return 1.0 if most == expected else (rc - expected) / (most - expected)


def hungarian(gain: np.ndarray) -> list[int]:
    """Column for each row of a square matrix so that the total gain is largest (shortest augmenting paths)."""
    cost = -np.asarray(gain, dtype=float)
    n = cost.shape[0]
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def hungarian_margin(gain: np.ndarray) -> tuple[list[int], float, float]:
    """The best assignment, its gain, and its lead over the best one that breaks at least one of its edges."""
    best = hungarian(gain)
    top = float(sum(gain[i, j] for i, j in enumerate(best)))
    second = -np.inf
    for i, j in enumerate(best):
        g = np.array(gain, dtype=float)
        g[i, j] = -1e9
        other = hungarian(g)
        second = max(second, float(sum(g[k, m] for k, m in enumerate(other))))
    return best, top, top - second


def best_by_trying(gain: np.ndarray) -> float:
    """For tests: the best total over all assignments of a small matrix."""
    n = gain.shape[0]
    return max(sum(gain[i, p[i]] for i in range(n)) for p in permutations(range(n)))
