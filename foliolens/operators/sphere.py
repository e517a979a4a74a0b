"""Clustering on the unit sphere: spherical k-means, spherical Cauchy mixtures, one-component fits.

Vectors stay distributed; a round sends k x d parameters out and brings k sums of d + 1 numbers back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.config import ClusterConfig
from foliolens.functions.stats import rand_index
from foliolens.sources.durable import stored


def _matrix(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype(float)


def log_density(x: np.ndarray, mu: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """n x k spherical Cauchy log-densities up to the sphere's area."""
    d = x.shape[1]
    return (d - 1) * (np.log1p(-(rho**2)) - np.log1p(rho**2 - 2 * rho * (x @ mu.T)))


def posterior(x: np.ndarray, mu: np.ndarray, rho: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior shares n x k and log-likelihoods n."""
    l = np.log(pi) + log_density(x, mu, rho)
    m = l.max(axis=1, keepdims=True)
    e = np.exp(l - m)
    s = e.sum(axis=1, keepdims=True)
    return e / s, (m + np.log(s)).ravel()


def em_sums(x: np.ndarray, mu: np.ndarray, rho: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What a round needs of some rows: sums of posterior-weighted Moebius-transformed points, posterior masses, log-likelihood."""
    post, l = posterior(x, mu, rho, pi)
    g = mu * rho[:, None]
    q = post / (1 + rho**2 - 2 * (x @ g.T))
    return (1 - rho**2)[:, None] * (q.T @ x - q.sum(axis=0)[:, None] * g), post.sum(axis=0), float(l.sum())


def em_step(mu: np.ndarray, rho: np.ndarray, s: np.ndarray, w: np.ndarray, n: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New mu, rho and pi; components below the floor's share are dropped."""
    d = mu.shape[1]
    g = mu * rho[:, None]
    g = g + 0.5 * (1 - rho**2)[:, None] * (d / (d - 1)) * (s / np.maximum(w, 1e-12)[:, None] - g)
    size = np.linalg.norm(g, axis=1)
    g *= np.where(size > 0.999, 0.999 / np.maximum(size, 1e-12), 1.0)[:, None]
    size = np.linalg.norm(g, axis=1)
    keep = w / n >= floor
    return (g / np.maximum(size, 1e-12)[:, None])[keep], size[keep], (w / w[keep].sum())[keep]


@dataclass
class Mixture:
    mu: np.ndarray
    rho: np.ndarray
    pi: np.ndarray
    loglik: float = -math.inf
    n: int = 0
    iterations: int = 0
    trace: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.pi)

    @property
    def bic(self) -> float:
        return -2 * self.loglik + (self.k * (self.mu.shape[1] + 1) - 1) * math.log(max(self.n, 1))


def spherical_kmeans(df: DataFrame, centres: np.ndarray, vec: str = "embedding", rounds: int = 50) -> tuple[np.ndarray, list[float]]:
    """Centres from given ones: assign by the largest dot product (first of equals), centre = unit sum; an empty cluster keeps its centre."""
    k, d = centres.shape
    trace: list[float] = []
    for _ in range(rounds):
        c = centres

        def sums(batches, c=c):
            s, n, q = np.zeros((k, d)), np.zeros(k), 0.0
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf, vec)
                    p = x @ c.T
                    a = p.argmax(axis=1)
                    np.add.at(s, a, x)
                    n += np.bincount(a, minlength=k)
                    q += float(p.max(axis=1).sum())
            yield pd.DataFrame({"k": range(k), "n": n, "q": [q] + [0.0] * (k - 1), "s": list(s)})

        parts = df.select(vec).mapInPandas(sums, "k int, n double, q double, s array<double>")
        got = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.array(*[F.sum(F.get("s", i)) for i in range(d)]).alias("s")).orderBy("k").collect()
        trace.append(sum(r["q"] for r in got))
        new = np.array([np.array(r["s"]) / (np.linalg.norm(r["s"]) or 1) if r["n"] else centres[r["k"]] for r in got])
        done, centres = np.allclose(new, centres, atol=1e-10), new
        if done:
            break
    return centres, trace


def kmeans_by(df: DataFrame, by: str, key: str, k: int, vec: str = "embedding", rounds: int = 50, seed: int = 42, spare: int = 2) -> dict:
    """Spherical k-means of each group, all groups in one job a round: {group: centres}.

    Starts are rows drawn by hash, and so are `spare * k` more, which take the place of clusters that come out empty. A round
    counts the rows whose label has changed under the last centres; a group without any, and without an empty cluster, is done. Groups of fewer rows than k get
    a centre for each row.
    """
    kind, d = dict(df.dtypes)[by], None
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key))
    drawn = df.select(by, key, vec).withColumn("__nth", nth).where(F.col("__nth") <= k * (1 + spare)).orderBy(by, "__nth").collect()  # a few rows of each group
    pool: dict = {}
    for r in drawn:
        pool.setdefault(r[by], []).append(np.array(r[vec], dtype=float))
    centres = {g: np.array(rows[:k]) for g, rows in pool.items()}
    reserve = {g: rows[k:] for g, rows in pool.items()}
    last: dict = {g: None for g in centres}
    live = set(centres)
    for _ in range(rounds):
        if not live:
            break
        sent = {g: (centres[g], last[g]) for g in live}

        def sums(batches, sent=sent):
            total: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(vec).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1)
                for g, rows in pd.Series(batch.column(by).to_pandas()).groupby(batch.column(by).to_pandas()).indices.items():
                    if g not in sent:
                        continue
                    now, before = sent[g]
                    label = (x[rows] @ now.T).argmax(axis=1)
                    moved = len(rows) if before is None else int((label != (x[rows] @ before.T).argmax(axis=1)).sum())
                    one = np.eye(len(now))[label]
                    s0, m0 = total.get(g, (0, 0))
                    total[g] = s0 + np.hstack([one.sum(axis=0)[:, None], one.T @ x[rows]]), m0 + moved
            for g, (s, moved) in total.items():
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"g": [g] * len(s), "k": np.arange(len(s), dtype=np.int32), "moved": [moved] + [0] * (len(s) - 1), "s": list(s)}), preserve_index=False)

        d = d or len(next(iter(centres.values()))[0])
        parts = df.select(by, vec).mapInArrow(sums, f"g {kind}, k int, moved long, s array<double>")
        got: dict = {}
        for r in parts.groupBy("g", "k").agg(F.sum("moved").alias("moved"), F.array(*[F.sum(F.get("s", i)) for i in range(d + 1)]).alias("s")).collect():
            got.setdefault(r["g"], {})[r["k"]] = (r["moved"], np.array(r["s"]))
        for g in list(live):
            empty = any(s[0] == 0 for _, s in got[g].values())
            if sum(moved for moved, _ in got[g].values()) == 0 and not (empty and reserve[g]):
                live.remove(g)
                continue
            new = np.empty_like(centres[g])
            for j in range(len(new)):
                s = got[g][j][1]
                size = np.linalg.norm(s[1:])
                new[j] = s[1:] / size if s[0] and size > 0 else (reserve[g].pop(0) if reserve[g] else centres[g][j])
            last[g], centres[g] = centres[g], new
    return centres


def nearest_centre(df: DataFrame, by: str, centres: dict, keys: list[str], out: str, vec: str = "embedding") -> DataFrame:
    """keys and the number of the first nearest centre of each row's group."""
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(vec).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1)
                label, groups = np.full(len(x), -1, dtype=np.int32), batch.column(by).to_pandas()
                for g, rows in groups.groupby(groups).indices.items():
                    label[rows] = (x[rows] @ centres[g].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(label)], names=[*keys, out])

    return df.select(*dict.fromkeys([*keys, by, vec])).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {out} int")


def seed_centres(df: DataFrame, key: str, vec: str, k: int, seed: int) -> np.ndarray:
    rows = df.select(key, vec).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k).collect()
    return np.array([r[1] for r in rows], dtype=float)


def spherical_cauchy_em(df: DataFrame, start: Mixture, vec: str = "embedding", rounds: int = 60, tol: float = 1e-6, floor: float = 0.0, inner: int = 1) -> Mixture:
    """Expectation maximisation from given parameters; components below the floor's share are dropped.

    With g = rho mu the density is (1 - |g|^2) / |x - g|^2 to the power d - 1; each round moves g along the
    weighted mean of the Moebius-transformed points, which needs k sums of d + 1 numbers.
    """
    m = start
    d = m.mu.shape[1]
    for it in range(rounds):
        mu, rho, pi = m.mu, m.rho, m.pi
        k = len(pi)

        def sums(batches, mu=mu, rho=rho, pi=pi, k=k):
            s, w, ll, n = np.zeros((k, d)), np.zeros(k), 0.0, 0
            for pdf in batches:
                if len(pdf):
                    s1, w1, l1 = em_sums(_matrix(pdf, vec), mu, rho, pi)
                    s, w, ll, n = s + s1, w + w1, ll + l1, n + len(pdf)
            yield pd.DataFrame({"k": range(k), "w": w, "ll": [ll] + [0.0] * (k - 1), "n": [float(n)] + [0.0] * (k - 1), "s": list(s)})

        parts = df.select(vec).mapInPandas(sums, "k int, w double, ll double, n double, s array<double>")
        got = parts.groupBy("k").agg(F.sum("w").alias("w"), F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(d)]).alias("s")).orderBy("k").collect()
        w, ll, n = np.array([r["w"] for r in got]), sum(r["ll"] for r in got), int(sum(r["n"] for r in got))
        m.trace.append(ll)
        m.loglik, m.n, m.iterations = ll, n, it + 1
        if len(m.trace) > 1 and abs(m.trace[-1] - m.trace[-2]) < tol * abs(m.trace[-2]):
            break
        m = Mixture(*em_step(mu, rho, np.array([r["s"] for r in got]), w, n, floor), ll, n, it + 1, m.trace)
    return m


def stacked_sums(x: np.ndarray, mu: np.ndarray, rho: np.ndarray, pi: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """em_sums of several mixtures at once: their components stacked, those of a mixture from one of `starts` to the next. Sums and
    masses of all components, log-likelihoods of the mixtures."""
    d, size = x.shape[1], np.diff([*starts, len(mu)])
    dots = x @ mu.T
    far = 1 + rho**2 - 2 * rho * dots
    l = np.log(pi) + (d - 1) * (np.log1p(-(rho**2)) - np.log(far))
    top = np.maximum.reduceat(l, starts, axis=1)
    e = np.exp(l - np.repeat(top, size, axis=1))
    total = np.add.reduceat(e, starts, axis=1)
    post = e / np.repeat(total, size, axis=1)
    q = post / far
    g = mu * rho[:, None]
    return (1 - rho**2)[:, None] * (q.T @ x - q.sum(axis=0)[:, None] * g), post.sum(axis=0), (top + np.log(total)).sum(axis=0)


def stacked_em(df: DataFrame, starts: dict[tuple, Mixture], by: str | None = None, vec: str = "embedding", rounds: int = 60, tol: float = 1e-6, floor: float = 0.0) -> dict[tuple, Mixture]:
    """Expectation maximisation of many mixtures, one job a round for all of them, whatever their number.

    starts: {(group, ...): mixture}; a mixture sees the rows of its group, or all rows where by is None. A fit that has converged
    is left out of further rounds. Components below the floor's share are dropped. A task sends back the sums of each component.
    """
    fits = {k: Mixture(m.mu, m.rho, m.pi) for k, m in starts.items()}
    live, d = sorted(fits, key=str), None
    kind = dict(df.dtypes)[by] if by else "int"
    rows = df.select(F.lit(0).alias("g"), F.col(vec).alias("v")) if by is None else df.select(F.col(by).alias("g"), F.col(vec).alias("v"))
    for it in range(rounds):
        if not live:
            break
        sent, order = {}, {}
        for k in live:
            order.setdefault(k[0] if by else 0, []).append(k)
        for g, keys in order.items():
            at = np.cumsum([0, *(fits[k].k for k in keys[:-1])])
            sent[g] = (*(np.concatenate([getattr(fits[k], c) for k in keys]) for c in ("mu", "rho", "pi")), at)

        def sums(batches, sent=sent):
            total: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1)
                groups = batch.column("g").to_pandas()
                for g, at in groups.groupby(groups).indices.items():
                    if g in sent:
                        s, w, ll = stacked_sums(x[at], *sent[g])
                        s0, w0, l0, n0 = total.get(g, (0, 0, 0, 0))
                        total[g] = s0 + s, w0 + w, l0 + ll, n0 + len(at)
            for g, (s, w, ll, n) in total.items():
                of = np.zeros(len(w))
                of[sent[g][3]] = ll
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"g": [g] * len(w), "c": np.arange(len(w), dtype=np.int32), "n": np.full(len(w), n), "s": list(np.hstack([w[:, None], of[:, None], s]))}), preserve_index=False)

        d = d or next(iter(fits.values())).mu.shape[1]
        parts = rows.mapInArrow(sums, f"g {kind}, c int, n long, s array<double>")
        got: dict = {}
        for r in parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(d + 2)]).alias("s")).collect():
            got.setdefault(r["g"], {})[r["c"]] = (r["n"], r["s"])
        still = []
        for g, keys in order.items():
            if g not in got:
                continue  # a group without rows
            n, values = got[g][0][0], np.array([got[g][c][1] for c in range(len(got[g]))])
            for k, at in zip(keys, sent[g][3], strict=True):
                m, own = fits[k], values[at : at + fits[k].k]
                m.trace.append(float(own[0, 1]))
                m.loglik, m.n, m.iterations = m.trace[-1], int(n), it + 1
                if len(m.trace) > 1 and abs(m.trace[-1] - m.trace[-2]) < tol * abs(m.trace[-2]):
                    continue
                fits[k] = Mixture(*em_step(m.mu, m.rho, own[:, 2:], own[:, 0], m.n, floor), m.loglik, m.n, it + 1, m.trace)
                still.append(k)
        live = still
    return fits


#: Rows of a group from which starts are drawn.
POOL = 512


def pools(df: DataFrame, key: str, by: str | None = None, vec: str = "embedding", seed: int = 42, size: int = POOL) -> dict:
    """{group: matrix} of at most `size` rows of each group, drawn by hash."""
    rows = df.select((F.lit(0) if by is None else F.col(by)).alias("g"), F.col(key).alias("__k"), vec)
    nth = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("__k", F.lit(seed)), "__k"))  # each task keeps its own first rows
    out: dict = {}
    for r in rows.withColumn("__n", nth).where(F.col("__n") <= size).orderBy("g", "__n").collect():
        out.setdefault(r["g"], []).append(r[vec])
    return {g: np.array(v, dtype=float) for g, v in out.items()}


def fit_many(df: DataFrame, key: str, ks: Sequence[int], restarts: int = 4, seed: int = 42, by: str | None = None, vec: str = "embedding", floor: float = 0.01, rounds: int = 60) -> dict[tuple, Mixture]:
    """{(group, k, start): mixture} of every group, number of components and start, all of them fitted in the same jobs. A start is drawn
    from the group's pool, on which a few rounds of k-means settle it."""
    starts = {}
    for g, pool in pools(df, key, by, vec, seed).items():
        for k in ks:
            for s in range(restarts if k <= len(pool) else 0):
                mu, _, _ = local_kmeans(pool, pool[np.random.default_rng(seed + 1000 * k + s).choice(len(pool), k, replace=False)], 5)
                starts[g, k, s] = Mixture(mu, np.full(k, 0.5), np.full(k, 1 / k))
    return stacked_em(df, starts, by, vec, rounds, floor=floor) if starts else {}


def best_of(fits: dict[tuple, Mixture], require_k: bool = True) -> dict[tuple, tuple[Mixture | None, dict]]:
    """{(group, k): (best mixture by BIC, counts)}, among those that keep k components if that is required."""
    out: dict = {}
    for (g, k, _), m in sorted(fits.items(), key=lambda kv: str(kv[0])):
        best, counts = out.get((g, k), (None, {"n_ok": 0, "n_collapse": 0, "n_fail": 0}))
        if m.k < k and require_k:
            counts["n_collapse"] += 1
        else:
            counts["n_ok"] += 1
            best = m if best is None or m.bic < best.bic else best
        out[g, k] = best, counts
    return out


def fit_mixture(df: DataFrame, key: str, k: int, restarts: int = 4, seed: int = 42, vec: str = "embedding", floor: float = 0.01, require_k: bool = True, rounds: int = 60) -> tuple[Mixture | None, dict]:
    """The best of several starts by BIC, among those that keep k components if that is required; all starts in one job a round."""
    fits = fit_many(df, key, [k], restarts, seed, None, vec, floor, rounds)
    return best_of(fits, require_k).get((0, k), (None, {"n_ok": 0, "n_collapse": 0, "n_fail": restarts}))


def local_kmeans(x: np.ndarray, centres: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """As spherical_kmeans, for a bounded matrix: centres, labels, mean cosine."""
    for _ in range(rounds):
        p = x @ centres.T
        a = p.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, a, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
        if np.allclose(new, centres, atol=1e-10):
            break
        centres = new
    p = x @ centres.T
    return centres, p.argmax(axis=1), float(p.max(axis=1).mean())


def local_mixture(x: np.ndarray, k: int, seed: int, floor: float = 0.01, rounds: int = 60, tol: float = 1e-6) -> Mixture | None:
    """As one start of fit_mixture, for a bounded matrix; None if there are too few rows."""
    if len(x) < k:
        return None
    mu, _, _ = local_kmeans(x, x[np.random.default_rng(seed).choice(len(x), k, replace=False)], 5)
    m = Mixture(mu, np.full(k, 0.5), np.full(k, 1 / k), n=len(x))
    for it in range(rounds):
        s, w, ll = em_sums(x, m.mu, m.rho, m.pi)
        m.trace.append(ll)
        m.loglik, m.iterations = ll, it + 1
        if len(m.trace) > 1 and abs(m.trace[-1] - m.trace[-2]) < tol * abs(m.trace[-2]):
            break
        m = Mixture(*em_step(m.mu, m.rho, s, w, len(x), floor), ll, len(x), it + 1, m.trace)
    return m


SCAN = "method string, k int, fit int, criterion double, least_share double, rho_median double, n_ok int, n_collapse int, members array<int>, labels array<int>"


def scan_k(sample: DataFrame, key: str, ks: Sequence[int] = range(2, 21), restarts: int = 4, fits: int = 10, share: float = 0.8, least: int = 100, floor: float = 0.01, seed: int = 42, rounds: int = 60, vec: str = "embedding") -> DataFrame:
    """How the number of components shows on a bounded sample: method (mixture, kmeans), k, criterion (BIC of the best of
    several starts, mean cosine), smallest share, median concentration, starts that kept or lost components, mean and spread of the pairwise
    adjusted Rand index of fits on subsamples, over the members that two of them share (at least `least`), and cross_ari, that of
    both methods' labels of the whole sample.

    sample: a few thousand rows, the caller's bound; it goes to all executors, and each fit is a task of its own.
    """
    spark = sample.sparkSession
    x = np.array([r[0] for r in sample.orderBy(key).select(vec).collect()], dtype=float)
    block = spark.sparkContext.broadcast(x)
    jobs = [(m, int(k), f) for m in ("mixture", "kmeans") for k in ks if k < len(x) for f in range(-1, fits)]

    def one(method: str, k: int, fit: int) -> tuple:
        x = block.value
        rng = np.random.default_rng(seed + 7919 * k + fit + 1)
        members = np.arange(len(x)) if fit < 0 else np.sort(rng.choice(len(x), int(share * len(x)), replace=False))
        part, best, ok, lost = x[members], None, 0, 0
        for s in range(restarts if fit < 0 else 1):
            start = seed + 1000 * k + s + 10**6 * (fit + 1)
            if method == "kmeans":
                centres = part[np.random.default_rng(start).choice(len(part), k, replace=False)]
                _, labels, value = local_kmeans(part, centres)
                found = (-value, labels, float(np.bincount(labels, minlength=k).min() / len(part)), None)
            else:
                m = local_mixture(part, k, start, floor, rounds)
                if m.k < k:
                    lost += 1
                    if fit < 0:
                        continue
                found = (m.bic, posterior(part, m.mu, m.rho, m.pi)[0].argmax(axis=1), float(m.pi.min()), float(np.median(m.rho)))
            ok += 1
            best = found if best is None or found[0] < best[0] else best
        if best is None:
            return method, k, fit, None, None, None, ok, lost, None, None
        return method, k, fit, -best[0] if method == "kmeans" else best[0], best[2], best[3], ok, lost, members.tolist() if fit >= 0 else None, best[1].tolist()

    def run(batches):
        for pdf in batches:
            rows = [one(*r) for r in pdf.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN.split(", ")])

    todo = spark.createDataFrame(jobs, "method string, k int, fit int").repartition(max(1, min(len(jobs), 256)), "method", "k", "fit")
    done = stored(todo.mapInPandas(run, SCAN), "fits")

    def agree(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, values = [(np.array(m), np.array(l)) for m, l in zip(pdf["members"], pdf["labels"], strict=True) if m is not None], []
        for i in range(len(parts)):
            for j in range(i):
                both, a, b = np.intersect1d(parts[i][0], parts[j][0], True, True)
                if len(both) >= least:
                    table = np.zeros((parts[i][1].max() + 1, parts[j][1].max() + 1))
                    np.add.at(table, (parts[i][1][a], parts[j][1][b]), 1)
                    values.append(rand_index(table))
        mean, sd = (float(np.mean(values)), float(np.std(values, ddof=1)) if len(values) > 1 else None) if values else (None, None)
        return pd.DataFrame([(pdf["method"].iloc[0], pdf["k"].iloc[0], mean, sd, len(values))], columns=["method", "k", "ari_mean", "ari_sd", "pairs"])

    stable = done.where("fit >= 0").groupBy("method", "k").applyInPandas(agree, "method string, k int, ari_mean double, ari_sd double, pairs int")
    whole = done.where("fit < 0")
    cross = whole.where("labels IS NOT NULL").groupBy("k").applyInPandas(crossed, "k int, cross_ari double")
    return whole.select("method", "k", "criterion", "least_share", "rho_median", "n_ok", "n_collapse").join(stable, ["method", "k"], "left").join(cross, "k", "left")


def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
    """k and the adjusted Rand index of the labels that two methods give the same rows; none if one of them has no fit."""
    labels = [np.array(v) for v in pdf.sort_values("method")["labels"]]
    if len(labels) != 2:
        return pd.DataFrame({"k": pd.Series(dtype="int32"), "cross_ari": pd.Series(dtype=float)})
    table = np.zeros((labels[0].max() + 1, labels[1].max() + 1))
    np.add.at(table, (labels[0], labels[1]), 1)
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "cross_ari": [rand_index(table)]})


KMIN = 4


def k_summary(scan: DataFrame, n: int, d: int, floor: float = 0.01, kmin: int = KMIN) -> DataFrame:
    """How to read scan_k, a row for each method: the k >= kmin of the largest stability (coarse splits are stable in any cloud), whether the curve
    is flat (its range below the fits' median spread), a component's BIC penalty against the median gain and whether BIC falls at
    every step, and the first k from which the smallest component is within 1.5 times the floor."""
    table = scan.toPandas().sort_values(["method", "k"])  # a row for each k and method
    rows = []
    for method, t in table.groupby("method"):
        some = t[t["k"] >= kmin]
        known = some.dropna(subset=["ari_mean"])
        chosen = int(known.loc[known["ari_mean"].idxmax(), "k"]) if len(known) else None
        spread = some["ari_sd"].median()
        flat = bool(known["ari_mean"].max() - known["ari_mean"].min() < spread) if len(known) and spread == spread else None
        penalty = gain = falls = None
        steps = np.diff(t["criterion"].dropna())
        if method == "mixture" and len(steps):
            penalty, gain, falls = (d + 1) * math.log(n), float(np.median(np.abs(steps))), bool((steps < 0).all())
        near = some[some["least_share"] < 1.5 * floor]["k"]
        rows.append((method, chosen, flat, penalty, gain, falls, int(near.min()) if method == "mixture" and len(near) else None))
    return scan.sparkSession.createDataFrame(rows, "method string, chosen_k int, flat boolean, bic_penalty double, bic_gain double, bic_falls boolean, near_floor_from int")


def fit_clusters(df: DataFrame, key: str, config: ClusterConfig, vec: str = "embedding") -> tuple[Mixture | None, dict]:
    """The mixture of the settings; a component must hold the larger of a share and of a number of members."""
    return fit_mixture(df, key, config.k, config.restarts, config.seed, vec, effective_floor(config.min_share, df.count(), config.least_members))


def effective_floor(share: float, n: int, least: int = 150) -> float:
    """The least share of a component: `share`, or that of `least` members where that is more."""
    return max(share, least / max(n, 1))


def assign(df: DataFrame, m: Mixture, keys: list[str], vec: str = "embedding") -> DataFrame:
    """keys, label (first argmax), max_post, loglik, posterior."""
    mu, rho, pi = m.mu, m.rho, m.pi
    kinds = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                post, l = posterior(_matrix(pdf, vec), mu, rho, pi)
                out = pdf[keys].copy()
                out["label"], out["max_post"], out["loglik"], out["posterior"] = post.argmax(axis=1).astype("int32"), post.max(axis=1), l, list(post)
                yield out

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", label int, max_post double, loglik double, posterior array<double>"
    return df.select(*keys, vec).mapInPandas(run, schema)


def from_psi(psi: np.ndarray, pi: np.ndarray) -> Mixture:
    """A mixture given as psi = rho mu."""
    rho = np.linalg.norm(psi, axis=1)
    return Mixture(psi / np.maximum(rho, 1e-12)[:, None], rho, pi)


def verified(params: DataFrame, m: Mixture, df: DataFrame, vec: str = "embedding", rows: int = 200) -> Mixture:
    """The mixture of saved parameters (k, psi, pi), if it gives some rows the posterior that m gives them."""
    held = params.orderBy("k").collect()
    read = from_psi(np.array([r["psi"] for r in held]), np.array([r["pi"] for r in held]))
    x = np.array([r[0] for r in df.select(vec).limit(rows).collect()], dtype=float)
    if len(x) and np.abs(posterior(x, read.mu, read.rho, read.pi)[0] - posterior(x, m.mu, m.rho, m.pi)[0]).max() > 1e-8:
        raise ArithmeticError("the saved parameters do not give the fit's posterior")
    return read


def poisson_kernel_fit(df: DataFrame, vec: str = "embedding", rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, float, list[float]]:
    """One component with density (1 - |g|^2) / |x - g|^d, by gradient ascent with step halving and growth by half."""
    d = len(df.select(vec).first()[0])

    def at(g: np.ndarray) -> tuple[float, np.ndarray, int]:
        def sums(batches):
            ll, s, n = 0.0, np.zeros(d), 0
            for pdf in batches:
                if len(pdf):
                    diff = _matrix(pdf, vec) - g
                    q = (diff**2).sum(axis=1)
                    ll += float(-(d / 2) * np.log(q).sum())
                    s += d * (diff / q[:, None]).sum(axis=0)
                    n += len(pdf)
            yield pd.DataFrame({"ll": [ll], "n": [float(n)], "s": [s]})

        r = df.select(vec).mapInPandas(sums, "ll double, n double, s array<double>").agg(F.sum("ll"), F.sum("n"), F.array(*[F.sum(F.get("s", i)) for i in range(d)])).first()
        n, room = int(r[1]), 1 - float(g @ g)
        return r[0] + n * math.log(room), np.array(r[2]) - 2 * n * g / room, n

    g, step = np.zeros(d), 0.1
    ll, grad, n = at(g)
    trace = [ll]
    for _ in range(rounds):
        new = g + step * grad / n
        if new @ new >= 0.998:
            step /= 2
            continue
        ll2, grad2, _ = at(new)
        if ll2 < ll:
            step /= 2
            if step < 1e-10:
                break
            continue
        done = ll2 - ll < tol * abs(ll)
        g, ll, grad, step = new, ll2, grad2, step * 1.5
        trace.append(ll)
        if done:
            break
    rho = float(np.linalg.norm(g))
    return (g / rho if rho else g), rho, trace
