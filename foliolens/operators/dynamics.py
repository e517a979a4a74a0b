"""How labels move from period to period: steps, rates with intervals and chance, persistence, refits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.stats import hungarian_margin, rand_index, wilson
from foliolens.operators.sphere import Mixture, em_step, em_sums, posterior


def label_steps(labels: DataFrame, key: str = "investor_id", year: str = "year", horizon: int = 1) -> DataFrame:
    """Labels (key, year, label and more) joined with the same key's `horizon` years later: columns with _from and _to, and sw."""
    rest = [c for c in labels.columns if c not in (key, year)]
    a = labels.select(key, year, *[F.col(c).alias(f"{c}_from") for c in rest])
    b = labels.select(key, (F.col(year) - horizon).alias(year), *[F.col(c).alias(f"{c}_to") for c in rest])
    return a.join(b, [key, year]).withColumn("sw", (F.col("label_from") != F.col("label_to")).cast("int"))


def switch_rates(steps: DataFrame, subsets: dict[str, Column], year: str = "year") -> DataFrame:
    """Per year and subset: steps, switches, their rate with a Wilson interval; and what independent labels would give."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    g = steps.select(year, "sw", F.explode(names).alias("subset")).groupBy(year, "subset").agg(F.count(F.lit(1)).alias("n"), F.sum("sw").alias("switches"))
    low, high = wilson(F.col("switches"), F.col("n"))
    same = agreement_by_chance(steps, [year]).select(year, (1 - F.col("chance")).alias("chance"))
    return g.join(same, year).select(year, "subset", "n", "switches", (F.col("switches") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"), "chance")


def agreement_by_chance(steps: DataFrame, by: list[str]) -> DataFrame:
    """by and the sum over labels of the product of both margins' shares."""

    def margin(c: str, p: str) -> DataFrame:
        n = steps.groupBy(*by, F.col(c).alias("l")).agg(F.count(F.lit(1)).alias("k"))
        return n.select(*by, "l", (F.col("k") / F.sum("k").over(Window.partitionBy(*by))).alias(p))

    return margin("label_from", "pf").join(margin("label_to", "pt"), [*by, "l"], "full").groupBy(*by).agg(F.sum(F.coalesce(F.col("pf") * F.col("pt"), F.lit(0.0))).alias("chance"))


def persistence(labels: DataFrame, key: str = "investor_id", year: str = "year", horizons: int = 10, least: int = 200) -> DataFrame:
    """Per horizon and first year: common members, the share with the same label, and what chance gives; small overlaps are left out."""
    span = F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("h")
    a = labels.select(key, F.col(year).alias("year0"), F.col("label").alias("label_from"), span)
    b = labels.select(F.col(key).alias("k"), F.col(year).alias("y"), F.col("label").alias("label_to"))
    pairs = a.join(b, (F.col(key) == F.col("k")) & (F.col("y") == F.col("year0") + F.col("h")))
    g = pairs.groupBy("h", "year0").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label_from") == F.col("label_to")).cast("int")).alias("same")).where(F.col("n") >= least)
    return g.join(agreement_by_chance(pairs, ["h", "year0"]), ["h", "year0"])


def refit_by(df: DataFrame, by: str, starts: dict, vec: str = "embedding", rounds: int = 60, tol: float = 1e-6, floor: float = 0.01) -> dict:
    """A mixture of each group, all groups in one pass a round: each group's parameters go out, its sums come back."""
    fits, live = dict(starts), set(starts)
    d = next(iter(starts.values())).mu.shape[1]
    for it in range(rounds):
        sent = {g: (fits[g].mu, fits[g].rho, fits[g].pi) for g in live}

        def sums(batches, sent=sent):
            total: dict = {}
            for pdf in batches:
                for g, part in pdf.groupby(by):
                    if g in sent:
                        s, w, ll = em_sums(np.stack(part[vec].to_numpy()).astype(float), *sent[g])
                        s0, w0, l0, n0 = total.get(g, (0, 0, 0.0, 0))
                        total[g] = s0 + s, w0 + w, l0 + ll, n0 + len(part)
            rows = [(g, k, float(w[k]), ll if not k else 0.0, n if not k else 0, s[k]) for g, (s, w, ll, n) in total.items() for k in range(len(w))]
            yield pd.DataFrame(rows, columns=["g", "k", "w", "ll", "n", "s"])

        kind = dict(df.dtypes)[by]
        parts = df.select(by, vec).mapInPandas(sums, f"g {kind}, k int, w double, ll double, n long, s array<double>")
        got = parts.groupBy("g", "k").agg(F.sum("w").alias("w"), F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", i)) for i in range(d)]).alias("s")).collect()
        for g in list(live):
            rows = sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])
            m, w, ll, n = fits[g], np.array([r["w"] for r in rows]), sum(r["ll"] for r in rows), int(sum(r["n"] for r in rows))
            m.trace.append(ll)
            m.loglik, m.n, m.iterations = ll, n, it + 1
            if len(m.trace) > 1 and abs(m.trace[-1] - m.trace[-2]) < tol * abs(m.trace[-2]):
                live.remove(g)
                continue
            fits[g] = Mixture(*em_step(m.mu, m.rho, np.array([r["s"] for r in rows]), w, n, floor), ll, n, it + 1, m.trace)
        if not live:
            break
    return fits


def assigned_by(df: DataFrame, by: str, fits: dict, keys: list[str], vec: str = "embedding", out: str = "label") -> DataFrame:
    """keys and each row's first best component under its group's mixture."""
    held = {g: (m.mu, m.rho, m.pi) for g, m in fits.items()}
    kinds = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            for g, part in pdf.groupby(by):
                if g in held:
                    yield part[keys].assign(**{out: posterior(np.stack(part[vec].to_numpy()).astype(float), *held[g])[0].argmax(axis=1).astype("int32")})

    return df.select(*dict.fromkeys([*keys, by, vec])).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {out} int")


def refit_persistence(refits: dict, reference: Mixture, counts: dict) -> list[tuple]:
    """Per group: components, adjusted Rand index of refit and fixed labels, least and mean cosine of matched centres, the
    matching's margin, and the share of components that centres and members match alike. counts: {group: {(refit, fixed): members}}."""
    rows = []
    for g, m in sorted(refits.items()):
        k = max(m.k, reference.k)
        cos, members = np.full((k, k), -1.0), np.zeros((k, k))
        cos[: m.k, : reference.k] = m.mu @ reference.mu.T
        for (a, b), n in counts.get(g, {}).items():
            members[a, b] = n
        centre, _, margin = hungarian_margin(cos)
        member, _, _ = hungarian_margin(members)
        matched = np.array([cos[i, centre[i]] for i in range(m.k)])
        agree = float(np.mean([centre[i] == member[i] for i in range(m.k)]))
        rows.append((g, m.k, rand_index(members), float(matched.min()), float(matched.mean()), float(margin), agree))
    return rows


def matching(gain: np.ndarray) -> list[int]:
    """For each row its column in the best assignment, of a matrix of no more rows than columns."""
    wide = np.full((gain.shape[1],) * 2, float(gain.min(initial=0)) - 1)
    wide[: len(gain)] = gain
    return hungarian_margin(wide)[0][: len(gain)]


def chain_check(refits: dict, reference: Mixture, counts: dict) -> list[tuple]:
    """Consecutive refits matched on shared members, without any rotation: year, next year, members in common, their adjusted Rand
    index, the share of the later refit's components whose reference component by members and the earlier refit's
    centres is the one by their own centres, and the same with the members' matchings composed all along the years.

    counts: {(year, next): {(label, next label): members}}. A step in which a component appears has no matching; the chain
    begins anew after it.
    """
    by_centre = {y: matching(m.mu @ reference.mu.T) if m.k <= reference.k else None for y, m in refits.items()}
    rows, along, years = [], None, sorted(refits)
    for y, later in zip(years[:-1], years[1:], strict=True):
        a, b = refits[y], refits[later]
        table = np.zeros((a.k, b.k))
        for (i, j), n in counts.get((y, later), {}).items():
            table[i, j] = n
        ari, n = rand_index(table), int(table.sum())
        if b.k > a.k or by_centre[y] is None or by_centre[later] is None:
            rows.append((y, later, n, ari, None, None))
            along = None
            continue
        step = matching(table.T)
        along = [(along or by_centre[y])[i] for i in step]
        direct = by_centre[later]
        agree = lambda implied, direct=direct: float(np.mean([i == j for i, j in zip(implied, direct, strict=True)]))
        rows.append((y, later, n, ari, agree([by_centre[y][i] for i in step]), agree(along)))
    return rows
