"""Queries over anchor rules, rotated spaces and leave-one-out checks.

Rotations fitted by a singular value decomposition are beyond SQL. The queries named `_given` run the same operators with
given rotations instead, reflections at the hyperplanes of token vectors, which SQL can apply.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions import stats
from foliolens.operators import align as AL
from foliolens.operators import contrastive as C
from foliolens.operators import dynamics as DY
from foliolens.operators import frames as FR
from foliolens.operators import sphere as SP
from foliolens.operators.pooling import hash_split
from foliolens.plans import adapters as A
from foliolens.plans import model_queries as M
from foliolens.plans.adapters import INVESTORS, KEYS
from foliolens.plans.model_queries import _MU, _OV, _VEC, K_FIXED, PERMUTED, RHO_FIXED, STAYS
from foliolens.plans.registry import query
from foliolens.sources.durable import cached, stored

#: Anchors below which `stable_thr` falls back; strata of the later year's vectors.
LEAST, STRATA = 20, 4
#: Components, starts and least share of the free refits.
REFIT_K, RESTARTS, REFIT_FLOOR = K_FIXED, 4, 0.01


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """investor_id, year, a, b, wt_overlap, investor_type of each investor in two years running."""

    def make() -> DataFrame:
        o = M.overlaps(spark, sf).join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
        return M.year_pairs(spark, sf).join(o, ["investor_id", "year"])

    return cached(spark, ("paired", sf), make)


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """paired() with each row's stratum: the spherical k-means cluster of its vector in the later year, among that step's rows."""

    def make() -> DataFrame:
        p = paired(spark, sf)
        centres = SP.kmeans_by(p, "year", "investor_id", STRATA, vec="b")
        return SP.nearest_centre(p, "year", centres, p.columns, "stratum", vec="b")

    return cached(spark, ("clustered", sf), make)


_HELD = "('0x' || substr(md5('7/' || year || '/' || investor_id), 1, 8))::BIGINT % 5 = 0"
_MEM = f"""o AS (SELECT investor_id, year, wt_overlap, investor_type, {_HELD} AS held, wt_overlap >= {STAYS} AS stable FROM ov JOIN inv USING (investor_id)),
q AS (SELECT *, quantile_cont(wt_overlap, 0.75) OVER (PARTITION BY year, investor_type) AS q_all, quantile_cont(CASE WHEN held THEN NULL ELSE wt_overlap END, 0.75) OVER (PARTITION BY year, investor_type) AS q_pool,
count(*) FILTER (stable) OVER (PARTITION BY year) < {LEAST} AS few_all, count(*) FILTER (stable AND NOT held) OVER (PARTITION BY year) < {LEAST} AS few_pool,
row_number() OVER (PARTITION BY year ORDER BY wt_overlap DESC, investor_id) AS n_all, row_number() OVER (PARTITION BY year, held ORDER BY wt_overlap DESC, investor_id) AS n_pool FROM o),
mem AS (SELECT *, CASE WHEN few_all THEN n_all <= {LEAST} ELSE stable END AS thr, wt_overlap >= q_all AS strat, NOT held AS t_all, NOT held AND CASE WHEN few_pool THEN n_pool <= {LEAST} ELSE stable END AS t_thr, NOT held AND wt_overlap >= q_pool AS t_strat FROM q)"""


@query(
    f"""WITH {M.POS}, {INVESTORS}, {_OV}, {_MEM}
SELECT year, 'all' AS rule, count(*) AS n_anchor, count(*) FILTER (t_all) AS n_train, count(*) FILTER (held) AS n_held, count(*) FILTER (held AND stable) AS n_held_stable, false AS fallback FROM mem GROUP BY year
UNION ALL SELECT year, 'stable_thr', count(*) FILTER (thr), count(*) FILTER (t_thr), count(*) FILTER (held), count(*) FILTER (held AND stable), bool_or(few_all) FROM mem GROUP BY year
UNION ALL SELECT year, 'stable_strat', count(*) FILTER (strat), count(*) FILTER (t_strat), count(*) FILTER (held), count(*) FILTER (held AND stable), false FROM mem GROUP BY year"""
)
def anchor_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of each rule, among all and among those that are not held out, and whether too few are stable."""
    rows = FR.memberships(paired(spark, sf), "year", "investor_id", "investor_type", LEAST, STAYS)
    bit = lambda k: F.count(F.when(F.col("mem").bitwiseAND(1 << k) > 0, 1))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), bit(k).alias("n_anchor"), bit(k + 3).alias("n_train"), (F.max("fallback_all") & F.lit(r == "stable_thr")).alias("fallback")) for k, r in enumerate(FR.RULES)])
    g = rows.groupBy("year").agg(F.count(F.when(F.col("held_out"), 1)).alias("n_held"), F.count(F.when(F.col("held_out") & F.col("stable"), 1)).alias("n_held_stable"), each.alias("e"))
    return g.select("year", "n_held", "n_held_stable", F.explode("e").alias("e")).select("year", "e.rule", "e.n_anchor", "e.n_train", "n_held", "n_held_stable", "e.fallback")


_GIVEN = """gv AS (SELECT vec_id, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v, i FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def reflections(spark: SparkSession, sf: str, years: list[int], step: int) -> dict[int, np.ndarray]:
    """{year: reflection at the hyperplane of token vector year * step mod their number}."""
    n = A.count_of(spark, sf, "embeddings")
    rows = A.table(spark, sf, "embeddings").where(F.col("vec_id").isin([y * step % n for y in years])).select("vec_id", "embedding").collect()  # one a year
    v = {r[0]: np.array(r[1], dtype=float) / np.linalg.norm(np.array(r[1], dtype=float)) for r in rows}
    return {y: np.eye(len(u)) - 2 * np.outer(u, u) for y in years if (u := v.get(y * step % n)) is not None}


def years_of(df: DataFrame, year: str) -> list[int]:
    return [r[0] for r in df.select(year).distinct().orderBy(year).collect()]


_TURN = f"""SELECT p.investor_id, p.year, wt_overlap, investor_type, d, d - 2 * av3 * bv3 AS c3, d - 2 * av5 * bv5 AS c5 FROM
(SELECT a.investor_id, a.period AS year, sum(a.x * b.x) AS d, sum(a.x * g3.v) AS av3, sum(b.x * g3.v) AS bv3, sum(a.x * g5.v) AS av5, sum(b.x * g5.v) AS bv5 FROM pu a JOIN pu b ON a.investor_id = b.investor_id AND b.period = a.period + 1 AND a.i = b.i
JOIN gv g3 ON g3.vec_id = a.period * 3 % {A.N_VECTORS} AND g3.i = a.i JOIN gv g5 ON g5.vec_id = a.period * 5 % {A.N_VECTORS} AND g5.i = a.i GROUP BY ALL) p JOIN ov USING (investor_id, year) JOIN inv USING (investor_id)"""


@query(
    f"""WITH {_VEC}, {INVESTORS}, {_OV}, {_MEM}, {_GIVEN}, t AS ({_TURN}), e AS (SELECT p.investor_id, p.period AS year, i, x FROM pu p JOIN mem m ON m.investor_id = p.investor_id AND m.year = p.period WHERE t_strat),
g AS (SELECT a.year, a.i, b.i AS j, sum(a.x * b.x) AS g FROM e a JOIN e b ON a.investor_id = b.investor_id AND a.year = b.year GROUP BY ALL), r AS (SELECT year, sum(g) FILTER (i = j) ** 2 / sum(g * g) AS r FROM g GROUP BY year)
SELECT year, count(*) FILTER (held) AS n_held, round(avg(c3) FILTER (held), 6) AS cos_all, round(avg(c3) FILTER (held AND stable), 6) AS cos_stable, round(any_value(r), 4) AS eff_rank FROM t JOIN mem USING (investor_id, year) JOIN r USING (year) GROUP BY year"""
)
def held_out_given(spark: SparkSession, sf: str) -> DataFrame:
    """From the cube alone: mean cosine of the rows held out, under a given rotation, and the effective rank of the anchors that
    `stable_strat` has without them."""
    rows = FR.memberships(paired(spark, sf), "year", "investor_id", "investor_type", LEAST, STAYS)
    cells, _ = FR.cube(FR.few(rows), ["year", "mem", "held_out", "stable"])
    years = sorted({int(k[0]) for k in cells})
    turn, out = reflections(spark, sf, years, 3), []
    for y in years:
        held = FR.added(cells, lambda y1, _m, h, _s, y=y: y1 == y and h)
        steady = FR.added(cells, lambda y1, _m, h, s, y=y: y1 == y and h and s)
        train = FR.added(cells, lambda y1, m, _h, _s, y=y: y1 == y and m >> 5 & 1)
        near = [None if c is None else round(c, 6) for c in (FR.mean_cosine(turn[y], held), FR.mean_cosine(turn[y], steady))]
        out.append((y, held[0] if held else 0, *near, round(AL.effective_rank(train[1]), 4)))
    return spark.createDataFrame(out, "year int, n_held long, cos_all double, cos_stable double, eff_rank double")


@query(
    f"""WITH {_VEC}, {INVESTORS}, {_OV}, {_GIVEN}, t AS ({_TURN}) SELECT year, count(*) AS n, round(median(1 - c3), 5) AS med_third, round(median(1 - c5), 5) AS med_fifth, round(avg(1 - c3), 6) AS mean_third, round(avg(1 - c5), 6) AS mean_fifth FROM t GROUP BY year"""
)
def displacement_given(spark: SparkSession, sf: str) -> DataFrame:
    """Displacement of each step under two sets of given rotations, applied in one pass."""
    p = paired(spark, sf)
    years = years_of(p, "year")
    moved = FR.displaced(p, {name: {(y,): r for y, r in reflections(spark, sf, years, step).items()} for name, step in (("third", 3), ("fifth", 5))}, ["year"])
    g = moved.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"disp_{c}"), 6).alias(f"mean_{c}") for c in ("third", "fifth")])
    for c in ("third", "fifth"):
        g = g.join(stats.quantiles(moved, f"disp_{c}", [0.5], ["year"]).select("year", F.round(F.get("q", F.lit(0)), 5).alias(f"med_{c}")), "year")
    return g


def _posterior_sql(step: int) -> str:
    c = f"""cs{step} AS (SELECT investor_id, period, k, sum(x * m) - 2 * sum(x * v) * sum(m * v) AS c FROM pu JOIN mu USING (i) JOIN gv USING (i) WHERE vec_id = period * {step} % {A.N_VECTORS} GROUP BY ALL),
lg{step} AS (SELECT investor_id, period, k, 63 * (ln(1 - {RHO_FIXED} * {RHO_FIXED}) - ln(1 + {RHO_FIXED} * {RHO_FIXED} - 2 * {RHO_FIXED} * c)) AS l FROM cs{step})"""
    return c + f", fz{step} AS (SELECT investor_id, period, arg_max(k, (round(l, 9), -k))::INT AS label, max(l) + ln(sum(exp(l - m))) - ln({K_FIXED}) AS loglik FROM (SELECT *, max(l) OVER (PARTITION BY investor_id, period) AS m FROM lg{step}) GROUP BY ALL)"


@query(
    f"""WITH {_VEC}, {_MU}, {_GIVEN}, {_posterior_sql(3)}, {_posterior_sql(5)}, {_posterior_sql(11)}
SELECT period AS year, count(*) AS n, round(avg(a.loglik), 4) AS loglik_ref, round(avg((a.label = b.label)::INT), 6) AS agree_fifth, round(avg((a.label = c.label)::INT), 6) AS agree_eleventh FROM fz3 a JOIN fz5 b USING (investor_id, period) JOIN fz11 c USING (investor_id, period) GROUP BY period"""
)
def classifier_agreement_given(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed classifier's labels of vectors that were turned by three sets of given rotations, and how far they agree by year."""
    y = M.yearly(spark, sf).withColumnRenamed("period", "year")
    years = years_of(y, "year")
    panel = FR.labelled_in(y, "year", ["investor_id", "year"], {name: reflections(spark, sf, years, step) for name, step in (("third", 3), ("fifth", 5), ("eleventh", 11))}, fixed_mixture(spark, sf))
    g = FR.agreement(panel, "year", ["third", "fifth", "eleventh"])
    return g.select("year", "n", F.round("loglik_ref", 4).alias("loglik_ref"), F.round("agree_fifth", 6).alias("agree_fifth"), F.round("agree_eleventh", 6).alias("agree_eleventh"))


def fixed_mixture(spark: SparkSession, sf: str) -> SP.Mixture:
    return SP.Mixture(M.fixed_centres(spark, sf), np.full(K_FIXED, RHO_FIXED), np.full(K_FIXED, 1 / K_FIXED))


def ruled(spark: SparkSession, sf: str) -> tuple[dict, list[dict]]:
    return FR.by_rule(FR.memberships(clustered(spark, sf), "year", "investor_id", "stratum", LEAST, STAYS), "year", PERMUTED)


@query()
def alignment_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each step and anchor rule: anchors, fallback, effective rank, cosines of the rows held out, the null of anchors
    paired at random, and the median displacement of all under the rule's rotation."""
    rotations, rows = ruled(spark, sf)
    moved = stored(_displaced(spark, sf, rotations), "displaced")
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "year int, rule string, n_anchor long, fallback boolean, n_train long, n_held long, eff_rank double, cos_stable double, cos_all double, cos_null double")
    med = None
    for r in FR.RULES:
        q = stats.quantiles(moved, f"disp_{r}", [0.5], ["year"]).select("year", F.lit(r).alias("rule"), F.get("q", F.lit(0)).alias("median_disp"))
        med = q if med is None else med.unionByName(q)
    return table.join(med, ["year", "rule"], "left")


def _displaced(spark: SparkSession, sf: str, rotations: dict) -> DataFrame:
    by = {r: {(y,): m for (name, y), m in rotations.items() if name == r} for r in FR.RULES}
    return FR.displaced(paired(spark, sf).drop("investor_type"), by, ["year"])


@query()
def displacement_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Each investor's displacement in each step under the rotations of all rules, beside the turnover of holdings."""
    rotations, _ = ruled(spark, sf)
    moved = _displaced(spark, sf, rotations)
    return moved.select("investor_id", "year", (1 - F.col("wt_overlap")).alias("turnover"), *[f"disp_{r}" for r in FR.RULES])


def _aligned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Yearly vectors turned into the middle year's space by `stable_strat`, and the fixed classifier's labels of them."""
    rotations, _ = ruled(spark, sf)
    y = M.yearly(spark, sf).withColumnRenamed("period", "year")
    years = years_of(y, "year")
    into = AL.chain({t: m for (name, t), m in rotations.items() if name == "stable_strat"}, years[len(years) // 2], years)
    turned = cached(spark, ("turned", sf), lambda: AL.rotated(y, "embedding", into, "year", "turned").select("investor_id", "year", F.col("turned").alias("embedding")))
    return turned, FR.labelled_in(turned, "year", ["investor_id", "year"], {"fixed": {t: np.eye(len(m)) for t, m in into.items()}}, fixed_mixture(spark, sf))


def _refits(spark: SparkSession, sf: str, turned: DataFrame) -> dict:
    """{year: the best of RESTARTS free fits}, all years and starts in one job a round."""
    fits = SP.best_of(SP.fit_many(turned, "investor_id", [REFIT_K], RESTARTS, by="year", floor=REFIT_FLOOR, rounds=30), require_k=False)
    return {g: m for (g, _), (m, _) in fits.items() if m is not None}


@query()
def refit_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Mixtures fitted freely in each year, in the reference year's space, matched with the fixed classifier's centres and members."""
    turned, fixed = _aligned(spark, sf)
    fits = _refits(spark, sf, turned)
    both = DY.assigned_by(turned, "year", fits, ["investor_id", "year"], out="refit").join(fixed.select("investor_id", "year", F.col("label_fixed").alias("label")), ["investor_id", "year"])
    counts: dict = {}
    for r in both.groupBy("year", "refit", "label").count().collect():  # at most years x k x k rows
        counts.setdefault(r["year"], {})[r["refit"], r["label"]] = r["count"]
    rows = DY.refit_persistence(fits, fixed_mixture(spark, sf), counts)
    return spark.createDataFrame(rows, "year int, k int, ari double, least_cosine double, mean_cosine double, margin double, agreement double")


@query()
def refit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive free refits matched on shared investors, against the matching of their centres with the reference's."""
    turned, _ = _aligned(spark, sf)
    fits = _refits(spark, sf, turned)
    labels = stored(DY.assigned_by(turned, "year", fits, ["investor_id", "year"]), "refit-labels")
    counts: dict = {}
    for r in DY.label_steps(labels).groupBy("year", "label_from", "label_to").count().collect():  # at most years x k x k rows
        counts.setdefault((r["year"], r["year"] + 1), {})[r["label_from"], r["label_to"]] = r["count"]
    rows = DY.chain_check(fits, fixed_mixture(spark, sf), counts)
    return spark.createDataFrame(rows, "year_from int, year_to int, n_common int, ari_consecutive_refits double, membership_vs_centroid_agree double, composed_vs_centroid_agree double")


@query()
def classifier_in_reference_space(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all yearly vectors in the space of the middle year, by the rotations of each rule chained into it; agreement by year."""
    rotations, _ = ruled(spark, sf)
    y = M.yearly(spark, sf).withColumnRenamed("period", "year")
    years = years_of(y, "year")
    into = {r: AL.chain({t: m for (name, t), m in rotations.items() if name == r}, years[len(years) // 2], years) for r in ("stable_strat", "all", "stable_thr")}
    return FR.agreement(FR.labelled_in(y, "year", ["investor_id", "year"], into, fixed_mixture(spark, sf)), "year", list(into))


@query()
def displacement_turnover_test(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman's rho of turnover and rotated displacement in each step, for each rule, with interval, t statistic and p."""
    moved = cached(spark, ("displaced", sf), lambda: displacement_by_rule(spark, sf))
    long = moved.select("year", "turnover", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"disp_{r}").alias("disp")) for r in FR.RULES])).alias("d")).select("year", "turnover", "d.rule", "d.disp")
    return stats.with_p(stats.spearman(long, "turnover", "disp", ["rule", "year"]))


#: Steps of contrastive training, each over all books.
STEPS = 4


def _trained(spark: SparkSession, sf: str) -> list:
    """`rounds` over batches of the books that are trained on, and of the tenth that is held out."""
    rows = hash_split(C.halves_of(A.positions(spark, sf).where("n_assets_full >= 2"), KEYS, "issuer_id"), "book")
    train, held = (C.in_batches(rows.where(part).drop("is_train")) for part in ("is_train", "NOT is_train"))
    return list(C.rounds(train, A.token_vectors(spark, sf).withColumnRenamed("issuer_id", "token"), STEPS, held=held))


@query()
def contrastive_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of the books trained on before each step, and of the held-out tenth before all and after each."""
    rows = [(k, loss, held) for k, (_, loss, held) in enumerate(_trained(spark, sf))]
    return spark.createDataFrame(rows, "step int, train_loss double, held_out_loss double")


@query()
def contrastive_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Token vectors after contrastive training on both halves of each book."""
    *_, (tokens, _, _) = _trained(spark, sf)
    return tokens.select(F.col("token").alias("issuer_id"), F.col("vec").alias("embedding"))
