"""Queries over steps between years, assemblies and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.config import DynamicsConfig
from foliolens.functions import sequences as S
from foliolens.functions import stats
from foliolens.operators import align as AL
from foliolens.operators import dynamics as DY
from foliolens.operators import pooling as P
from foliolens.operators import sphere as SP
from foliolens.operators.assembly import all_of, assembled
from foliolens.plans import adapters as A
from foliolens.plans import model_queries as M
from foliolens.plans import panel_queries as PQ
from foliolens.plans.adapters import CORE, INVESTORS, KEYS, LABELS, POS, core_sql
from foliolens.plans.model_queries import _DISP, _LD, _MU, _OV, _VEC, K_FIXED
from foliolens.plans.registry import query
from foliolens.sources.durable import cached, stored

CONFIG = DynamicsConfig()
#: Common investors that a horizon needs; the reference's 200 are more than the test tables have.
LEAST_COMMON = 20

_FIXED = f"""{_VEC}, {_MU}, {_LD}, fe AS (SELECT investor_id, period, k, l, l - max(l) OVER (PARTITION BY investor_id, period) AS d FROM ld), fp AS (SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY investor_id, period) AS post FROM fe),
fx AS (SELECT investor_id, period AS year, arg_max(k, (round(post, 12), -k))::INT AS label, max(post) AS max_post FROM fp GROUP BY ALL)"""


def fixed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and posteriors of the fixed classifier: investor_id, year, label, max_post."""
    return cached(spark, ("fixed-labels", sf), lambda: M.mixture_posterior(spark, sf).select("investor_id", F.col("period").alias("year"), "label", "max_post"))


def fixed_steps(spark: SparkSession, sf: str) -> DataFrame:
    return DY.label_steps(fixed_labels(spark, sf)).join(M.overlaps(spark, sf), ["investor_id", "year"])


_WILSON = "(p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {} 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))"


@query(
    f"""WITH {_FIXED}, {_OV}, s AS (SELECT a.investor_id, a.year, a.label AS f, b.label AS t, (a.label <> b.label)::INT AS sw, a.max_post AS pa, b.max_post AS pb, wt_overlap
FROM fx a JOIN fx b ON a.investor_id = b.investor_id AND b.year = a.year + 1 JOIN ov ON ov.investor_id = a.investor_id AND ov.year = a.year),
r AS (SELECT year, 'all' AS subset, count(*) AS n, sum(sw)::BIGINT AS switches, avg(sw) AS p FROM s GROUP BY ALL
UNION ALL SELECT year, 'confident', count(*), sum(sw)::BIGINT, avg(sw) FROM s WHERE pa >= {CONFIG.confident} AND pb >= {CONFIG.confident} GROUP BY year
UNION ALL SELECT year, 'stayers', count(*), sum(sw)::BIGINT, avg(sw) FROM s WHERE wt_overlap >= {M.STAYS} GROUP BY year),
c AS (SELECT year, 1 - sum(coalesce(pf * pt, 0)) AS chance FROM (SELECT year, f AS l, count(*) / sum(count(*)) OVER (PARTITION BY year) AS pf FROM s GROUP BY year, f)
FULL JOIN (SELECT year, t AS l, count(*) / sum(count(*)) OVER (PARTITION BY year) AS pt FROM s GROUP BY year, t) USING (year, l) GROUP BY year)
SELECT year, subset, n, switches, round(p, 6) AS rate, round({_WILSON.format("-")}, 6) + 0.0 AS low, round({_WILSON.format("+")}, 6) AS high, round(chance, 6) + 0.0 AS chance FROM r JOIN c USING (year)"""
)
def fixed_classifier_rates(spark: SparkSession, sf: str) -> DataFrame:
    sure = (F.col("max_post_from") >= CONFIG.confident) & (F.col("max_post_to") >= CONFIG.confident)
    r = DY.switch_rates(fixed_steps(spark, sf), {"confident": sure, "stayers": F.col("wt_overlap") >= M.STAYS})
    return r.select("year", "subset", "n", "switches", F.round("rate", 6).alias("rate"), (F.round("low", 6) + F.lit(0.0)).alias("low"), F.round("high", 6).alias("high"), (F.round("chance", 6) + F.lit(0.0)).alias("chance"))


@query(
    f"""WITH {CORE}, {LABELS}, p AS (SELECT b.year - a.year AS h, a.year AS year0, a.label AS f, b.label AS t FROM lab a JOIN lab b ON a.investor_id = b.investor_id AND b.year BETWEEN a.year + 1 AND a.year + {CONFIG.horizons}),
g AS (SELECT h, year0, count(*) AS n, avg((f = t)::INT) AS same FROM p GROUP BY ALL HAVING count(*) >= {LEAST_COMMON}),
c AS (SELECT h, year0, sum(coalesce(pf * pt, 0)) AS chance FROM (SELECT h, year0, f AS l, count(*) / sum(count(*)) OVER (PARTITION BY h, year0) AS pf FROM p GROUP BY h, year0, f)
FULL JOIN (SELECT h, year0, t AS l, count(*) / sum(count(*)) OVER (PARTITION BY h, year0) AS pt FROM p GROUP BY h, year0, t) USING (h, year0, l) GROUP BY h, year0)
SELECT h::INT AS h, year0, n, round(same, 6) AS same, round(chance, 6) AS chance FROM g JOIN c USING (h, year0)"""
)
def persistence_by_year(spark: SparkSession, sf: str) -> DataFrame:
    p = DY.persistence(A.labels(spark, sf), horizons=CONFIG.horizons, least=LEAST_COMMON)
    return p.select("h", "year0", "n", F.round("same", 6).alias("same"), F.round("chance", 6).alias("chance"))


_POOLED = f"""{_VEC}, {_OV}, {_DISP}, mv2 AS (SELECT investor_id, year, 1 - wt_overlap AS turnover, disp FROM ov JOIN dsp USING (investor_id, year)),
b AS (SELECT 'all' AS subset, * FROM mv2 UNION ALL SELECT 'movers', * FROM mv2 WHERE turnover > {1 - M.STAYS}),
k AS (SELECT subset, rank() OVER (PARTITION BY subset ORDER BY turnover) + (count(*) OVER (PARTITION BY subset, turnover) - 1) / 2.0 AS a, rank() OVER (PARTITION BY subset ORDER BY disp) + (count(*) OVER (PARTITION BY subset, disp) - 1) / 2.0 AS b FROM b),
s AS (SELECT subset, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY ALL)"""


@query(f"WITH {_POOLED} SELECT subset, n, round(rho, 4) AS rho, round(tanh(atanh(rho) - 1.96 * sqrt(1.06 / (n - 3))), 4) AS low, round(tanh(atanh(rho) + 1.96 * sqrt(1.06 / (n - 3))), 4) AS high FROM s")
def spearman_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Turnover against displacement over all years, for all investors and for movers only."""
    m = M.moves(spark, sf).withColumn("subset", F.explode(F.when(F.col("turnover") > 1 - M.STAYS, F.array(F.lit("all"), F.lit("movers"))).otherwise(F.array(F.lit("all")))))
    return stats.spearman(m, "turnover", "disp", ["subset"]).select("subset", "n", *[F.round(c, 4).alias(c) for c in ("rho", "low", "high")])


@query(
    f"""WITH {core_sql("quarter")}, o AS (SELECT DISTINCT investor_id, period, quarter(period) IN (2, 4) AS hi FROM core), cal AS (SELECT DISTINCT period, hi FROM o),
sp AS (SELECT investor_id, min(period) AS first, max(period) AS last, count(*) FILTER (hi) AS oh, count(*) FILTER (NOT hi) AS ol FROM o GROUP BY ALL),
e AS (SELECT sp.investor_id, any_value(oh) AS oh, any_value(ol) AS ol, count(*) FILTER (hi) AS eh, count(*) FILTER (NOT hi) AS el FROM sp JOIN cal ON period BETWEEN first AND last GROUP BY ALL),
c AS (SELECT investor_id, CASE WHEN eh >= 3 AND el >= 3 AND oh >= 0.5 * eh AND ol < 0.2 * el THEN 'semiannual' ELSE 'other' END AS grp FROM e),
n AS (SELECT period, hi, grp, count(*) AS n FROM o JOIN c USING (investor_id) GROUP BY ALL), m AS (SELECT grp, coalesce(avg(n) FILTER (hi), 0) AS hi, coalesce(avg(n) FILTER (NOT hi), 0) AS lo FROM n GROUP BY grp)
SELECT grp, round(hi, 4) AS hi, round(lo, 4) AS lo, round(hi - lo, 4) AS gap, round(100 * (hi - lo) / (sum(hi) OVER () - sum(lo) OVER ()), 4) AS share_of_excess FROM m"""
)
def excess_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the excess of reporters at half-year ends is due to those who skip the other quarters."""
    p = A.panel(spark, sf, "quarter").select("investor_id", "period").distinct()
    cycle = PQ.reporting_classes(p, p.select("period").distinct()).select("investor_id", F.when(F.col("cycle") == "semiannual_hi", "semiannual").otherwise("other").alias("grp"))
    n = p.join(cycle, "investor_id").groupBy("period", "grp").agg(F.count(F.lit(1)).alias("n"))
    high = F.quarter("period").isin(2, 4)
    m = n.groupBy("grp").agg(F.coalesce(F.avg(F.when(high, F.col("n"))), F.lit(0.0)).alias("hi"), F.coalesce(F.avg(F.when(~high, F.col("n"))), F.lit(0.0)).alias("lo"))
    total = m.agg((F.sum("hi") - F.sum("lo")).alias("excess"))  # two groups
    gap = F.col("hi") - F.col("lo")
    return m.join(F.broadcast(total), F.lit(True)).select("grp", F.round("hi", 4).alias("hi"), F.round("lo", 4).alias("lo"), F.round(gap, 4).alias("gap"), F.round(F.try_divide(100 * gap, F.col("excess")), 4).alias("share_of_excess"))


@query("SELECT DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH)::DATE AS quarter_end FROM orders")
def quarter_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter labels written and read back."""
    label = A.table(spark, sf, "orders").select(S.quarter_label(F.col("o_orderdate").cast("date")).alias("label")).distinct()
    return label.select("label", S.quarter_end_of(F.col("label")).alias("quarter_end"))


@query("SELECT round_even(l_quantity::DOUBLE / 4, 0) AS q, round(round_even(sum(l_quantity::DOUBLE) / 8, 1), 1) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def half_even_rounding(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))
    return rows.groupBy(stats.half_even(F.col("x") / 4).alias("q")).agg(stats.half_even(F.sum("x") / 8, 1).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {POS}, {INVESTORS}, s AS (SELECT investor_id, count(DISTINCT period) AS n_years, count(*) AS n_positions FROM pos GROUP BY ALL)
SELECT inv.investor_id, investor_type, n_years, n_positions FROM s RIGHT JOIN inv ON s.investor_id = inv.investor_id"""
)
def all_investors_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every investor, those without holdings too."""
    s = A.positions(spark, sf).groupBy("investor_id").agg(F.count_distinct("period").alias("n_years"), F.count(F.lit(1)).alias("n_positions"))
    return all_of(A.investors(spark, sf).select("investor_id", "investor_type"), s, "investor_id").select("investor_id", "investor_type", "n_years", "n_positions")


@query(
    f"""WITH {POS}, {INVESTORS}, {LABELS}, {_OV}, d1 AS (SELECT investor_id, count(DISTINCT period) AS n FROM pos GROUP BY ALL), d2 AS (SELECT investor_id, max(w) AS top FROM pos GROUP BY ALL),
d3 AS (SELECT investor_id, count(*) AS n_2 FROM lab GROUP BY ALL), d4 AS (SELECT investor_id, avg(wt_overlap) AS overlap FROM ov GROUP BY ALL), d5 AS (SELECT investor_id, arg_max(label, year) AS last_label FROM lab GROUP BY ALL),
d6 AS (SELECT investor_id, sum(mv) AS total FROM pos GROUP BY ALL), d7 AS (SELECT investor_id, count(DISTINCT issuer_id) AS issuers FROM pos GROUP BY ALL)
SELECT inv.investor_id, investor_type, domicile, d1.n, round(top, 8) AS top, n_2 AS n_labels, round(overlap, 6) AS overlap, last_label, round(total) AS total, issuers
FROM inv LEFT JOIN d1 USING (investor_id) LEFT JOIN d2 USING (investor_id) LEFT JOIN d3 USING (investor_id) LEFT JOIN d4 USING (investor_id) LEFT JOIN d5 USING (investor_id) LEFT JOIN d6 USING (investor_id) LEFT JOIN d7 USING (investor_id)"""
)
def investor_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each investor from many dimensions; `n` collides and gets its dimension's name."""
    pos, lab = A.positions(spark, sf), A.labels(spark, sf)
    by = lambda df, *aggs: df.groupBy("investor_id").agg(*aggs)
    dims = {
        "years": by(pos, F.count_distinct("period").alias("n")),
        "top": by(pos, F.max("w").alias("top")),
        "labels": by(lab, F.count(F.lit(1)).alias("n")),
        "overlap": by(M.overlaps(spark, sf), F.avg("wt_overlap").alias("overlap")),
        "last": by(lab, F.max_by("label", "year").alias("last_label")),
        "value": by(pos, F.sum("mv").alias("total")),
        "breadth": by(pos, F.count_distinct("issuer_id").alias("issuers")),
    }
    out = assembled(A.investors(spark, sf).select("investor_id", "investor_type", "domicile"), dims, "investor_id")
    return out.select("investor_id", "investor_type", "domicile", "n", F.round("top", 8).alias("top"), "n_labels", F.round("overlap", 6).alias("overlap"), "last_label", F.round("total").alias("total"), "issuers")


@query(
    f"""WITH {CORE}, h AS (SELECT issuer_id, count(DISTINCT investor_id) AS n FROM core GROUP BY ALL), t AS (SELECT 'top' AS part, issuer_id, n FROM h ORDER BY n DESC, issuer_id LIMIT 10), b AS (SELECT 'bottom' AS part, issuer_id, n FROM h ORDER BY n, issuer_id LIMIT 10)
SELECT * FROM (SELECT * FROM t UNION ALL SELECT * FROM b) ORDER BY part DESC, n DESC, issuer_id"""
)
def most_and_least_held(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most and the ten least held issuers, in order."""
    h = A.panel(spark, sf).groupBy("issuer_id").agg(F.count_distinct("investor_id").alias("n"))
    top = h.orderBy(F.col("n").desc(), "issuer_id").limit(10).select(F.lit("top").alias("part"), "issuer_id", "n")
    bottom = h.orderBy("n", "issuer_id").limit(10).select(F.lit("bottom").alias("part"), "issuer_id", "n")
    return top.unionByName(bottom).orderBy(F.col("part").desc(), F.col("n").desc(), "issuer_id")


@query(
    f"""WITH {POS}, b AS (SELECT investor_id, period, count(*) FILTER (chunk_id = 1) AS first_chunk, count(*) FILTER (rank <= 62) AS top FROM pos GROUP BY ALL)
SELECT period, count(*) AS n, count(*) FILTER (first_chunk < top) AS shorter, round(median(first_chunk), 4) AS med_first_chunk, round(median(top), 4) AS med_top FROM b GROUP BY ALL"""
)
def chunk_against_top(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a book's top positions its first chunk holds."""
    b = A.positions(spark, sf).groupBy(*KEYS).agg(F.count(F.when(F.col("chunk_id") == 1, 1)).alias("first_chunk"), F.count(F.when(F.col("rank") <= 62, 1)).alias("top"))
    g = b.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("first_chunk") < F.col("top"), 1)).alias("shorter"))
    for c, name in (("first_chunk", "med_first_chunk"), ("top", "med_top")):
        g = g.join(stats.quantiles(b, c, [0.5], ["period"]).select("period", F.round(F.get("q", F.lit(0)), 4).alias(name)), "period")
    return g


@query()
def noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Displacement and switching between two vector sets of the same holdings, which retraining alone would show; the
    unweighted vectors of the last year stand in for a second model's."""
    y = M.yearly(spark, sf)
    last = y.agg(F.max("period")).first()[0]
    other = P.pooled_tokens(A.slices(spark, sf).where(F.col("period") == last), A.token_vectors(spark, sf), KEYS)
    first = y.where(F.col("period") == last)
    _, d = AL.noise_floor(first, other, "investor_id")
    q = stats.quantiles(stored(d, "noise"), "displacement", [0.25, 0.5, 0.75, 0.9])
    return q.select(F.lit(last).alias("year"), *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("q25", "median", "q75", "p90"))])


@query(
    f"""WITH {POS}, b AS (SELECT DISTINCT investor_id, period, n_assets_full AS n FROM pos)
SELECT period, count(*) AS books, round(quantile_cont(n, 0.25), 4) AS q25, round(median(n), 4) AS med, round(quantile_cont(n, 0.75), 4) AS q75, round(avg(n), 4) AS mean FROM b GROUP BY ALL"""
)
def ribbon_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """A figure's ribbon: quartiles of book sizes over time."""
    b = A.positions(spark, sf).where("rank = 1").select(*KEYS, F.col("n_assets_full").alias("n"))
    q = stats.quantiles(b, "n", [0.25, 0.5, 0.75], ["period"])
    g = b.groupBy("period").agg(F.count(F.lit(1)).alias("books"), F.round(F.avg("n"), 4).alias("mean")).join(q, "period")
    return g.select("period", "books", *[F.round(F.get("q", F.lit(k)), 4).alias(c) for k, c in enumerate(("q25", "med", "q75"))], "mean")


#: Overlaps at which the share of stable investors is counted.
THRESHOLDS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.85)


@query(
    f"""WITH {POS}, {INVESTORS}, {_OV}, t AS (SELECT unnest([{", ".join(map(str, THRESHOLDS))}])::DOUBLE AS threshold)
SELECT investor_type, threshold, count(*) AS n, count(*) FILTER (wt_overlap >= threshold) AS stable FROM ov JOIN inv USING (investor_id), t GROUP BY ALL"""
)
def stability_at_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Investors of each type whose overlap reaches several thresholds, in one pass."""
    o = M.overlaps(spark, sf).join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
    reached = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count(F.when(F.col("wt_overlap") >= t, 1)).alias("stable")) for t in THRESHOLDS])
    g = o.groupBy("investor_type").agg(F.count(F.lit(1)).alias("n"), reached.alias("r"))
    return g.select("investor_type", "n", F.explode("r").alias("r")).select("investor_type", "r.threshold", "n", "r.stable")


@query(
    f"""WITH {_FIXED}, l AS (SELECT investor_id, period AS year, max(l) + ln(sum(exp(d))) - ln({K_FIXED}) AS loglik FROM fe GROUP BY ALL)
SELECT year, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS share, round(avg(max_post), 5) AS mean_post, round(avg(loglik), 4) AS mean_loglik FROM fx JOIN l USING (investor_id, year) GROUP BY year, label"""
)
def fixed_classifier_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Size, mean posterior and mean log-likelihood of each component of the fixed classifier in each year."""
    x = M.mixture_posterior(spark, sf).withColumnRenamed("period", "year")
    g = x.groupBy("year", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("max_post"), 5).alias("mean_post"), F.round(F.avg("loglik"), 4).alias("mean_loglik"))
    total = F.sum("n").over(M.Window.partitionBy("year"))  # a row for each component
    return g.select("year", "label", "n", F.round(F.col("n") / total, 6).alias("share"), "mean_post", "mean_loglik")


@query(
    f"""WITH {_FIXED}, s AS (SELECT a.year, a.label AS f, b.label AS t FROM fx a JOIN fx b ON a.investor_id = b.investor_id AND b.year = a.year + 1)
SELECT year, f AS label, count(*) AS n, count(*) FILTER (f = t) AS stayed, round(count(*) FILTER (f = t) / count(*), 6) AS retention FROM s GROUP BY ALL"""
)
def retention_by_component(spark: SparkSession, sf: str) -> DataFrame:
    s = DY.label_steps(fixed_labels(spark, sf))
    g = s.groupBy("year", F.col("label_from").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("sw") == 0, 1)).alias("stayed"))
    return g.withColumn("retention", F.round(F.col("stayed") / F.col("n"), 6))


@query(
    f"""WITH {CORE}, p AS (SELECT p_partkey::VARCHAR AS issuer_id FROM part WHERE p_size > 5)
SELECT issuer_id, count(DISTINCT investor_id) AS n_holders, max(period) AS last_period, round(sum(mv), 0) AS mv FROM core WHERE issuer_id NOT IN (SELECT issuer_id FROM p) GROUP BY ALL"""
)
def unresolved_issuers(spark: SparkSession, sf: str) -> DataFrame:
    """Held issuers that a reference table lacks, with what depends on them."""
    known = A.table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("issuer_id"))
    lost = A.panel(spark, sf).join(known, "issuer_id", "left_anti")
    return lost.groupBy("issuer_id").agg(F.count_distinct("investor_id").alias("n_holders"), F.max("period").alias("last_period"), F.round(F.sum("mv"), 0).alias("mv"))
