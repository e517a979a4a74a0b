"""Queries over vectors, statistics, alignment, mixtures and dynamics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.functions import stats
from foliolens.functions import vectors as V
from foliolens.operators import align as AL
from foliolens.operators import frames as FR
from foliolens.operators import pooling as P
from foliolens.operators import sphere as SP
from foliolens.operators.dynamics import label_steps
from foliolens.plans import adapters as A
from foliolens.plans.adapters import CORE, INVESTORS, KEYS, LABELS, POS
from foliolens.plans.registry import query
from foliolens.sources.durable import cached, stored

K_FIXED, RHO_FIXED, PAIRS = 8, 0.5, 1_000_000
#: Overlap of a stable investor in the queries: no investor of the test tables reaches the operators' 0.85.
STAYS = 0.2
#: Permutations of the alignment's null.
PERMUTED = 20

_TOK = "tok AS (SELECT vec_id::VARCHAR AS issuer_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_VEC = f"""{POS}, {_TOK}, pv AS (SELECT investor_id, period, i, sum(pw * e) AS s FROM top JOIN tok USING (issuer_id) GROUP BY ALL),
pu AS (SELECT investor_id, period, i, s / sqrt(sum(s * s) OVER (PARTITION BY investor_id, period)) AS x FROM pv)"""
_OV = """ov AS (SELECT a.investor_id, a.period AS year, sum(CASE WHEN b.pw IS NULL THEN 0 ELSE least(a.pw, b.pw) END) AS wt_overlap FROM top a JOIN (SELECT DISTINCT investor_id, period FROM top) k ON k.investor_id = a.investor_id AND k.period = a.period + 1
LEFT JOIN top b ON b.investor_id = a.investor_id AND b.issuer_id = a.issuer_id AND b.period = a.period + 1 GROUP BY ALL)"""
_DISP = "dsp AS (SELECT a.investor_id, a.period AS year, 1 - sum(a.x * b.x) AS disp FROM pu a JOIN pu b ON a.investor_id = b.investor_id AND b.period = a.period + 1 AND a.i = b.i GROUP BY ALL)"
_STEPS = f"{LABELS}, steps AS (SELECT a.investor_id, a.year, a.label AS f, b.label AS t, (a.label <> b.label)::INT AS sw FROM lab a JOIN lab b ON a.investor_id = b.investor_id AND b.year = a.year + 1)"
_MU = f"mu AS (SELECT vec_id AS k, unnest(embedding)::DOUBLE AS m, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < {K_FIXED})"
_LD = f"""ld AS (SELECT investor_id, period, k, 63 * (ln(1 - {RHO_FIXED} * {RHO_FIXED}) - ln(1 + {RHO_FIXED} * {RHO_FIXED} - 2 * {RHO_FIXED} * sum(x * m))) AS l FROM pu JOIN mu USING (i) GROUP BY ALL)"""


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """One unit vector for each investor and year, by weighted pooling."""
    return cached(spark, ("yearly", sf), lambda: P.pooled_tokens(A.slices(spark, sf), A.token_vectors(spark, sf), KEYS, weight="pw"))


def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return AL.overlap_with_next(A.slices(spark, sf).withColumnRenamed("period", "year"), "investor_id", "issuer_id", "year", "pw")


def year_pairs(spark: SparkSession, sf: str) -> DataFrame:
    y = yearly(spark, sf)
    a = y.select("investor_id", F.col("period").alias("year"), F.col("embedding").alias("a"))
    b = y.select("investor_id", (F.col("period") - 1).alias("year"), F.col("embedding").alias("b"))
    return a.join(b, ["investor_id", "year"])


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """Per investor and step: overlap, turnover, displacement without rotation."""

    def make() -> DataFrame:
        d = year_pairs(spark, sf).select("investor_id", "year", (1 - V.dot(F.col("a"), F.col("b"))).alias("disp"))
        return d.join(overlaps(spark, sf), ["investor_id", "year"]).withColumn("turnover", 1 - F.col("wt_overlap"))

    return cached(spark, ("moves", sf), make)


def steps(spark: SparkSession, sf: str) -> DataFrame:
    a = A.labels(spark, sf).withColumnRenamed("label", "f")
    b = A.labels(spark, sf).select("investor_id", (F.col("year") - 1).alias("year"), F.col("label").alias("t"))
    return a.join(b, ["investor_id", "year"]).withColumn("sw", (F.col("f") != F.col("t")).cast("int"))


def fixed_centres(spark: SparkSession, sf: str) -> np.ndarray:
    rows = A.table(spark, sf, "embeddings").where(F.col("vec_id") < K_FIXED).orderBy("vec_id").select("embedding").collect()
    return np.array([r[0] for r in rows], dtype=float)


def _long(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*KEYS, F.posexplode("embedding").alias("p", "x")).select(*KEYS, (F.col("p") + 1).cast("int").alias("i"), (F.round("x", digits) + F.lit(0.0)).alias("x"))


@query(f"WITH {_VEC} SELECT investor_id, period, i::INT AS i, round(x, 4) + 0.0 AS x FROM pu")
def weighted_pooling(spark: SparkSession, sf: str) -> DataFrame:
    return _long(yearly(spark, sf))


@query(
    f"""WITH {POS}, {_TOK}, mv AS (SELECT investor_id, period, i, sum(e) AS s FROM top JOIN tok USING (issuer_id) GROUP BY ALL)
SELECT investor_id, period, i::INT AS i, round(s / sqrt(sum(s * s) OVER (PARTITION BY investor_id, period)), 4) + 0.0 AS x FROM mv"""
)
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    return _long(P.pooled_tokens(A.slices(spark, sf), A.token_vectors(spark, sf), KEYS))


@query(
    f"""WITH {POS}, {_TOK}, c AS (SELECT investor_id, period, chunk_id, i, avg(e) AS m FROM pos JOIN tok USING (issuer_id) GROUP BY ALL),
q AS (SELECT investor_id, period, chunk_id, sum(w) AS mass FROM pos GROUP BY ALL), s AS (SELECT investor_id, period, i, sum(m * mass) AS s FROM c JOIN q USING (investor_id, period, chunk_id) GROUP BY ALL)
SELECT investor_id, period, i::INT AS i, round(s / sqrt(sum(s * s) OVER (PARTITION BY investor_id, period)), 4) + 0.0 AS x FROM s"""
)
def all_chunks_pooling(spark: SparkSession, sf: str) -> DataFrame:
    return _long(P.pooled_tokens(A.positions(spark, sf), A.token_vectors(spark, sf), KEYS, weight="w", chunk="chunk_id"))


@query(f"WITH {_VEC}, {_DISP} SELECT investor_id, year, round(1 - disp, 6) AS cos FROM dsp")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return year_pairs(spark, sf).select("investor_id", "year", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cos"))


@query(
    """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT a.vec_id AS q, a.label AS lq, b.vec_id AS n, b.label AS ln, sum(a.x * b.x) AS c FROM v a JOIN v b USING (i) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 12) DESC, n) AS nth FROM s),
h AS (SELECT m, q, lq, avg((lq = ln)::INT) AS share FROM t, (VALUES (10), (50)) v(m) WHERE nth <= m GROUP BY ALL), base AS (SELECT sum(p * p) AS b FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label))
SELECT m, lq AS label, count(*) AS n, round(avg(share), 6) AS homogeneity, round(avg(share) / any_value(b), 6) AS lift FROM h, base GROUP BY m, lq"""
)
def knn_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    found = P.nearest(e.where("vec_id % 20 = 0"), e, 50)
    lab = e.select("vec_id", "label")
    rows = found.join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("lq")), "query").join(lab.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("ln")), "neighbour")
    rows = rows.withColumn("m", F.explode(F.when(F.col("nth") <= 10, F.array(F.lit(10), F.lit(50))).otherwise(F.array(F.lit(50)))))
    share = rows.groupBy("m", "query", "lq").agg(F.avg((F.col("lq") == F.col("ln")).cast("int")).alias("share"))
    p = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    base = p.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("b"))
    out = share.groupBy("m", F.col("lq").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("h")).join(F.broadcast(base), F.lit(True))
    return out.select("m", "label", "n", F.round("h", 6).alias("homogeneity"), F.round(F.col("h") / F.col("b"), 6).alias("lift"))


@query(
    f"""WITH {POS}, {_TOK}, hv AS (SELECT investor_id, period, rank % 2 AS half, i, sum(w * e) AS s FROM pos JOIN tok USING (issuer_id) WHERE rank <= 124 AND n_assets_full >= 2 GROUP BY ALL),
hu AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY investor_id, period, half)) AS x FROM hv),
bk AS (SELECT period, investor_id, ('0x' || substr(md5(investor_id), 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY period) / 64.0)::BIGINT AS batch FROM hu WHERE half = 1 AND i = 1),
hb AS (SELECT * FROM hu JOIN bk USING (period, investor_id)),
sc AS (SELECT a.period, a.batch, a.investor_id AS p, b.investor_id AS q, exp(20 * sum(a.x * b.x) - 20) AS z FROM hb a JOIN hb b ON a.period = b.period AND a.batch = b.batch AND a.i = b.i WHERE a.half = 1 AND b.half = 0 GROUP BY ALL),
l AS (SELECT period, p AS r, ln(sum(z)) - ln(max(z) FILTER (p = q)) AS l FROM sc GROUP BY ALL UNION ALL SELECT period, q, ln(sum(z)) - ln(max(z) FILTER (p = q)) FROM sc GROUP BY period, q)
SELECT period, round(avg(l), 6) AS loss, (count(*) / 2)::BIGINT AS n FROM l GROUP BY period"""
)
def infonce_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.positions(spark, sf).where("rank <= 124 AND n_assets_full >= 2").withColumn("half", F.col("rank") % 2)
    each = P.half_losses(rows, A.token_vectors(spark, sf), "period", "investor_id")
    return each.select("period", F.round("loss", 6).alias("loss"), "n")


@query(f"WITH {POS}, {_OV} SELECT investor_id, year, round(wt_overlap, 6) AS wt_overlap FROM ov")
def wt_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(spark, sf).select("investor_id", "year", F.round("wt_overlap", 6).alias("wt_overlap"))


@query(
    f"""WITH {POS}, {INVESTORS}, {_OV}, o AS (SELECT ov.*, investor_type FROM ov JOIN inv USING (investor_id)),
r AS (SELECT year, 'all' AS rule, count(*) AS n FROM o GROUP BY ALL
UNION ALL SELECT year, 'stable_thr', count(*) FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY wt_overlap DESC, investor_id) AS nth, count(*) FILTER (wt_overlap >= {STAYS}) OVER (PARTITION BY year) AS ok FROM o) WHERE CASE WHEN ok >= 20 THEN wt_overlap >= {STAYS} ELSE nth <= 20 END GROUP BY ALL
UNION ALL SELECT year, 'stable_strat', count(*) FROM (SELECT *, quantile_cont(wt_overlap, 0.75) OVER (PARTITION BY year, investor_type) AS q FROM o) WHERE wt_overlap >= q GROUP BY ALL)
SELECT * FROM r"""
)
def anchor_rules(spark: SparkSession, sf: str) -> DataFrame:
    o = overlaps(spark, sf).join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
    out = None
    for rule in ("all", "stable_thr", "stable_strat"):
        n = AL.anchors(o, rule, "year", "investor_id", "investor_type", least=20, at=STAYS).groupBy("year").agg(F.count(F.lit(1)).alias("n")).select("year", F.lit(rule).alias("rule"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    f"""WITH {POS}, {INVESTORS}, {_OV} SELECT investor_type, count(*) AS n, round(quantile_cont(wt_overlap, 0.25), 6) AS q1, round(median(wt_overlap), 6) AS med, round(quantile_cont(wt_overlap, 0.75), 6) AS q3,
round(100.0 * count(*) FILTER (wt_overlap >= {STAYS}) / count(*), 4) AS pct_stayers FROM ov JOIN inv USING (investor_id) GROUP BY ALL"""
)
def stability_by_group(spark: SparkSession, sf: str) -> DataFrame:
    o = overlaps(spark, sf).join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
    q = stats.quantiles(o, "wt_overlap", [0.25, 0.5, 0.75], ["investor_type"])
    g = o.groupBy("investor_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("wt_overlap") >= STAYS, 1.0).otherwise(0.0)).alias("s")).join(q, "investor_type")
    return g.select("investor_type", "n", *[F.round(F.get("q", i), 6).alias(c) for i, c in enumerate(("q1", "med", "q3"))], F.round(100.0 * F.col("s"), 4).alias("pct_stayers"))


@query(
    f"""WITH {CORE}, {_STEPS}, k AS (SELECT DISTINCT label FROM lab), n AS (SELECT f, t, count(*) AS n FROM steps GROUP BY ALL)
SELECT a.label AS from_label, b.label AS to_label, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.label), 6) AS share FROM k a CROSS JOIN k b LEFT JOIN n ON f = a.label AND t = b.label"""
)
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    n = steps(spark, sf).groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    k = A.labels(spark, sf).select("label").distinct()
    ks = k.agg(F.collect_set("label").alias("ks"))  # as many as there are labels
    grid = k.select(F.col("label").alias("f")).join(F.broadcast(ks), F.lit(True)).select("f", F.explode("ks").alias("t"))
    rows = grid.join(n, ["f", "t"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("f")))
    return rows.select(F.col("f").alias("from_label"), F.col("t").alias("to_label"), "n", F.round(share, 6).alias("share"))


def _rates_sql(where: str, name: str) -> str:
    return f"""SELECT year, '{name}' AS subset, count(*) AS n, sum(sw)::BIGINT AS switches, sum(sw) / count(*) AS p FROM s WHERE {where} GROUP BY ALL"""


@query(
    f"""WITH {POS}, {_OV}, {_STEPS}, s AS (SELECT * FROM steps JOIN ov USING (investor_id, year)), r AS ({_rates_sql("true", "all")} UNION ALL {_rates_sql(f"wt_overlap >= {STAYS}", "stayers")}),
c AS (SELECT year, 1 - sum(pf * pt) AS chance FROM (SELECT year, f AS l, count(*) / sum(count(*)) OVER (PARTITION BY year) AS pf FROM s GROUP BY year, f) JOIN (SELECT year, t AS l, count(*) / sum(count(*)) OVER (PARTITION BY year) AS pt FROM s GROUP BY year, t) USING (year, l) GROUP BY year)
SELECT year, subset, n, switches, round(p, 6) AS rate, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)), 6) + 0.0 AS low,
round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)), 6) AS high, round(chance, 6) AS chance FROM r JOIN c USING (year)"""
)
def switch_rates(spark: SparkSession, sf: str) -> DataFrame:
    s = steps(spark, sf).join(overlaps(spark, sf), ["investor_id", "year"])
    two = s.select("year", "sw", F.explode(F.when(F.col("wt_overlap") >= STAYS, F.array(F.lit("all"), F.lit("stayers"))).otherwise(F.array(F.lit("all")))).alias("subset"))
    r = two.groupBy("year", "subset").agg(F.count(F.lit(1)).alias("n"), F.sum("sw").alias("switches"))
    by = Window.partitionBy("year")
    margin = lambda c, p: s.groupBy("year", F.col(c).alias("l")).agg(F.count(F.lit(1)).alias("k")).select("year", "l", (F.col("k") / F.sum("k").over(by)).alias(p))
    chance = margin("f", "pf").join(margin("t", "pt"), ["year", "l"]).groupBy("year").agg((1 - F.sum(F.col("pf") * F.col("pt"))).alias("chance"))
    low, high = stats.wilson(F.col("switches"), F.col("n"))
    return r.join(chance, "year").select("year", "subset", "n", "switches", F.round(F.col("switches") / F.col("n"), 6).alias("rate"), (F.round(low, 6) + F.lit(0.0)).alias("low"), F.round(high, 6).alias("high"), F.round("chance", 6).alias("chance"))


@query(
    f"""WITH {CORE}, {LABELS}, p AS (SELECT b.year - a.year AS h, a.label AS f, b.label AS t FROM lab a JOIN lab b ON a.investor_id = b.investor_id AND b.year > a.year)
SELECT h::INT AS h, count(*) AS n, round(avg((f = t)::INT), 6) AS same FROM p GROUP BY h HAVING count(*) >= 50"""
)
def persistence_decay(spark: SparkSession, sf: str) -> DataFrame:
    seq = A.labels(spark, sf).groupBy("investor_id").agg(F.collect_list(F.struct("year", "label")).alias("s"))  # at most one entry a year
    pairs = seq.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("b.year > a.year")
    g = pairs.groupBy((F.col("b.year") - F.col("a.year")).cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a.label") == F.col("b.label")).cast("int")).alias("same"))
    return g.where("n >= 50").select("h", "n", F.round("same", 6).alias("same"))


@query(
    f"""WITH {CORE}, {_STEPS}, c AS (SELECT year, f, t, count(*)::DOUBLE AS n FROM steps GROUP BY ALL), a AS (SELECT year, sum(n * (n - 1) / 2) AS x FROM (SELECT year, f, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
b AS (SELECT year, sum(n * (n - 1) / 2) AS x FROM (SELECT year, t, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), w AS (SELECT year, sum(n) AS n, sum(n * (n - 1) / 2) AS x FROM c GROUP BY ALL)
SELECT year, w.n::BIGINT AS n, round((w.x - a.x * b.x / (w.n * (w.n - 1) / 2)) / ((a.x + b.x) / 2 - a.x * b.x / (w.n * (w.n - 1) / 2)), 6) AS ari FROM w JOIN a USING (year) JOIN b USING (year)"""
)
def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return stats.adjusted_rand(steps(spark, sf), "f", "t", ["year"]).select("year", "n", F.round("ari", 6).alias("ari"))


@query(
    f"""WITH {CORE}, {_STEPS}, r AS (SELECT f AS label, count(*) AS n, sum(sw) / count(*) AS p FROM steps GROUP BY ALL)
SELECT label, n, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)), 6) AS low,
round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)), 6) AS high FROM r"""
)
def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    g = steps(spark, sf).groupBy(F.col("f").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("sw").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("label", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_MOVES = f"{_VEC}, {_OV}, {_DISP}, mv2 AS (SELECT investor_id, year, 1 - wt_overlap AS turnover, disp FROM ov JOIN dsp USING (investor_id, year))"


@query(
    f"""WITH {_MOVES}, k AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY turnover) + (count(*) OVER (PARTITION BY year, turnover) - 1) / 2.0 AS a, rank() OVER (PARTITION BY year ORDER BY disp) + (count(*) OVER (PARTITION BY year, disp) - 1) / 2.0 AS b FROM mv2),
s AS (SELECT year, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY ALL)
SELECT year, n, round(rho, 4) AS rho, round(tanh(atanh(rho) - 1.96 * sqrt(1.06 / (n - 3))), 4) AS low, round(tanh(atanh(rho) + 1.96 * sqrt(1.06 / (n - 3))), 4) AS high FROM s"""
)
def spearman_ci(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.spearman(moves(spark, sf), "turnover", "disp", ["year"])
    return s.select("year", "n", *[F.round(c, 4).alias(c) for c in ("rho", "low", "high")])


@query(
    f"""WITH {_VEC}, g AS (SELECT a.period, a.i AS i, b.i AS j, sum(a.x * b.x) AS g FROM pu a JOIN pu b ON a.investor_id = b.investor_id AND a.period = b.period GROUP BY ALL)
SELECT period, round(sum(g) FILTER (i = j) * sum(g) FILTER (i = j) / sum(g * g), 4) AS eff_rank FROM g GROUP BY period"""
)
def effective_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = AL.gram(yearly(spark, sf).withColumn("other", F.col("embedding")), "embedding", "other", ["period"])
    rows = [(int(k[0]), round(AL.effective_rank(m), 4)) for k, m in g.items()]
    return spark.createDataFrame(rows, "period int, eff_rank double")


@query(
    f"""WITH {_MOVES}, br AS (SELECT DISTINCT unnest(quantile_cont(turnover, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS b FROM mv2),
c AS (SELECT turnover, disp, greatest(1, (SELECT count(*) FROM br WHERE b < turnover))::INT AS bin FROM mv2)
SELECT bin, count(*) AS n, round(median(disp), 5) AS med_disp, round(avg(turnover), 5) AS mean_turnover FROM c GROUP BY bin"""
)
def turnover_deciles(spark: SparkSession, sf: str) -> DataFrame:
    m = moves(spark, sf)
    bins = m.withColumn("bin", stats.cut(F.col("turnover"), stats.quantile_breaks(m, "turnover")))
    med = stats.quantiles(bins, "disp", [0.5], ["bin"]).select("bin", F.round(F.get("q", F.lit(0)), 5).alias("med_disp"))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("turnover"), 5).alias("mean_turnover")).join(med, "bin")


@query(f"WITH {_VEC}, {_MU}, {_LD} SELECT investor_id, period, k::INT AS k, round(l, 4) AS logdens FROM ld")
def spcauchy_logdens(spark: SparkSession, sf: str) -> DataFrame:
    mu = A.table(spark, sf, "embeddings").where(F.col("vec_id") < K_FIXED).select(F.col("vec_id").cast("int").alias("k"), F.col("embedding").cast("array<double>").alias("m"))
    rows = yearly(spark, sf).join(F.broadcast(mu), F.lit(True))  # eight centres
    return rows.select(*KEYS, "k", F.round(V.spherical_cauchy_log_density(V.dot(F.col("embedding"), F.col("m")), F.lit(RHO_FIXED), 64), 4).alias("logdens"))


@query(
    f"""WITH {_VEC}, {_MU}, {_LD}, e AS (SELECT investor_id, period, k, l, l - max(l) OVER (PARTITION BY investor_id, period) AS d FROM ld), p AS (SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY investor_id, period) AS post FROM e)
SELECT investor_id, period, arg_max(k, (round(post, 12), -k))::INT AS label, round(max(post), 5) AS max_post, round(max(l) + ln(sum(exp(d))) - ln({K_FIXED}), 4) AS loglik FROM p GROUP BY ALL"""
)
def mixture_posterior_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_posterior(spark, sf).select(*KEYS, "label", F.round("max_post", 5).alias("max_post"), F.round("loglik", 4).alias("loglik"))


def mixture_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Label, its posterior and log-likelihood of each yearly vector under the fixed mixture."""
    mu = fixed_centres(spark, sf)
    centres = F.lit([[float(x) for x in row] for row in mu])
    cos = F.transform(centres, lambda c: V.dot(F.col("embedding"), c))
    x = yearly(spark, sf).select(*KEYS, F.transform(cos, lambda c: V.spherical_cauchy_log_density(c, F.lit(RHO_FIXED), 64) - F.log(F.lit(float(K_FIXED)))).alias("l"))
    x = x.withColumn("loglik", V.log_sum_exp(F.col("l")))
    return x.select(*KEYS, (V.first_argmax(F.col("l")) - 1).alias("label"), F.exp(F.array_max("l") - F.col("loglik")).alias("max_post"), "loglik")


def rotations(spark: SparkSession, sf: str, rule: str = "stable_strat") -> dict[int, np.ndarray]:
    o = overlaps(spark, sf).join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
    kept = AL.anchors(o, rule, "year", "investor_id", "investor_type").select("investor_id", "year")
    pairs = year_pairs(spark, sf).join(kept, ["investor_id", "year"])
    return {int(k[0]): AL.procrustes(m) for k, m in AL.gram(pairs, "a", "b", ["year"]).items()}


@query()
def procrustes_displacement(spark: SparkSession, sf: str) -> DataFrame:
    moved = AL.rotated(year_pairs(spark, sf), "a", rotations(spark, sf), "year", "turned")
    return moved.select("investor_id", "year", F.round(AL.displacement(moved, "turned", "b"), 6).alias("displacement"))


@query()
def rotation_chain(spark: SparkSession, sf: str) -> DataFrame:
    r = rotations(spark, sf, "all")
    years = [*sorted(r), max(r) + 1]
    c = AL.chain(r, years[len(years) // 2], years)
    rows = [(y, float(np.abs(m.T @ m - np.eye(len(m))).max()), float(np.trace(m))) for y, m in sorted(c.items())]
    return spark.createDataFrame(rows, "year int, orthogonality_error double, trace double")


@query()
def alignment_null(spark: SparkSession, sf: str) -> DataFrame:
    """Per year: cosine of the fifth of investors held out before anchors were chosen, after alignment (of all, and of
    those with stable holdings), and its mean over PERMUTED rotations fitted on anchors paired at random."""
    pairs = year_pairs(spark, sf).withColumn("held_out", F.pmod(F.xxhash64("investor_id", F.lit(7)), F.lit(5)) == 0)
    o = overlaps(spark, sf).join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
    pairs = stored(pairs.join(o, ["investor_id", "year"]), "pairs")
    pool = pairs.where("NOT held_out")
    kept = AL.anchors(pool.select("investor_id", "year", "investor_type", "wt_overlap"), "stable_strat", "year", "investor_id", "investor_type")
    train = stored(pool.join(kept.select("investor_id", "year"), ["investor_id", "year"]).select("year", "investor_id", "a", "b"), "anchors")
    real = {int(k[0]): AL.procrustes(m) for k, m in AL.gram(train, "a", "b", ["year"]).items()}
    test = stored(AL.rotated(pairs.where("held_out").select("year", "a", "b", "wt_overlap"), "a", real, "year", "real"), "held-out")
    # A held-out cosine's mean is tr(R' G) / n with G the sum of a b': one small matrix a year serves all permutations.
    sums, null = AL.gram(test, "a", "b", ["year"]), {}
    for (y, _), m in AL.gram(AL.shuffled_pairs(train, "year", "investor_id", PERMUTED), "a", "b", ["year", "seed"]).items():
        if (y,) in sums:
            null.setdefault(int(y), []).append(float((AL.procrustes(m) * sums[(y,)]).sum()))
    rows = spark.createDataFrame([(y, float(np.mean(v)), len(v)) for y, v in null.items()], "year int, null_sum double, permutations int")
    cos = V.dot(F.col("real"), F.col("b"))
    g = test.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg(cos).alias("cos_aligned"), F.avg(F.when(AL.is_stayer(F.col("wt_overlap"), STAYS), cos)).alias("cos_stable"))
    return g.join(F.broadcast(rows), "year").select("year", "n", "cos_aligned", "cos_stable", (F.col("null_sum") / F.col("n")).alias("cos_null"), "permutations")


@query()
def loco_check(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's median displacement in each step, of its stable members and its movers, under rotations fitted without the
    label by three rules, and the rule that is best on the stable ones."""
    rows = year_pairs(spark, sf).join(A.labels(spark, sf), ["investor_id", "year"]).join(overlaps(spark, sf), ["investor_id", "year"])
    return FR.without_each(stored(rows.select("year", "investor_id", "label", "wt_overlap", "a", "b"), "labelled-pairs"), "year", "label", at=STAYS)


@query()
def spherical_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    y = yearly(spark, sf)
    centres, _ = SP.spherical_kmeans(y, fixed_centres(spark, sf)[:4])
    m = SP.Mixture(centres, np.full(4, 0.5), np.full(4, 0.25))
    return SP.assign(y, m, KEYS).select(*KEYS, "label")


@query()
def spcauchy_em(spark: SparkSession, sf: str) -> DataFrame:
    y = yearly(spark, sf)
    m, _ = SP.fit_mixture(y, "investor_id", 3, restarts=2, require_k=False)
    return SP.assign(y, m, KEYS).select(*KEYS, "label", "max_post", "loglik")


@query()
def choosing_k(spark: SparkSession, sf: str) -> DataFrame:
    """For k = 2 to 20 on 5,000 vectors of all years: BIC or mean cosine, agreement of ten subsample fits, and of both methods."""
    return scanned(spark, sf)


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return cached(spark, ("scan", sf), lambda: SP.scan_k(P.sample_rows(yearly(spark, sf).withColumn("id", F.concat_ws("/", *KEYS)), "id", 5000), "id"))


@query()
def choosing_k_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How to read choosing_k: the choice from k = 4 on, flat curves, BIC's penalty against its gain, components near the floor."""
    return SP.k_summary(scanned(spark, sf), min(5000, yearly(spark, sf).count()), 64)


@query()
def one_component_fit(spark: SparkSession, sf: str) -> DataFrame:
    mu, rho, trace = SP.poisson_kernel_fit(yearly(spark, sf))
    return spark.createDataFrame([(float(rho), float(mu @ mu), trace[-1], len(trace))], "rho double, mu_norm double, loglik double, steps int")


@query(
    f"""WITH {CORE}, {_STEPS}, g AS (SELECT year, sum(sw) AS s, count(*) AS n FROM steps GROUP BY year), a AS (SELECT sum(s) / sum(n) AS p, count(*) AS k FROM g)
SELECT round(sum((s - n * p) ** 2 / (n * p) + (s - n * p) ** 2 / (n * (1 - p))), 6) AS chi2, (any_value(k) - 1)::INT AS df FROM g, a"""
)
def homogeneity_test(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-square test that switching is equally frequent in all years."""
    g = steps(spark, sf).groupBy("year").agg(F.sum("sw").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("year").collect()
    stat, df, _ = stats.chi_square(np.array([[r["s"], r["n"] - r["s"]] for r in g]))
    return spark.createDataFrame([(round(stat, 6), df)], "chi2 double, df int")


@query()
def step_glm(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression of switching on the year, the clipped log-odds of the first label's posterior and turnover,
    with the likelihood ratio against no years."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    post = mixture_posterior(spark, sf).select("investor_id", F.col("period").alias("year"), "label", "max_post")
    d = label_steps(post).join(moves(spark, sf).select("investor_id", "year", "turnover"), ["investor_id", "year"])
    d = d.withColumn("sureness", stats.clipped_logit(F.col("max_post_from")))
    years = [r[0] for r in d.select("year").distinct().orderBy("year").collect()]
    cols = [f"y{y}" for y in years[1:]]
    d = cached(spark, ("glm", sf), lambda: d.select(F.col("sw").cast("double").alias("y"), "turnover", "sureness", *[(F.col("year") == y).cast("double").alias(f"y{y}") for y in years[1:]]))

    def fit(names: list[str]):
        return GeneralizedLinearRegression(family="binomial", labelCol="y", featuresCol="x", maxIter=25).fit(VectorAssembler(inputCols=names, outputCol="x").transform(d))

    controls = ["sureness", "turnover"]
    full, small = fit([*cols, *controls]), fit(controls)
    lrt = small.summary.deviance - full.summary.deviance
    se = full.summary.coefficientStandardErrors
    rows = [(n, float(b), float(s), float(b - 1.96 * s), float(b + 1.96 * s), float(lrt), stats.chi2_sf(lrt, len(cols))) for n, b, s in zip([*cols, *controls], full.coefficients, se, strict=False)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, low double, high double, lrt double, p double")


@query()
def hungarian_match(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of each year matched to those of the next by the number of shared investors."""
    g = steps(spark, sf).groupBy("year", "f", "t").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each year and pair of labels
    k = max((max(r["f"], r["t"]) for r in g), default=-1) + 1
    rows = []
    for y in sorted({r["year"] for r in g}):
        m = np.zeros((k, k))
        for r in (r for r in g if r["year"] == y):
            m[r["f"], r["t"]] = r["n"]
        best, total, margin = stats.hungarian_margin(m)
        rows += [(y, i, int(j), float(m[i, j]), total, margin) for i, j in enumerate(best)]
    return spark.createDataFrame(rows, "year int, from_label int, to_label int, shared double, total double, margin double")


QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


@query(
    f"""WITH {_VEC}, e AS (SELECT investor_id || '/' || period AS id, list(x ORDER BY i) AS v FROM pu GROUP BY ALL), r AS (SELECT v, row_number() OVER (ORDER BY id) - 1 AS nth FROM e),
d AS (SELECT ('0x' || substr(md5('a' || p), 1, 8))::BIGINT % (SELECT count(*) FROM r) AS i, ('0x' || substr(md5('b' || p), 1, 8))::BIGINT % (SELECT count(*) FROM r) AS j FROM range({PAIRS}) t(p)),
c AS (SELECT list_inner_product(a.v, b.v) AS c FROM d JOIN r a ON a.nth = i JOIN r b ON b.nth = j WHERE i <> j)
SELECT count(*) AS n, round(avg(c), 6) AS mean, round(stddev(c), 6) AS sd, 0.125::DOUBLE AS null_sd, {", ".join(f"round(quantile_cont(c, {q}), 6) AS {n}" for n, q in QUANTILES.items())} FROM c"""
)
def cosine_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the cosines of PAIRS pairs drawn by hash, against the spread of random directions."""
    y = yearly(spark, sf).select(F.concat_ws("/", *KEYS).alias("id"), "embedding")
    c = stored(P.sampled_pairs(y, "id", PAIRS).select(V.dot(F.col("a_embedding"), F.col("b_embedding")).alias("c")), "cosines")
    q = stats.quantiles(c, "c", list(QUANTILES.values()))
    m = c.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev("c"), 6).alias("sd"), F.lit(1 / 8.0).alias("null_sd"))
    return m.join(F.broadcast(q), F.lit(True)).select("n", "mean", "sd", "null_sd", *[F.round(F.get("q", F.lit(k)), 6).alias(c) for k, c in enumerate(QUANTILES)])
