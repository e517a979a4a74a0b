"""Queries over the remaining operators: keys and fallbacks, set operations, ranks, cuts, plot data, incremental counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.functions import sequences as S
from foliolens.functions.stats import average_ranks, quantiles
from foliolens.plans import adapters as A
from foliolens.plans.adapters import CORE, POS, UNIVERSE
from foliolens.plans.registry import query
from foliolens.sources.panel_files import lookup_by_ids
from foliolens.streaming.incremental import presence


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def fetch_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = A.table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey")
    return lookup_by_ids(A.table(spark, sf, "customer"), "c_custkey", ids).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    held = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.table(spark, sf, "customer").join(held, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT DISTINCT year(o_orderdate)::INT AS year, last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH)::DATE AS quarter_end, quarter(o_orderdate)::INT AS q, CASE WHEN quarter(o_orderdate) IN (2, 4) THEN 'hi' ELSE 'lo' END AS season FROM orders")
def quarter_calendar(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    q = d.select(F.explode(S.quarter_ends(F.col("a"), F.col("b"))).alias("quarter_end"))
    return q.where(S.is_quarter_end(F.col("quarter_end"))).select(F.year("quarter_end").alias("year"), "quarter_end", F.quarter("quarter_end").alias("q"), F.when(F.quarter("quarter_end").isin(2, 4), "hi").otherwise("lo").alias("season"))


@query(
    """SELECT c_mktsegment, c_custkey, c_acctbal, round(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0, 1)::DOUBLE AS avg_rank,
(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey))::INT AS nth FROM customer QUALIFY nth <= 20"""
)
def ranks_per_group(spark: SparkSession, sf: str) -> DataFrame:
    c = average_ranks(A.table(spark, sf, "customer"), "c_acctbal", "avg_rank", ["c_mktsegment"])
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return c.withColumn("nth", nth).where("nth <= 20").select("c_mktsegment", "c_custkey", "c_acctbal", F.round("avg_rank", 1).alias("avg_rank"), "nth")


@query(
    """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) / (hi - lo) * 50) + 1, 50)::INT AS bin, count(*) AS n FROM orders, m GROUP BY ALL"""
)
def histogram_50(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").select("o_totalprice")
    m = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    b = F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50) + 1, F.lit(50)).cast("int")
    return o.join(F.broadcast(m), F.lit(True)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderpriority, (row_number() OVER (ORDER BY median(o_totalprice), o_orderpriority))::INT AS place, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY o_orderpriority"""
)
def box_plot_data(spark: SparkSession, sf: str) -> DataFrame:
    g = quantiles(A.table(spark, sf, "orders"), "o_totalprice", [0.25, 0.5, 0.75], ["o_orderpriority"])
    place = F.row_number().over(Window.orderBy(F.get("q", 1), "o_orderpriority"))  # a row for each group
    return g.select("o_orderpriority", place.alias("place"), *[F.round(F.get("q", i), 4).alias(c) for i, c in enumerate(("q1", "med", "q3"))])


@query(
    """WITH w AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal >= 0) AS positive FROM customer GROUP BY ALL)
SELECT segment, 'negative' AS sign, negative AS n FROM w UNION ALL SELECT segment, 'positive', positive FROM w"""
)
def pivot_longer(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "customer").withColumn("sign", F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive"))
    wide = c.groupBy(F.col("c_mktsegment").alias("segment")).pivot("sign", ["negative", "positive"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.unpivot("segment", ["negative", "positive"], "sign", "n")


@query(f"WITH {CORE}, a AS (SELECT DISTINCT investor_id FROM core WHERE period = 1996), b AS (SELECT DISTINCT investor_id FROM core WHERE period = 1999) SELECT investor_id FROM a INTERSECT SELECT investor_id FROM b")
def common_investors(spark: SparkSession, sf: str) -> DataFrame:
    p = A.panel(spark, sf)
    return p.where("period = 1996").select("investor_id").intersect(p.where("period = 1999").select("investor_id"))


@query(f"WITH {POS} SELECT period, issuer_id, count(*) AS n_holders, round(sum(w), 6) AS mass, round(stddev_samp(w), 6) AS sd FROM pos GROUP BY ALL HAVING count(*) >= 20")
def issuer_mass(spark: SparkSession, sf: str) -> DataFrame:
    g = A.positions(spark, sf).groupBy("period", "issuer_id").agg(F.count(F.lit(1)).alias("n_holders"), F.round(F.sum("w"), 6).alias("mass"), F.round(F.stddev("w"), 6).alias("sd"))
    return g.where("n_holders >= 20")


@query("SELECT user_id, min(ts::DATE) AS first_period, max(ts::DATE) AS last_period, count(DISTINCT ts::DATE) AS n_periods FROM events GROUP BY ALL")
def event_presence(spark: SparkSession, sf: str) -> DataFrame:
    return presence(A.table(spark, sf, "events").withColumn("day", F.col("ts").cast("date")).select("user_id", "day").distinct(), "user_id", "day")


@query(
    f"""WITH {POS}, g AS (SELECT investor_id, period, max(CASE WHEN rank = 1 THEN w END) AS w1, sum(CASE WHEN rank <= 10 THEN w END) AS w10 FROM pos GROUP BY ALL), q AS (SELECT *, quantile_cont(w10, 0.75) OVER (PARTITION BY period) AS q FROM g)
SELECT investor_id, period, round(w1, 6) AS w1, round(w10, 6) AS w10 FROM q WHERE w10 >= q"""
)
def upper_quantile_mask(spark: SparkSession, sf: str) -> DataFrame:
    g = A.positions(spark, sf).groupBy("investor_id", "period").agg(F.max(F.when(F.col("rank") == 1, F.col("w"))).alias("w1"), F.sum(F.when(F.col("rank") <= 10, F.col("w"))).alias("w10"))
    q = quantiles(g, "w10", [0.75], ["period"])
    return g.join(F.broadcast(q), "period").where("w10 >= q[0]").select("investor_id", "period", F.round("w1", 6).alias("w1"), F.round("w10", 6).alias("w10"))


@query(f"WITH {CORE}, y AS (SELECT period, count(DISTINCT investor_id) AS n FROM core GROUP BY ALL) SELECT period, n, (n - lag(n) OVER (ORDER BY period))::BIGINT AS step, sum(n) OVER (ORDER BY period)::BIGINT AS running FROM y")
def count_steps(spark: SparkSession, sf: str) -> DataFrame:
    y = A.panel(spark, sf).groupBy("period").agg(F.count_distinct("investor_id").alias("n"))
    w = Window.orderBy("period")  # a row for each period
    return y.select("period", "n", (F.col("n") - F.lag("n").over(w)).alias("step"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("SELECT issuer_id, CASE WHEN flag IS NULL OR upper(flag) IN ('1', 'Y', 'TRUE') THEN true ELSE false END AS active, coalesce(a, b, 'none') AS pick, least(greatest(x, 0.0001), 0.9999) AS clipped FROM (SELECT p_partkey AS issuer_id, CASE p_size % 4 WHEN 0 THEN 'y' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' END AS flag, CASE WHEN p_size % 3 = 0 THEN p_brand END AS a, CASE WHEN p_size % 5 = 0 THEN p_type END AS b, p_size / 50.0::DOUBLE AS x FROM part)")
def scalar_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    flag = F.when(s % 4 == 0, "y").when(s % 4 == 1, "0").when(s % 4 == 2, "TRUE")
    return A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("issuer_id"), S.truthy(flag).alias("active"), F.coalesce(F.when(s % 3 == 0, F.col("p_brand")), F.when(s % 5 == 0, F.col("p_type")), F.lit("none")).alias("pick"), F.least(F.greatest(s / 50.0, F.lit(0.0001)), F.lit(0.9999)).alias("clipped")
    )


_CAND = f"l AS (SELECT p_partkey AS listing, p_partkey % {UNIVERSE} AS issuer, p_type LIKE 'E%' AS equity, p_size % 2 = 0 AS covered FROM part)"


@query(f"WITH {_CAND}, f AS (SELECT *, max(covered::INT) OVER (PARTITION BY issuer) AS any_covered, max(equity::INT) OVER (PARTITION BY issuer) AS any_equity FROM l) SELECT listing, issuer FROM f WHERE equity OR any_covered = 0 OR any_equity = 0")
def candidate_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Equity listings, and all listings of issuers without a covered one or without an equity one."""
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("listing"), A.issuer_of(spark, sf, "p_partkey").alias("issuer"), F.col("p_type").startswith("E").alias("equity"), (F.col("p_size") % 2 == 0).alias("covered"))
    flags = p.groupBy("issuer").agg(F.max("covered").alias("any_covered"), F.max("equity").alias("any_equity"))
    return p.join(flags, "issuer").where(F.col("equity") | ~F.col("any_covered") | ~F.col("any_equity")).select("listing", "issuer")


@query(
    f"""WITH {POS}, t AS (SELECT investor_id, period, n_assets_full AS n, CASE WHEN n_assets_full <= 62 THEN n_assets_full ELSE ceil(n_assets_full / ceil(n_assets_full / 62.0)) END::INT AS f FROM pos WHERE rank = 1)
SELECT investor_id, period, least(n, 62)::INT AS paper, f AS first_chunk, ceil(n / f)::INT AS n_chunks, n::INT AS whole FROM t"""
)
def coverage_variants(spark: SparkSession, sf: str) -> DataFrame:
    from foliolens.operators import encoder as E
    from foliolens.operators import holdings as H

    book = H.joined_books(H.sequences(A.positions(spark, sf), A.KEYS), A.KEYS)
    t = E.real_tokens(F.col("tokens"))
    size = lambda v: F.size(F.get(E.covered(t, v), F.lit(0)))
    return book.select(*A.KEYS, size("paper").alias("paper"), size("first-chunk").alias("first_chunk"), F.size(E.covered(t, "all-chunks")).alias("n_chunks"), size("full-sequence").alias("whole"))


@query()
def word2vec_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Token vectors trained on the sequences, one row for each issuer."""
    from foliolens.functions.vectors import norm
    from foliolens.operators import encoder as E
    from foliolens.operators import holdings as H

    vectors = E.Word2VecEncoder().vectors(H.sequences(A.positions(spark, sf), A.KEYS))
    return vectors.select("issuer_id", F.size("vec").alias("d"), norm(F.col("vec")).alias("length"))
