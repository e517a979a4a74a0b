"""Queries over the panel: building sequences, gates, counts, reporting cycle, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.functions import sequences as S
from foliolens.operators import holdings as H
from foliolens.plans import adapters as A
from foliolens.plans.adapters import CORE, KEYS, POS, core_sql
from foliolens.plans.registry import query


@query(f"WITH {CORE} SELECT investor_id, issuer_id, period, round(mv, 4) AS mv FROM hold")
def holdings_agg(spark: SparkSession, sf: str) -> DataFrame:
    return A.holdings(spark, sf).select("investor_id", "issuer_id", "period", F.round("mv", 4).alias("mv"))


@query(
    f"""WITH {CORE} SELECT investor_id, issuer_id, report_date, round(mv, 4) AS mv FROM raw WHERE mv > 0
QUALIFY row_number() OVER (PARTITION BY investor_id, issuer_id ORDER BY report_date DESC, mv DESC, l_orderkey, l_linenumber) = 1"""
)
def holdings_latest_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.raw(spark, sf).where("mv > 0")
    last = H.latest_report(rows, ["investor_id", "issuer_id"], "report_date", [F.col("mv").desc(), F.col("l_orderkey"), F.col("l_linenumber")])
    return last.select("investor_id", "issuer_id", "report_date", F.round("mv", 4).alias("mv"))


@query(
    f"""WITH {CORE}, w AS (SELECT *, unnest([last_day(date_trunc('quarter', report_date)::DATE + INTERVAL 2 MONTH)::DATE, date_trunc('quarter', report_date)::DATE - 1]) AS quarter_end FROM raw)
SELECT investor_id, quarter_end, count(*) AS n, round(sum(mv), 4) AS mv FROM w WHERE report_date BETWEEN quarter_end - 7 AND quarter_end + 7 AND mv > 0 GROUP BY ALL"""
)
def report_window(spark: SparkSession, sf: str) -> DataFrame:
    """Reports about each quarter's end: a date can be near that of its own quarter or of the one before."""
    start = F.date_trunc("quarter", "report_date").cast("date")
    ends = F.explode(F.array(F.last_day(F.add_months(start, 2)), F.date_sub(start, 1)))
    rows = H.in_window(A.raw(spark, sf).withColumn("quarter_end", ends), "report_date", "quarter_end", 7).where("mv > 0")
    return rows.groupBy("investor_id", "quarter_end").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mv"), 4).alias("mv"))


@query(f"WITH {CORE} SELECT investor_id, issuer_id, period, round(mv, 4) AS mv FROM c0")
def concentration_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = H.not_concentrated(A.holdings(spark, sf), KEYS, most=A.MOST)
    return kept.select("investor_id", "issuer_id", "period", F.round("mv", 4).alias("mv"))


@query(f"WITH {core_sql('quarter')} SELECT investor_id, issuer_id, period::DATE AS period, round(mv, 4) AS mv FROM core")
def core_pruned_panel(spark: SparkSession, sf: str) -> DataFrame:
    return A.panel(spark, sf, "quarter").select("investor_id", "issuer_id", "period", F.round("mv", 4).alias("mv"))


@query(
    f"""WITH {POS} SELECT investor_id, period, max(n_assets_full) AS n_assets_full, string_agg(issuer_id, ' ' ORDER BY rank) AS tokens,
round(sum(w), 6) AS weight_sum, round(max(w), 6) AS top_weight FROM pos GROUP BY investor_id, period"""
)
def portfolio_sequences(spark: SparkSession, sf: str) -> DataFrame:
    book = H.joined_books(H.sequences(A.positions(spark, sf), KEYS), KEYS)
    total = F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)
    return book.select(*KEYS, F.size("tokens").alias("n_assets_full"), F.array_join("tokens", " ").alias("tokens"), F.round(total, 6).alias("weight_sum"), F.round(F.array_max("weights"), 6).alias("top_weight"))


@query(
    f"""WITH {POS} SELECT investor_id, period, chunk_id, count(*)::INT AS n_tokens, max(n_assets_full) AS n_assets_full,
string_agg(issuer_id, ' ' ORDER BY rank) AS tokens, round(sum(w), 6) AS weight_sum FROM pos GROUP BY investor_id, period, chunk_id"""
)
def chunked_sequences(spark: SparkSession, sf: str) -> DataFrame:
    seq = H.sequences(A.positions(spark, sf), KEYS)
    total = F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)
    return seq.select(*KEYS, "chunk_id", "n_tokens", "n_assets_full", F.array_join("tokens", " ").alias("tokens"), F.round(total, 6).alias("weight_sum"))


@query(
    f"""WITH {POS}, g AS (SELECT investor_id, period, chunk_id, sum(w) AS s FROM pos GROUP BY ALL)
SELECT investor_id, period, true AS sizes_ok, abs(sum(s) - 1) <= 1e-6 AS weights_ok, min(chunk_id) = 1 AND max(chunk_id) = count(*) AS chunks_ok FROM g GROUP BY ALL"""
)
def preflight_report(spark: SparkSession, sf: str) -> DataFrame:
    return H.preflight(H.sequences(A.positions(spark, sf), KEYS), KEYS).drop("weight_sum")


@query(f"WITH {POS} SELECT investor_id, period, issuer_id, rank, n_assets_full, round(pw, 6) AS pw FROM top")
def top62_slice(spark: SparkSession, sf: str) -> DataFrame:
    return A.slices(spark, sf).select("investor_id", "period", "issuer_id", "rank", "n_assets_full", F.round("pw", 6).alias("pw"))


@query(
    f"""WITH {POS} SELECT investor_id, period, string_agg(issuer_id, ' ' ORDER BY rank) FILTER (rank % 2 = 1) AS odd, string_agg(issuer_id, ' ' ORDER BY rank) FILTER (rank % 2 = 0) AS even
FROM pos WHERE rank <= 124 AND n_assets_full >= 2 GROUP BY ALL"""
)
def contrastive_halves(spark: SparkSession, sf: str) -> DataFrame:
    book = H.joined_books(H.sequences(A.positions(spark, sf), KEYS), KEYS).where(F.size("tokens") >= 2)
    first, second = S.halves(F.col("tokens"))
    return book.select(*KEYS, F.array_join(first, " ").alias("odd"), F.array_join(second, " ").alias("even"))


@query(
    f"""WITH {POS}, n AS (SELECT DISTINCT n_assets_full AS n FROM pos), r AS (SELECT n, unnest(range(1, n + 1)) AS r FROM n)
SELECT n, r::INT AS r, round(1.0 / n, 8) AS uniform, round((1.0 / r) / sum(1.0 / r) OVER q, 8) AS zipf, round(pow(r, -0.5) / sum(pow(r, -0.5)) OVER q, 8) AS power,
round(exp(-0.1 * (r - 1)) / sum(exp(-0.1 * (r - 1))) OVER q, 8) AS exponential FROM r WINDOW q AS (PARTITION BY n)"""
)
def rank_weight_schemes(spark: SparkSession, sf: str) -> DataFrame:
    n = A.positions(spark, sf).select(F.col("n_assets_full").alias("n")).distinct()
    schemes = [S.rank_weights(F.col("n"), s, a).alias(name) for name, s, a in (("uniform", "uniform", 1.0), ("zipf", "zipf", 1.0), ("power", "power", 0.5), ("exponential", "exp", 0.1))]
    rows = n.select("n", *schemes).select("n", F.posexplode(F.arrays_zip("uniform", "zipf", "power", "exponential")).alias("k", "x"))
    return rows.select("n", (F.col("k") + 1).alias("r"), *[F.round(f"x.{c}", 8).alias(c) for c in ("uniform", "zipf", "power", "exponential")])


def vocabulary(pos: DataFrame, period: str = "period", token: str = "issuer_id", first: int = 5) -> DataFrame:
    """Ids of the sorted distinct tokens of each period, after the special ids."""
    v = pos.select(period, token).distinct()
    return v.withColumn("id", (F.row_number().over(Window.partitionBy(period).orderBy(token)) + first - 1).cast("int"))


@query(f"WITH {POS}, v AS (SELECT DISTINCT period, issuer_id FROM pos) SELECT period, issuer_id, (row_number() OVER (PARTITION BY period ORDER BY issuer_id) + 4)::INT AS id FROM v")
def vocab_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(A.positions(spark, sf))


@query(
    f"""WITH {POS}, v AS (SELECT period, issuer_id, (row_number() OVER (PARTITION BY period ORDER BY issuer_id) + 4)::INT AS id FROM (SELECT DISTINCT period, issuer_id FROM pos)),
e AS (SELECT t.investor_id, t.period, t.rank, id FROM top t JOIN v USING (period, issuer_id))
SELECT investor_id, period, '2 ' || string_agg(id::VARCHAR, ' ' ORDER BY rank) || ' 3' || repeat(' 0', 62 - count(*)::INT) AS input_ids, (count(*) + 2)::INT AS attended FROM e GROUP BY ALL"""
)
def padded_sequence(spark: SparkSession, sf: str) -> DataFrame:
    pos = A.positions(spark, sf)
    ids = A.slices(spark, sf).join(vocabulary(pos), ["period", "issuer_id"], "left").withColumn("id", F.coalesce("id", F.lit(1)))
    rows = ids.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    out = rows.select(*KEYS, S.wrapped(F.col("x.id")).alias("input_ids"))
    return out.select(*KEYS, F.array_join("input_ids", " ").alias("input_ids"), F.size(F.filter("input_ids", lambda i: i != 0)).alias("attended"))


@query(f"WITH {core_sql('quarter')} SELECT period::DATE AS period, count(DISTINCT investor_id) AS n_investors, count(DISTINCT issuer_id) AS n_issuers, count(*) AS n_positions FROM core GROUP BY ALL")
def panel_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = A.panel(spark, sf, "quarter")
    return p.groupBy("period").agg(F.count_distinct("investor_id").alias("n_investors"), F.count_distinct("issuer_id").alias("n_issuers"), F.count(F.lit(1)).alias("n_positions"))


@query(
    f"""WITH {core_sql("quarter")}, q AS (SELECT period, count(DISTINCT investor_id) AS n FROM core GROUP BY ALL),
m AS (SELECT avg(n) FILTER (quarter(period) IN (2, 4)) AS hi, avg(n) FILTER (quarter(period) IN (1, 3)) AS lo FROM q)
SELECT round(hi, 4) AS hi, round(lo, 4) AS lo, round(100 * (hi - lo) / lo, 4) AS gap_pct FROM m"""
)
def seasonal_gap(spark: SparkSession, sf: str) -> DataFrame:
    q = A.panel(spark, sf, "quarter").groupBy("period").agg(F.count_distinct("investor_id").alias("n"))
    high = F.quarter("period").isin(2, 4)
    m = q.agg(F.avg(F.when(high, F.col("n"))).alias("hi"), F.avg(F.when(~high, F.col("n"))).alias("lo"))
    return m.select(F.round("hi", 4).alias("hi"), F.round("lo", 4).alias("lo"), F.round(F.try_divide(100 * (F.col("hi") - F.col("lo")), F.col("lo")), 4).alias("gap_pct"))


def reporting_classes(obs: DataFrame, calendar: DataFrame, least: int = 3) -> DataFrame:
    """Per investor: quarters seen of those within its own span, by half-year season, and the class they show.

    The calendar has a row for each quarter, so its running counts need one small ordered pass.
    """
    hi = F.when(F.quarter("period").isin(2, 4), 1).otherwise(0)
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    cal = calendar.select("period", hi.alias("is_hi")).withColumn("cum_hi", F.sum("is_hi").over(upto)).withColumn("cum_lo", F.sum(1 - F.col("is_hi")).over(upto))
    span = obs.groupBy("investor_id").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.sum(hi).alias("obs_hi"), F.sum(1 - hi).alias("obs_lo"))
    a = cal.select(F.col("period").alias("first"), (F.col("cum_hi") - F.col("is_hi")).alias("h0"), (F.col("cum_lo") - 1 + F.col("is_hi")).alias("l0"))
    b = cal.select(F.col("period").alias("last"), F.col("cum_hi").alias("h1"), F.col("cum_lo").alias("l1"))
    e = span.join(F.broadcast(a), "first").join(F.broadcast(b), "last").withColumn("elig_hi", F.col("h1") - F.col("h0")).withColumn("elig_lo", F.col("l1") - F.col("l0"))
    cov_hi, cov_lo = F.try_divide(F.col("obs_hi"), F.col("elig_hi")), F.try_divide(F.col("obs_lo"), F.col("elig_lo"))
    few = (F.col("elig_hi") < least) | (F.col("elig_lo") < least)
    cycle = F.when(few, "short").when((cov_hi >= 0.8) & (cov_lo >= 0.8), "quarterly").when((cov_hi >= 0.5) & (cov_lo < 0.2), "semiannual_hi").when((cov_lo >= 0.5) & (cov_hi < 0.2), "semiannual_lo").otherwise("irregular")
    return e.select("investor_id", "first", "last", "obs_hi", "obs_lo", "elig_hi", "elig_lo", cycle.alias("cycle"))


@query(
    f"""WITH {core_sql("quarter")}, o AS (SELECT DISTINCT investor_id, period, CASE WHEN quarter(period) IN (2, 4) THEN 1 ELSE 0 END AS hi FROM core),
cal AS (SELECT DISTINCT period, hi FROM o), s AS (SELECT investor_id, min(period) AS first, max(period) AS last, sum(hi) AS obs_hi, sum(1 - hi) AS obs_lo FROM o GROUP BY ALL),
e AS (SELECT s.*, sum(hi) AS elig_hi, sum(1 - hi) AS elig_lo FROM s JOIN cal ON period BETWEEN first AND last GROUP BY ALL)
SELECT investor_id, first::DATE AS first, last::DATE AS last, obs_hi::BIGINT AS obs_hi, obs_lo::BIGINT AS obs_lo, elig_hi::BIGINT AS elig_hi, elig_lo::BIGINT AS elig_lo,
CASE WHEN elig_hi < 3 OR elig_lo < 3 THEN 'short' WHEN obs_hi >= 0.8 * elig_hi AND obs_lo >= 0.8 * elig_lo THEN 'quarterly' WHEN obs_hi >= 0.5 * elig_hi AND obs_lo < 0.2 * elig_lo THEN 'semiannual_hi'
WHEN obs_lo >= 0.5 * elig_lo AND obs_hi < 0.2 * elig_hi THEN 'semiannual_lo' ELSE 'irregular' END AS cycle FROM e"""
)
def reporting_cycle(spark: SparkSession, sf: str) -> DataFrame:
    p = A.panel(spark, sf, "quarter")
    return reporting_classes(p.select("investor_id", "period").distinct(), p.select("period").distinct())


@query(
    f"""WITH {CORE}, b AS (SELECT DISTINCT investor_id, period AS year FROM core)
SELECT a.year, (a.year + 1)::INT AS next_year, count(*) AS n, count(c.investor_id) AS shared, round(100.0 * count(c.investor_id) / count(*), 4) AS pct
FROM b a LEFT JOIN b c ON a.investor_id = c.investor_id AND c.year = a.year + 1 WHERE a.year < (SELECT max(year) FROM b) GROUP BY ALL"""
)
def panel_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = A.panel(spark, sf).select("investor_id", F.col("period").alias("year")).distinct()
    c = b.select(F.col("investor_id").alias("other"), (F.col("year") - 1).alias("y"))
    last = b.agg(F.max("year").alias("m"))
    j = b.join(c, (b.investor_id == c.other) & (b.year == c.y), "left").join(F.broadcast(last), F.col("year") < F.col("m"))
    g = j.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("other").alias("shared"))
    return g.select("year", (F.col("year") + 1).cast("int").alias("next_year"), "n", "shared", F.round(100.0 * F.col("shared") / F.col("n"), 4).alias("pct"))


@query(f"WITH {CORE}, b AS (SELECT DISTINCT investor_id, period FROM core) SELECT investor_id FROM b GROUP BY investor_id HAVING count(*) = (SELECT count(DISTINCT period) FROM b)")
def balanced_panel(spark: SparkSession, sf: str) -> DataFrame:
    b = A.panel(spark, sf).select("investor_id", "period").distinct()
    n = b.agg(F.count_distinct("period").alias("n"))
    return b.groupBy("investor_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("investor_id")


@query(
    f"""WITH {CORE}, b AS (SELECT DISTINCT investor_id, period AS year FROM core)
SELECT (c.year - a.year)::INT AS horizon, count(*) AS shared, count(DISTINCT a.investor_id) AS investors FROM b a JOIN b c ON a.investor_id = c.investor_id AND c.year >= a.year GROUP BY ALL"""
)
def horizon_overlap(spark: SparkSession, sf: str) -> DataFrame:
    years = A.panel(spark, sf).groupBy("investor_id").agg(F.array_sort(F.collect_set("period")).alias("ys"))  # at most one entry a year
    pairs = years.select("investor_id", F.explode("ys").alias("y0"), "ys").select("investor_id", "y0", F.explode("ys").alias("y1")).where("y1 >= y0")
    return pairs.groupBy((F.col("y1") - F.col("y0")).cast("int").alias("horizon")).agg(F.count(F.lit(1)).alias("shared"), F.count_distinct("investor_id").alias("investors"))
