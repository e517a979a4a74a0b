"""Queries over reference tables and cluster profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.functions import stats
from foliolens.functions.stats import quantiles
from foliolens.operators import holdings as H
from foliolens.operators import lenses as L
from foliolens.plans import adapters as A
from foliolens.plans.adapters import CORE, INVESTORS, ISSUERS, KEYS, LABELS, POS, UNIVERSE
from foliolens.plans.registry import query


@query(f"WITH {CORE} SELECT issuer_id, count(DISTINCT investor_id) AS n_holders_total, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period FROM core GROUP BY ALL")
def issuer_holder_stats(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.panel(spark, sf).groupBy("issuer_id", "investor_id", "period").agg(F.lit(1).alias("one"))
    return pairs.groupBy("issuer_id").agg(F.count_distinct("investor_id").alias("n_holders_total"), F.count_distinct("period").alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query(
    f"""WITH {POS}, b AS (SELECT DISTINCT investor_id, period, n_assets_full FROM pos) SELECT investor_id, count(*) AS n_periods, min(period) AS first_period, max(period) AS last_period,
round(median(n_assets_full), 4) AS med_assets, max(n_assets_full) AS max_assets, arg_max(n_assets_full, period) AS last_assets FROM b GROUP BY ALL"""
)
def investor_panel_stats(spark: SparkSession, sf: str) -> DataFrame:
    b = A.positions(spark, sf).select("investor_id", "period", "n_assets_full").distinct()
    return b.groupBy("investor_id").agg(
        F.count(F.lit(1)).alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.round(F.median("n_assets_full"), 4).alias("med_assets"), F.max("n_assets_full").alias("max_assets"), F.max_by("n_assets_full", "period").alias("last_assets")
    )


@query(
    f"""WITH l AS (SELECT *, p_partkey % {UNIVERSE} AS issuer, CASE WHEN p_type LIKE 'A%' THEN 6 WHEN p_type LIKE 'E%' THEN 5 WHEN p_type LIKE 'S%' THEN 3 ELSE 4 END AS r_type, p_size % 2 = 0 AS active FROM part)
SELECT issuer::VARCHAR AS issuer_id, p_partkey AS listing, p_retailprice AS market_cap FROM l
QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY r_type DESC, active DESC, p_retailprice DESC NULLS LAST, p_partkey) = 1"""
)
def primary_listing(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    first = F.substring("p_type", 1, 1)
    r_type = F.when(first == "A", 6).when(first == "E", 5).when(first == "S", 3).otherwise(4)
    issuer = A.issuer_of(spark, sf, "p_partkey")
    w = Window.partitionBy(issuer).orderBy(r_type.desc(), (F.col("p_size") % 2 == 0).desc(), F.col("p_retailprice").desc_nulls_last(), "p_partkey")
    p = p.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return p.select(issuer.cast("string").alias("issuer_id"), F.col("p_partkey").alias("listing"), F.col("p_retailprice").alias("market_cap"))


@query(
    f"""WITH p AS (SELECT (p_partkey % {UNIVERSE})::VARCHAR AS issuer_id, p_partkey, p_retailprice * p_size AS cap, p_size FROM part WHERE p_retailprice > 0 AND p_size > 0)
SELECT issuer_id, p_partkey AS listing, round(cap, 4) AS market_cap FROM p QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY cap DESC, p_partkey) = 1"""
)
def market_caps(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part").where((F.col("p_retailprice") > 0) & (F.col("p_size") > 0))
    p = p.select(A.issuer_of(spark, sf, "p_partkey").cast("string").alias("issuer_id"), F.col("p_partkey").alias("listing"), (F.col("p_retailprice") * F.col("p_size")).alias("cap"))
    w = Window.partitionBy("issuer_id").orderBy(F.col("cap").desc(), "listing")
    return p.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("issuer_id", "listing", F.round("cap", 4).alias("market_cap"))


#: Day of the market caps, and days before it of which a price may be.
SNAPSHOT, LOOK_BACK = "1998-06-30", 45


@query(
    f"""WITH w AS (SELECT l_partkey AS listing, l_shipdate, l_extendedprice / l_quantity AS price, l_quantity AS shares FROM lineitem WHERE l_shipdate >= DATE '{SNAPSHOT}' - {LOOK_BACK} AND l_shipdate < DATE '{SNAPSHOT}' + 1),
n AS (SELECT * FROM w WHERE price IS NOT NULL AND shares IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing ORDER BY l_shipdate DESC, price DESC, shares DESC) = 1)
SELECT (listing % {UNIVERSE})::VARCHAR AS issuer_id, listing, l_shipdate::DATE AS price_date, round(price, 4) AS price, round(price * shares, 2) AS market_cap FROM n
QUALIFY row_number() OVER (PARTITION BY listing % {UNIVERSE} ORDER BY price * shares DESC, listing) = 1"""
)
def latest_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Each issuer's largest listing by market cap, at the newest price of every listing in the days before the snapshot."""
    rows = A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("listing"), "l_shipdate", F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("shares"))
    newest = H.latest_in_window(rows, "listing", "l_shipdate", SNAPSHOT, LOOK_BACK, ["price", "shares"])
    cap = F.struct((F.col("price") * F.col("shares")).alias("cap"), (-F.col("listing")).alias("first"), "listing", "l_shipdate", "price")
    best = newest.groupBy(A.issuer_of(spark, sf, "listing").cast("string").alias("issuer_id")).agg(F.max(cap).alias("b"))
    return best.select("issuer_id", "b.listing", F.col("b.l_shipdate").cast("date").alias("price_date"), F.round("b.price", 4).alias("price"), F.round("b.cap", 2).alias("market_cap"))


@query(
    f"""WITH {ISSUERS}, k AS (SELECT (p_partkey - 20)::VARCHAR AS issuer_id FROM part)
SELECT k.issuer_id, coalesce(CASE WHEN k.issuer_id::INT % 3 <> 0 THEN name END, brand, 'unknown') AS name,
CASE WHEN k.issuer_id::INT % 3 <> 0 AND name IS NOT NULL THEN 'entity' WHEN brand IS NOT NULL THEN 'listing' END AS name_source FROM k LEFT JOIN iss USING (issuer_id)"""
)
def name_fallback(spark: SparkSession, sf: str) -> DataFrame:
    k = A.table(spark, sf, "part").select((F.col("p_partkey") - 20).cast("string").alias("issuer_id"))  # the first have no issuer
    entity = F.when(F.col("issuer_id").cast("int") % 3 != 0, F.col("name"))
    rows = k.join(A.issuers(spark, sf), "issuer_id", "left")
    return rows.select("issuer_id", F.coalesce(entity, "brand", F.lit("unknown")).alias("name"), F.when(entity.isNotNull(), "entity").when(F.col("brand").isNotNull(), "listing").alias("name_source"))


@query(
    """SELECT l_suppkey::VARCHAR AS feeder, count(*) AS n_links, count(DISTINCT c_nationkey) AS n_masters, string_agg(DISTINCT c_nationkey::VARCHAR, '|' ORDER BY c_nationkey::VARCHAR) AS masters, min(c_nationkey) AS first_master
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
)
def bridge_collapse(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c = (A.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    ids = F.array_sort(F.collect_set(F.col("c_nationkey").cast("string")))
    g = j.groupBy(F.col("l_suppkey").cast("string").alias("feeder")).agg(F.count(F.lit(1)).alias("n_links"), ids.alias("ids"), F.min("c_nationkey").alias("first_master"))
    return g.select("feeder", "n_links", F.size("ids").cast("long").alias("n_masters"), F.array_join("ids", "|").alias("masters"), "first_master")


@query(
    f"""WITH {CORE}, {INVESTORS}, b AS (SELECT DISTINCT investor_id FROM core)
SELECT investor_type, count(*) AS n, round(100.0 * count(style) / count(*), 4) AS pct_style, round(100.0 * count(aum) FILTER (aum > 0) / count(*), 4) AS pct_aum FROM b JOIN inv USING (investor_id) GROUP BY ALL"""
)
def coverage_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.panel(spark, sf).select("investor_id").distinct().join(A.investors(spark, sf), "investor_id")
    has = lambda c: F.round(100.0 * F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return rows.groupBy("investor_type").agg(F.count(F.lit(1)).alias("n"), has(F.col("style").isNotNull()).alias("pct_style"), has(F.coalesce(F.col("aum") > 0, F.lit(False))).alias("pct_aum"))


@query(
    f"""WITH {INVESTORS}, s AS (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY investor_type ORDER BY investor_id) <= 800), h AS (SELECT DISTINCT l_suppkey::VARCHAR AS investor_id FROM lineitem)
SELECT investor_type, round(100.0 * count(h.investor_id) / count(*), 4) AS holdings, round(100.0 * count(*) FILTER (s.investor_id::BIGINT % 7 = 0) / count(*), 4) AS sevenths FROM s LEFT JOIN h USING (investor_id) GROUP BY ALL"""
)
def keyspace_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("investor_type").orderBy("investor_id")
    s = A.investors(spark, sf).withColumn("nth", F.row_number().over(w)).where("nth <= 800").select("investor_id", "investor_type")
    spaces = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("investor_id")).distinct().withColumn("space", F.lit("holdings"))
    spaces = spaces.unionByName(s.where(F.col("investor_id").cast("long") % 7 == 0).select("investor_id", F.lit("sevenths").alias("space")))
    n = s.groupBy("investor_type").agg(F.count(F.lit(1)).alias("n"))
    hits = s.join(spaces, "investor_id").groupBy("investor_type").pivot("space", ["holdings", "sevenths"]).agg(F.count(F.lit(1))).na.fill(0)
    return n.join(hits, "investor_type", "left").select("investor_type", *[F.round(100.0 * F.coalesce(c, F.lit(0)) / F.col("n"), 4).alias(c) for c in ("holdings", "sevenths")])


@query(
    f"""WITH {CORE}, d AS (SELECT issuer_id, max(report_date) AS last FROM raw GROUP BY ALL)
SELECT count(*) AS n, round(quantile_cont(date_diff('day', last, DATE '2001-12-31'), 0.5), 4) AS median_days, round(quantile_cont(date_diff('day', last, DATE '2001-12-31'), 0.9), 4) AS p90_days FROM d"""
)
def price_staleness(spark: SparkSession, sf: str) -> DataFrame:
    last = A.raw(spark, sf).groupBy("issuer_id").agg(F.max("report_date").alias("last"))
    lag = F.datediff(F.lit("2001-12-31").cast("date"), "last")
    days = last.select(lag.alias("days"))
    n = days.agg(F.count("days").alias("n"))
    return quantiles(days, "days", [0.5, 0.9]).join(F.broadcast(n), F.lit(True)).select("n", F.round(F.get("q", F.lit(0)), 4).alias("median_days"), F.round(F.get("q", F.lit(1)), 4).alias("p90_days"))


@query(
    f"""WITH {CORE}, {INVESTORS}, {ISSUERS}, b AS (SELECT investor_id, count(DISTINCT period) AS n_periods FROM core GROUP BY ALL)
SELECT b.investor_id, n_periods, investor_type, domicile AS inv_country, coalesce(style::VARCHAR, 'none') AS style_any, round(greatest(aum, 0), 2) AS aum_any, b.investor_id::BIGINT % 10 = 0 AS is_feeder FROM b LEFT JOIN inv USING (investor_id)"""
)
def investors_master(spark: SparkSession, sf: str) -> DataFrame:
    b = A.panel(spark, sf).groupBy("investor_id").agg(F.count_distinct("period").alias("n_periods"))
    feeders = b.where(F.col("investor_id").cast("long") % 10 == 0).select("investor_id", F.lit(True).alias("feeder"))
    rows = b.join(A.investors(spark, sf), "investor_id", "left").join(feeders, "investor_id", "left")
    return rows.select(
        "investor_id", "n_periods", "investor_type", F.col("domicile").alias("inv_country"), F.coalesce(F.col("style").cast("string"), F.lit("none")).alias("style_any"), F.round(F.greatest("aum", F.lit(0.0)), 2).alias("aum_any"), F.coalesce("feeder", F.lit(False)).alias("is_feeder")
    )


@query(
    f"""WITH {CORE}, {ISSUERS}, h AS (SELECT issuer_id, count(DISTINCT investor_id) AS n_holders FROM core GROUP BY ALL)
SELECT coalesce(h.issuer_id, i.issuer_id) AS issuer_id, n_holders, sector, cap_group, CASE WHEN h.issuer_id IS NULL THEN 'dimension only' WHEN i.issuer_id IS NULL THEN 'holdings only' ELSE 'both' END AS found
FROM h FULL JOIN (SELECT * FROM iss WHERE issuer_id::INT % 9 <> 0) i ON h.issuer_id = i.issuer_id"""
)
def securities_master(spark: SparkSession, sf: str) -> DataFrame:
    h = A.panel(spark, sf).groupBy("issuer_id").agg(F.count_distinct("investor_id").alias("n_holders"), F.lit(1).alias("in_h"))
    i = A.issuers(spark, sf).where(F.col("issuer_id").cast("int") % 9 != 0).withColumn("in_i", F.lit(1))
    found = F.when(F.col("in_h").isNull(), "dimension only").when(F.col("in_i").isNull(), "holdings only").otherwise("both")
    return h.join(i, "issuer_id", "full").select("issuer_id", "n_holders", "sector", "cap_group", found.alias("found"))


_SHARE = f"share AS (SELECT investor_id, period, count(*) FILTER (country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5')) / count(country) AS pct FROM top LEFT JOIN iss USING (issuer_id) GROUP BY ALL)"
HOME = tuple(f"NATION_{i}" for i in range(1, 6))


def home_share(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted share of a slice's known issuers that are at home; zero if none is known."""
    rows = A.slices(spark, sf).join(A.issuers(spark, sf).select("issuer_id", "country"), "issuer_id", "left")
    known = F.when(F.col("country").isNotNull(), F.col("country").isin(*HOME).cast("int"))
    return rows.groupBy(*KEYS).agg(F.coalesce(F.avg(known), F.lit(0.0)).alias("pct"))


@query(f"WITH {POS}, {ISSUERS}, {_SHARE}, t AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25]) AS threshold) SELECT threshold::DOUBLE AS threshold, count(*) FILTER (coalesce(pct, 0) >= threshold) AS kept, count(*) AS n FROM share, t GROUP BY ALL")
def us_share_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    marks = (0.05, 0.1, 0.15, 0.2, 0.25)
    wide = home_share(spark, sf).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("pct") >= m, 1).otherwise(0)).alias(f"k{i}") for i, m in enumerate(marks)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("threshold"), F.col(f"k{i}").alias("kept")) for i, m in enumerate(marks)])).alias("x"), "n").select("x.threshold", "x.kept", "n")


@query(f"WITH {POS}, {ISSUERS}, {_SHARE} SELECT investor_id, period, round(coalesce(pct, 0), 6) AS pct FROM share WHERE coalesce(pct, 0) >= 0.2")
def us_universe(spark: SparkSession, sf: str) -> DataFrame:
    return home_share(spark, sf).where("pct >= 0.2").select(*KEYS, F.round("pct", 6).alias("pct"))


def profiled(spark: SparkSession, sf: str) -> DataFrame:
    """Slices with cluster labels and issuer attributes."""
    lab = A.labels(spark, sf).withColumnRenamed("year", "period").withColumnRenamed("label", "cluster")
    return A.slices(spark, sf).join(lab, KEYS).join(A.issuers(spark, sf), "issuer_id", "left")


_PROF = f"{POS}, {ISSUERS}, {LABELS}, prof AS (SELECT top.*, lab.label AS cluster, iss.* EXCLUDE (issuer_id) FROM top JOIN lab ON lab.investor_id = top.investor_id AND lab.year = top.period LEFT JOIN iss ON iss.issuer_id = top.issuer_id)"


@query(
    f"""WITH {_PROF}, c AS (SELECT cluster, sector AS category, sum(pw) AS s, count(*) AS n FROM prof WHERE sector IS NOT NULL GROUP BY ALL),
r AS (SELECT cluster, category, n, round(100 * s / sum(s) OVER (PARTITION BY cluster), 4) AS share_pct, round((s / sum(s) OVER (PARTITION BY cluster)) / (sum(s) OVER (PARTITION BY category) / sum(s) OVER ()), 4) AS lift FROM c)
SELECT cluster, category, n, share_pct, lift, (row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, category))::INT AS nth FROM r WHERE n >= 20 QUALIFY nth <= 3"""
)
def lift_table(spark: SparkSession, sf: str) -> DataFrame:
    return L.lift_table(profiled(spark, sf), "cluster", "sector", F.col("pw"))


@query(
    f"""WITH {_PROF}, c AS (SELECT cluster, cap_group AS category, sum(pw) AS s FROM prof GROUP BY ALL)
SELECT cluster, category, round(100 * s / sum(s) OVER (PARTITION BY cluster), 4) AS pct FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, category) = 1"""
)
def top_share(spark: SparkSession, sf: str) -> DataFrame:
    return L.largest_category(profiled(spark, sf), "cluster", "cap_group", F.col("pw"))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    f"""WITH {_PROF}, {INVESTORS}, m AS (SELECT DISTINCT p.investor_id, p.period, cluster, investor_type FROM prof p JOIN inv USING (investor_id))
SELECT cluster, {", ".join(f"round(100.0 * count(*) FILTER (investor_type = '{r}') / count(*), 4) AS {r.lower().replace(' ', '_')}" for r in _REGIONS)} FROM m GROUP BY cluster"""
)
def region_mix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    m = A.labels(spark, sf).withColumnRenamed("label", "cluster").join(A.investors(spark, sf).select("investor_id", "investor_type"), "investor_id")
    wide = m.groupBy("cluster").pivot("investor_type", _REGIONS).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{r}`") for r in _REGIONS), F.lit(0))
    return wide.select("cluster", *[F.round(100.0 * F.col(f"`{r}`") / total, 4).alias(r.lower().replace(" ", "_")) for r in _REGIONS])


@query(
    f"""WITH {_PROF}, h AS (SELECT DISTINCT cluster, investor_id || '/' || period AS book, issuer_id FROM prof), m AS (SELECT cluster, count(DISTINCT book) AS members FROM h GROUP BY ALL),
k AS (SELECT cluster, issuer_id, count(*) AS k FROM h GROUP BY ALL), r AS (SELECT cluster, issuer_id, k / members AS p, (sum(k) OVER (PARTITION BY issuer_id)) / (SELECT sum(members) FROM m) AS q FROM k JOIN m USING (cluster))
SELECT cluster, issuer_id, round(p, 4) AS p_cluster, round(q, 4) AS p_all, round(p / q, 1) AS lift, (row_number() OVER (PARTITION BY cluster ORDER BY round(p / q, 1) DESC, round(p, 4) DESC, issuer_id))::INT AS nth FROM r WHERE p >= 0.1 QUALIFY nth <= 8"""
)
def distinctive_issuers(spark: SparkSession, sf: str) -> DataFrame:
    lab = A.labels(spark, sf).withColumnRenamed("year", "period").withColumnRenamed("label", "cluster")
    rows = A.slices(spark, sf).join(lab, KEYS).withColumn("book", F.concat_ws("/", "investor_id", "period"))
    return L.distinctive(rows, "cluster", "book", "issuer_id")


@query(
    f"""WITH {CORE}, {INVESTORS}, {LABELS}, n AS (SELECT label AS cluster, domicile, count(*) AS n FROM lab JOIN inv USING (investor_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, domicile) AS nth FROM n)
SELECT cluster, sum(n)::BIGINT AS members, count(*) AS owners, round(100.0 * sum(CASE WHEN nth <= 3 THEN n ELSE 0 END) / sum(n), 4) AS top_share_pct FROM r GROUP BY ALL"""
)
def manager_concentration(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.labels(spark, sf).withColumnRenamed("label", "cluster").join(A.investors(spark, sf).select("investor_id", "domicile"), "investor_id")
    return L.concentration(rows, "cluster", "domicile")


@query(
    f"""WITH {CORE}, {INVESTORS}, {LABELS}, m AS (SELECT label AS cluster, coalesce(style::VARCHAR, 'none') AS style FROM lab JOIN inv USING (investor_id))
SELECT cluster, style, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cluster), 4) AS pct FROM m GROUP BY cluster, style"""
)
def style_distribution(spark: SparkSession, sf: str) -> DataFrame:
    m = A.labels(spark, sf).join(A.investors(spark, sf).select("investor_id", "style"), "investor_id")
    n = m.groupBy(F.col("label").alias("cluster"), F.coalesce(F.col("style").cast("string"), F.lit("none")).alias("style")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("cluster")), 4))


@query(
    f"""WITH {_PROF}, g AS (SELECT investor_id, period, price, sum(pw) AS w FROM prof WHERE price IS NOT NULL AND pw > 0 GROUP BY ALL),
s AS (SELECT *, sum(w) OVER (PARTITION BY investor_id, period ORDER BY price) / sum(w) OVER (PARTITION BY investor_id, period) AS share FROM g)
SELECT investor_id, period, min(price) AS weighted_median FROM s WHERE share >= 0.5 - 1e-12 GROUP BY ALL"""
)
def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    return stats.weighted_median(profiled(spark, sf), KEYS, "price", "pw")


@query(
    f"""WITH {_PROF}, s AS (SELECT investor_id, period, sector, sum(pw) AS s FROM prof GROUP BY ALL), t AS (SELECT investor_id, period, max(s) / sum(s) AS m FROM s GROUP BY ALL),
c AS (SELECT investor_id, period, country, count(*) AS n FROM prof GROUP BY ALL), k AS (SELECT investor_id, period, country FROM c QUALIFY row_number() OVER (PARTITION BY investor_id, period ORDER BY n DESC, country) = 1)
SELECT investor_id, period, cluster, round(max(pw), 6) AS top_weight, round(sum(pw * pw), 6) AS herfindahl, round(any_value(m), 6) AS sector_share, any_value(k.country) AS main_country
FROM prof JOIN t USING (investor_id, period) JOIN k USING (investor_id, period) GROUP BY ALL"""
)
def investor_features(spark: SparkSession, sf: str) -> DataFrame:
    p = profiled(spark, sf).withColumn("book", F.struct(*KEYS))
    sector = L.largest_share(p, "book", "sector", F.col("pw")).select("book.*", "largest_share")
    base = p.groupBy(*KEYS, "cluster").agg(F.round(F.max("pw"), 6).alias("top_weight"), F.round(F.sum(F.col("pw") * F.col("pw")), 6).alias("herfindahl"), F.mode("country", True).alias("main_country"))
    return base.join(sector, KEYS).select(*KEYS, "cluster", "top_weight", "herfindahl", F.round("largest_share", 6).alias("sector_share"), "main_country")


def _cramers_sql(x: str) -> str:
    return f"""(SELECT sqrt(greatest(0, s - 1 - (r - 1) * (c - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1)) FROM
(SELECT sum(k) AS n, sum(k * k / (kr * kc)) AS s, count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM
(SELECT x, y, k, sum(k) OVER (PARTITION BY x) AS kr, sum(k) OVER (PARTITION BY y) AS kc FROM (SELECT {x} AS x, cluster AS y, count(*)::DOUBLE AS k FROM m WHERE {x} IS NOT NULL GROUP BY ALL))))"""


_MEMBERS = f"{CORE}, {INVESTORS}, {LABELS}, m AS (SELECT lab.investor_id, lab.year, label AS cluster, investor_type, domicile, style, aum FROM lab JOIN inv USING (investor_id))"


def members(spark: SparkSession, sf: str) -> DataFrame:
    return A.labels(spark, sf).withColumnRenamed("label", "cluster").join(A.investors(spark, sf), "investor_id")


@query(f"WITH {_MEMBERS} SELECT count(*) AS n, round({_cramers_sql('domicile')}, 6) AS cramers_v FROM m")
def cramers_v(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cramers_v(members(spark, sf), "domicile", "cluster").select("n", F.round("cramers_v", 6).alias("cramers_v"))


_EPS = """(SELECT (sum(s * s / k) - sum(s) ** 2 / sum(k)) / (sum(q) - sum(s) ** 2 / sum(k)) FROM (SELECT cluster, count(*)::DOUBLE AS k, sum(r) AS s, sum(r * r) AS q FROM
(SELECT cluster, rank() OVER (ORDER BY aum) + (count(*) OVER (PARTITION BY aum) - 1) / 2.0::DOUBLE AS r FROM m WHERE aum IS NOT NULL) GROUP BY cluster))"""


@query(f"WITH {_MEMBERS} SELECT count(*) AS n, round({_EPS}, 6) AS eps_sq FROM m")
def rank_eps_sq(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rank_eps_sq(members(spark, sf), "aum", "cluster").select("n", F.round("eps_sq", 6).alias("eps_sq"))


@query(
    f"""WITH {_MEMBERS}, e AS (SELECT 'investor_type' AS attribute, 'geography' AS family, {_cramers_sql('investor_type')} AS effect UNION ALL SELECT 'domicile', 'geography', {_cramers_sql('domicile')}
UNION ALL SELECT 'style', 'style', {_cramers_sql('style')} UNION ALL SELECT 'aum', 'size', {_EPS})
SELECT attribute, family, round(effect, 6) AS effect, round(max(effect) OVER (PARTITION BY family), 6) AS family_max, (row_number() OVER (ORDER BY round(effect, 6) DESC, attribute))::INT AS nth FROM e"""
)
def association_ranking(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    family = {"investor_type": "geography", "domicile": "geography", "style": "style", "aum": "size"}
    parts = [stats.cramers_v(m, c, "cluster").select(F.lit(c).alias("attribute"), F.col("cramers_v").alias("effect")) for c in ("investor_type", "domicile", "style")]
    parts.append(stats.rank_eps_sq(m, "aum", "cluster").select(F.lit("aum").alias("attribute"), F.col("eps_sq").alias("effect")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kind = F.lit(None).cast("string")
    for a, f in family.items():
        kind = F.when(F.col("attribute") == a, f).otherwise(kind)
    rows = rows.withColumn("family", kind)
    nth = F.row_number().over(Window.orderBy(F.round("effect", 6).desc(), "attribute"))  # a row for each attribute
    return rows.select("attribute", "family", F.round("effect", 6).alias("effect"), F.round(F.max("effect").over(Window.partitionBy("family")), 6).alias("family_max"), nth.alias("nth"))


@query(
    f"""WITH {POS}, {ISSUERS} SELECT period, sum(CASE WHEN cap_group = 'large' THEN w END) IS NOT NULL AS has_large, count(*) AS n, round(sum(w) FILTER (issuer_id::INT % 2 = 0) / sum(w), 6) AS even_share FROM pos LEFT JOIN iss USING (issuer_id) GROUP BY period"""
)
def wide_export_check(spark: SparkSession, sf: str) -> DataFrame:
    p = A.positions(spark, sf).join(A.issuers(spark, sf).select("issuer_id", "cap_group"), "issuer_id", "left")
    even = F.sum(F.when(F.col("issuer_id").cast("int") % 2 == 0, F.col("w")))
    return p.groupBy("period").agg(F.sum(F.when(F.col("cap_group") == "large", F.col("w"))).isNotNull().alias("has_large"), F.count(F.lit(1)).alias("n"), F.round(even / F.sum("w"), 6).alias("even_share"))


