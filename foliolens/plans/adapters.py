"""The driver's tables seen as portfolio data, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.operators import holdings as H
from foliolens.sources.durable import cached, input_state

MIN_ISSUERS, MIN_INVESTORS, MOST, CONTEXT = 20, 3, 0.75, 62
KEYS = ["investor_id", "period"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The number of issuers in SQL: parts are listings, about ten to an issuer; there are no more issuers than token vectors, and 200 at least.
UNIVERSE = "(SELECT greatest(200, least((SELECT count(*) FROM part) // 10, (SELECT count(*) FROM embeddings))))"
N_VECTORS = "(SELECT count(*) FROM embeddings)"

_COUNTS: dict[tuple, int] = {}


def count_of(spark: SparkSession, sf: str, name: str) -> int:
    """The rows of a table, counted once for each application and state of its files."""
    key = (spark.sparkContext.applicationId, sf, name, input_state(spark, sf))
    if key not in _COUNTS:
        _COUNTS[key] = table(spark, sf, name).count()
    return _COUNTS[key]


def universe(spark: SparkSession, sf: str) -> int:
    """The number of issuers, which grows with the tables; listings are dealt to issuers by their number."""
    return max(200, min(count_of(spark, sf, "part") // 10, count_of(spark, sf, "embeddings")))


def issuer_of(spark: SparkSession, sf: str, listing: str) -> Column:
    return F.col(listing) % universe(spark, sf)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each line item: investor, issuer, report date, value."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("mv"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("report_date"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").cast("string").alias("investor_id"), issuer_of(spark, sf, "l_partkey").cast("string").alias("issuer_id"), "report_date", "mv", "l_orderkey", "l_linenumber", "l_partkey"
    )


def holdings(spark: SparkSession, sf: str, unit: str = "year") -> DataFrame:
    d = F.col("report_date")
    period = F.year(d) if unit == "year" else F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2))
    rows = raw(spark, sf).where("mv > 0").select("investor_id", "issuer_id", period.alias("period"), "mv")
    return H.aggregate_holdings(rows.repartition(*KEYS), ["investor_id", "issuer_id", "period"])  # dealt by book once, for the sums and all that follows


def panel(spark: SparkSession, sf: str, unit: str = "year") -> DataFrame:
    """The pruned panel, stored once for each application and data set."""
    return cached(spark, ("panel", sf, unit), lambda: H.core(H.not_concentrated(holdings(spark, sf, unit), KEYS, most=MOST), min_issuers=MIN_ISSUERS, min_investors=MIN_INVESTORS))


def positions(spark: SparkSession, sf: str, unit: str = "year") -> DataFrame:
    return H.weighed(cached(spark, ("positions", sf, unit), lambda: H.totalled(panel(spark, sf, unit), KEYS, CONTEXT)), CONTEXT)


def slices(spark: SparkSession, sf: str) -> DataFrame:
    return H.top_slice(positions(spark, sf), KEYS, CONTEXT)


def investors(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    style = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").alias("style"))
    s = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    s = s.join(style, s.s_suppkey % count_of(spark, sf, "embeddings") == style.v, "left")
    return s.select(F.col("s_suppkey").cast("string").alias("investor_id"), F.col("r_name").alias("investor_type"), F.col("n_name").alias("domicile"), F.col("s_acctbal").alias("aum"), "style")


def issuers(spark: SparkSession, sf: str) -> DataFrame:
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    p = p.join(n, p.p_partkey % 25 == n.n_nationkey)
    cap = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "mid").otherwise("large")
    return p.select(F.col("p_partkey").cast("string").alias("issuer_id"), F.col("p_name").alias("name"), F.col("p_type").alias("sector"), cap.alias("cap_group"), F.col("p_retailprice").alias("price"), F.col("n_name").alias("country"), F.col("p_brand").alias("brand"))


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("issuer_id"), F.col("embedding").alias("vec"))  # summed as doubles


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for fitted labels: investor-years labelled by a fixed rule over the embeddings' labels."""
    books = panel(spark, sf).select("investor_id", F.col("period").alias("year")).distinct()
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    key = (F.col("investor_id").cast("long") * 7 + F.floor(F.col("year") / 2) * 3) % count_of(spark, sf, "embeddings")
    return books.withColumn("k", key).join(e, F.col("k") == e.vec_id).select("investor_id", "year", "label")


def core_sql(unit: str = "year", min_issuers: int = MIN_ISSUERS, min_investors: int = MIN_INVESTORS, rounds: int | None = None) -> str:
    """Common table expressions raw, hold, conc, core with the pruning unrolled."""
    rounds = rounds or (4 if unit == "year" else 9)
    period = "year(report_date)::INT" if unit == "year" else "last_day(date_trunc('quarter', report_date)::DATE + INTERVAL 2 MONTH)"
    sql = f"""raw AS (SELECT l_suppkey::VARCHAR AS investor_id, (l_partkey % {UNIVERSE})::VARCHAR AS issuer_id, o_orderdate::DATE AS report_date,
  l_extendedprice * (1 - l_discount) AS mv, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hold AS (SELECT investor_id, issuer_id, {period} AS period, sum(mv) AS mv FROM raw WHERE mv > 0 GROUP BY ALL),
c0 AS (SELECT * FROM hold QUALIFY max(mv) OVER (PARTITION BY investor_id, period) / sum(mv) OVER (PARTITION BY investor_id, period) <= {MOST})"""
    for k in range(rounds):
        sql += f""",
a{k} AS (SELECT * FROM c{k} QUALIFY count(*) OVER (PARTITION BY investor_id, period) >= {min_issuers}),
c{k + 1} AS (SELECT * FROM a{k} QUALIFY count(*) OVER (PARTITION BY issuer_id, period) >= {min_investors})"""
    return sql + f",\ncore AS (SELECT * FROM c{rounds})"


CORE = core_sql()
POS = (
    CORE
    + """,
p0 AS (SELECT *, mv / sum(mv) OVER (PARTITION BY investor_id, period) AS w, (count(*) OVER (PARTITION BY investor_id, period))::INT AS n_assets_full,
  (row_number() OVER (PARTITION BY investor_id, period ORDER BY mv DESC, issuer_id))::INT AS rank FROM core),
pos AS (SELECT *, CASE WHEN n_assets_full <= 62 THEN 1 ELSE ceil(rank / ceil(n_assets_full / ceil(n_assets_full / 62.0)))::INT END AS chunk_id FROM p0),
top AS (SELECT *, w / sum(w) OVER (PARTITION BY investor_id, period) AS pw FROM pos WHERE rank <= 62)"""
)
INVESTORS = f"""inv AS (SELECT s_suppkey::VARCHAR AS investor_id, r_name AS investor_type, n_name AS domicile, s_acctbal AS aum, label AS style
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN embeddings ON vec_id = s_suppkey % {N_VECTORS})"""
ISSUERS = """iss AS (SELECT p_partkey::VARCHAR AS issuer_id, p_name AS name, p_type AS sector, CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'mid' ELSE 'large' END AS cap_group,
  p_retailprice AS price, n_name AS country, p_brand AS brand FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"""
LABELS = f"""lab AS (SELECT b.investor_id, b.year, e.label FROM (SELECT DISTINCT investor_id, period AS year FROM core) b
  JOIN embeddings e ON e.vec_id = (b.investor_id::BIGINT * 7 + (b.year // 2) * 3) % {N_VECTORS})"""
