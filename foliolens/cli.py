"""The pipeline's stages over files: python -m foliolens.cli build|preflight|encode|cluster|dynamics ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliolens.config import BuildConfig, ClusterConfig, DynamicsConfig, EncodeConfig
from foliolens.functions.sequences import rank_weights
from foliolens.operators import dynamics as DY
from foliolens.operators import encoder as E
from foliolens.operators import holdings as H
from foliolens.operators import pooling as P
from foliolens.operators import sphere as SP
from foliolens.schemas import GateError, assert_unique, require_columns
from foliolens.sources.durable import load_model, save_model, stored
from foliolens.sources.panel_files import select_quarters, write_panel

KEYS = ["investor_id", "quarter_end"]


def build(spark: SparkSession, source: str, target: str, config: BuildConfig, only: str | None, start: str | None, end: str | None, dry_run: bool) -> list[str]:
    """Sequences of all chosen quarters in one job; returns the quarters."""
    rows = require_columns(spark.read.parquet(source), ["investor_id", "quarter_end", "issuer_id", "adj_mv"])
    rows = select_quarters(rows.withColumn("quarter_end", F.col("quarter_end").cast("date")), only, start, end)
    quarters = [str(r[0]) for r in rows.select("quarter_end").distinct().orderBy("quarter_end").collect()]
    if not dry_run:
        rows = rows.withColumnRenamed("adj_mv", "mv")
        if "report_date" in rows.columns:  # reports, not yet holdings
            rows = H.reported(require_columns(rows, ["investor_type"]), config.filer_types, config.fund_types, config.filer_window_days, config.fund_window_days)
        book = H.aggregate_holdings(rows.select(*KEYS, "issuer_id", "mv"), [*KEYS, "issuer_id"])
        core = H.core(H.not_concentrated(book, KEYS, most=config.most_concentrated), "quarter_end", min_issuers=config.min_issuers, min_investors=config.min_investors)
        write_panel(H.sequences(H.positions(core, KEYS, config.context), KEYS), target, config.overwrite)
    return quarters


def preflight(spark: SparkSession, panel: str) -> list[str]:
    """All problems of a panel; none if it is sound."""
    seq = require_columns(spark.read.parquet(panel), [*KEYS, "chunk_id", "tokens", "weights"])
    report = H.preflight(seq, KEYS)
    bad = report.groupBy("quarter_end").agg(*[F.sum(F.when(F.col(c), 0).otherwise(1)).alias(c) for c in ("sizes_ok", "weights_ok", "chunks_ok")])
    return [f"{r.quarter_end}: {r[c]} books fail {c}" for r in bad.orderBy("quarter_end").collect() for c in ("sizes_ok", "weights_ok", "chunks_ok") if r[c]]


def encode(spark: SparkSession, panel: str, vectors: str, target: str, config: EncodeConfig) -> str:
    """One vector for each book of a panel from its tokens' vectors (issuer_id, vec); returns the folder."""
    books = H.joined_books(require_columns(spark.read.parquet(panel), [*KEYS, "chunk_id", "tokens", "weights"]), KEYS)
    items = F.filter(F.arrays_zip("tokens", "weights"), lambda t: ~t["tokens"].rlike(r"^\["))
    pieces = books.select(*KEYS, F.posexplode(E.covered(items, config.coverage, config.context)).alias("chunk_id", "piece"))
    if config.weight_scheme == "holdings":
        rows = pieces.select(*KEYS, "chunk_id", F.explode("piece").alias("item")).select(*KEYS, "chunk_id", F.col("item.tokens").alias("issuer_id"), F.col("item.weights").alias("w"))
    else:
        w = F.when(F.size("piece") > 0, rank_weights(F.greatest(F.size("piece"), F.lit(1)), config.weight_scheme, config.weight_alpha))
        rows = pieces.withColumn("ws", w).select(*KEYS, "chunk_id", "ws", F.posexplode("piece").alias("pos", "item"))
        rows = rows.select(*KEYS, "chunk_id", F.col("item.tokens").alias("issuer_id"), F.get("ws", F.col("pos")).alias("w"))
    rows = rows.join(spark.read.parquet(vectors).select("issuer_id", "vec"), "issuer_id")
    if config.coverage == "all-chunks":
        out = P.all_chunks(rows, KEYS, d=config.d)
    else:
        out = P.pooled(rows, KEYS, weight="w" if config.pooling == "weighted" else None, d=config.d)
    out.write.mode("overwrite").parquet(f"{target}/{config.tag}")
    return f"{target}/{config.tag}"


def cluster(spark: SparkSession, vectors: str, target: str, config: ClusterConfig) -> int:
    """Fit a mixture to the valid vectors of one quarter, save it with its provenance, read it back, and label the
    vectors with what was read; returns the number of components."""
    rows = stored(assert_unique(P.valid_vectors(require_columns(spark.read.parquet(vectors), ["investor_id", "embedding"])), ["investor_id"]), "valid")
    m, counts = SP.fit_clusters(rows, "investor_id", config)
    if m is None:
        raise GateError(f"no start kept {config.k} components: {counts}")
    provenance = {"k": m.k, "n": rows.count(), "seed": config.seed, "source": vectors}
    psi = spark.createDataFrame([(k, [float(x) for x in mu * rho], float(p)) for k, (mu, rho, p) in enumerate(zip(m.mu, m.rho, m.pi, strict=True))], "k int, psi array<double>, pi double")
    save_model(spark, f"{target}/model", psi, provenance)
    read = SP.verified(load_model(spark, f"{target}/model", provenance), m, rows)
    home = (F.col("max_post") >= config.home_threshold).alias("home")
    SP.assign(rows, read, ["investor_id"]).select("investor_id", "label", "max_post", "loglik", home).write.mode("overwrite").parquet(f"{target}/labels")
    return m.k


def dynamics(spark: SparkSession, labels: str, target: str, config: DynamicsConfig) -> None:
    """Switch rates and persistence of labels (investor_id, year, label, max_post)."""
    rows = require_columns(spark.read.parquet(labels), ["investor_id", "year", "label", "max_post"])
    steps = DY.label_steps(rows)
    sure = (F.col("max_post_from") >= config.confident) & (F.col("max_post_to") >= config.confident)
    DY.switch_rates(steps, {"confident": sure}).write.mode("overwrite").parquet(f"{target}/rates")
    DY.persistence(rows, horizons=config.horizons, least=config.least_common).write.mode("overwrite").parquet(f"{target}/persistence")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliolens")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("source")
    b.add_argument("target")
    for name in ("only", "start", "end"):
        b.add_argument(f"--{name}")
    b.add_argument("--dry-run", action="store_true")
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--min-issuers", type=int, default=BuildConfig.min_issuers)
    b.add_argument("--min-investors", type=int, default=BuildConfig.min_investors)
    c = sub.add_parser("preflight")
    c.add_argument("panel")
    c.add_argument("--quiet", action="store_true")
    e = sub.add_parser("encode")
    for name in ("panel", "vectors", "target"):
        e.add_argument(name)
    e.add_argument("--d", type=int, default=EncodeConfig.d)
    e.add_argument("--pooling", choices=["weighted", "mean"], default=EncodeConfig.pooling)
    e.add_argument("--coverage", choices=["paper", "first-chunk", "all-chunks", "full-sequence"], default=EncodeConfig.coverage)
    e.add_argument("--weight-scheme", choices=["holdings", "uniform", "zipf", "power", "exp"], default=EncodeConfig.weight_scheme)
    e.add_argument("--weight-alpha", type=float, default=EncodeConfig.weight_alpha)
    k = sub.add_parser("cluster")
    for name in ("vectors", "target"):
        k.add_argument(name)
    k.add_argument("--k", type=int, default=ClusterConfig.k)
    k.add_argument("--restarts", type=int, default=ClusterConfig.restarts)
    k.add_argument("--seed", type=int, default=ClusterConfig.seed)
    k.add_argument("--least-members", type=int, default=ClusterConfig.least_members)
    d = sub.add_parser("dynamics")
    for name in ("labels", "target"):
        d.add_argument(name)
    d.add_argument("--least-common", type=int, default=DynamicsConfig.least_common)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("foliolens").getOrCreate()
    if a.command == "build":
        config = BuildConfig(min_issuers=a.min_issuers, min_investors=a.min_investors, overwrite=a.overwrite)
        print("\n".join(build(spark, a.source, a.target, config, a.only, a.start, a.end, a.dry_run)))
        return 0
    if a.command == "encode":
        print(encode(spark, a.panel, a.vectors, a.target, EncodeConfig(d=a.d, pooling=a.pooling, coverage=a.coverage, weight_scheme=a.weight_scheme, weight_alpha=a.weight_alpha)))
        return 0
    if a.command == "cluster":
        print(cluster(spark, a.vectors, a.target, ClusterConfig(k=a.k, restarts=a.restarts, seed=a.seed, least_members=a.least_members)))
        return 0
    if a.command == "dynamics":
        dynamics(spark, a.labels, a.target, DynamicsConfig(least_common=a.least_common))
        return 0
    try:
        problems = preflight(spark, a.panel)
    except GateError as e:
        problems = [str(e)]
    if problems or not a.quiet:
        print("\n".join(problems) or "sound")
    return int(bool(problems))


if __name__ == "__main__":
    sys.exit(main())
