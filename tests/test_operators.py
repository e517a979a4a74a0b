"""Operators against brute force on small frames."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens import schemas
from foliolens.functions import sequences as S
from foliolens.functions import stats, vectors
from foliolens.operators import align, assembly, dynamics, holdings, lenses, pooling, sphere
from foliolens.sources import durable, panel_files
from foliolens.streaming import incremental


@pytest.mark.parametrize(("n", "first"), [(62, 62), (63, 32), (100, 50), (124, 62), (125, 42), (187, 47), (1, 1)])
def test_chunks(spark, n, first):
    df = spark.range(1).select(S.chunks(F.sequence(F.lit(1), F.lit(n))).alias("c"))
    c = df.first()[0]
    assert [x for part in c for x in part] == list(range(1, n + 1))
    assert len(c[0]) == first and max(map(len, c)) <= 62 and len(c) == math.ceil(n / 62)
    longs = spark.range(1, n + 1).select(S.chunk_of(F.col("id"), F.lit(n)).alias("k")).groupBy("k").count().orderBy("k").collect()
    assert [r["count"] for r in longs] == list(map(len, c))


def test_core_needs_several_rounds(spark):
    rows = [("a", str(i)) for i in range(3)] + [("b", str(i)) for i in range(2)] + [("c", "2"), ("c", "9"), ("d", "0"), ("d", "1")]
    df = spark.createDataFrame([(i, s, 2000, 1.0) for i, s in rows], "investor_id string, issuer_id string, period int, mv double")
    got = {(r.investor_id, r.issuer_id) for r in holdings.core(df, min_issuers=2, min_investors=2).collect()}
    want = set(rows)
    while True:
        n = len(want)
        want = {x for x in want if sum(y[0] == x[0] for y in want) >= 2}
        want = {x for x in want if sum(y[1] == x[1] for y in want) >= 2}
        if len(want) == n:
            break
    assert got == want


def test_concentration_keeps_the_limit(spark):
    df = spark.createDataFrame([("a", 75.0), ("a", 25.0), ("b", 76.0), ("b", 24.0)], "investor_id string, mv double")
    assert {r.investor_id for r in holdings.not_concentrated(df, ["investor_id"]).collect()} == {"a"}


def test_weights_fall_back_to_uniform(spark):
    df = spark.createDataFrame([([-1.0, 0.0],), ([1.0, 3.0],), ([None, 2.0],)], "w array<double>")
    assert [r[0] for r in df.select(S.normalised(F.col("w"))).collect()] == [[0.5, 0.5], [0.25, 0.75], [0.0, 1.0]]


def test_halves_and_wrapping(spark):
    a, b = S.halves(F.sequence(F.lit(1), F.lit(5)))
    r = spark.range(1).select(a.alias("a"), b.alias("b"), S.wrapped(F.array(F.lit(7)), 3).alias("w")).first()
    assert (r.a, r.b, r.w) == ([1, 3, 5], [2, 4], [2, 7, 3, 0, 0])


def test_guards(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0)], "k int, x double")
    with pytest.raises(schemas.GateError):
        schemas.require_columns(df, ["k", "z"])
    with pytest.raises(schemas.GateError):
        schemas.assert_unique(df, ["k"])
    with pytest.raises(schemas.GateError):
        schemas.assert_rows(df, 3, "df")
    assert schemas.optional_columns(df, {"z": "string", "k": "int"}).columns == ["k", "x", "z"]
    assert sorted(r.x is None for r in schemas.nan_to_null(df).collect()) == [False, True]
    assert schemas.prefixed(df, "inst_", ["k"]).columns == ["k", "inst_x"]


def test_preflight_finds_faults(spark):
    rows = [("a", 1, ["x"], [1.0]), ("b", 2, ["x"], [1.0]), ("c", 1, ["x"], [0.5]), ("d", 1, ["x", "y"], [1.0])]
    seq = spark.createDataFrame(rows, "investor_id string, chunk_id int, tokens array<string>, weights array<double>")
    got = {r.investor_id: (r.sizes_ok, r.weights_ok, r.chunks_ok) for r in holdings.preflight(seq, ["investor_id"]).collect()}
    assert got == {"a": (True, True, True), "b": (True, True, False), "c": (True, False, True), "d": (False, True, True)}


def test_hungarian_against_all_assignments():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 6):
        m = rng.integers(0, 9, (n, n)).astype(float)
        best, total, margin = stats.hungarian_margin(m)
        assert sorted(best) == list(range(n)) and total == stats.best_by_trying(m) and margin >= 0


def test_chi_square_tail():
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.chi2_sf(2.0, 2) - math.exp(-1)) < 1e-12
    stat, df, _ = stats.chi_square(np.array([[10, 20], [20, 10]]))
    assert df == 1 and abs(stat - 20 / 3) < 1e-9


def test_statistics_below_their_least_size_are_null(spark):
    df = spark.createDataFrame([("a", "x", 1.0)] * 10, "g string, c string, v double")
    assert stats.cramers_v(df, "g", "c").first()["cramers_v"] is None
    assert stats.rank_eps_sq(df, "v", "g").first()["eps_sq"] is None
    assert stats.spearman(df.limit(5), "v", "v", ["g"]).first()["rho"] is None


def test_global_ranks_share_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 2, 5, 1, 1]], "x double")
    got = sorted((r.x, r.r) for r in stats.average_ranks(df, "x", "r").collect())
    assert got == [(1.0, 2.0)] * 3 + [(2.0, 4.5)] * 2 + [(3.0, 6.0), (5.0, 7.0)]


def test_numbers_ranks_and_quantiles_of_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, k, float(rng.integers(0, 30)), None if g == "z" else g) for g in ("a", "b", "z") for k in range({"a": 200, "b": 7, "z": 40}[g])]
    df = spark.createDataFrame(rows, "g string, k int, x double, h string").repartition(7)
    numbers = stats.row_numbers(df, ["h"], ["x", "k"], "n")
    for g in ("a", "b", None):
        mine = sorted((x, k) for _, k, x, h in rows if h == g)
        assert sorted((r.n, (r.x, r.k)) for r in numbers.collect() if r.h == g) == list(enumerate(mine, 1))
        values = np.array([x for x, _ in mine])
        q = next(r.q for r in stats.quantiles(df, "x", [0, 0.1, 0.5, 0.75, 1], ["h"]).collect() if r.h == g)
        assert np.allclose(q, np.quantile(values, [0, 0.1, 0.5, 0.75, 1]))
        rank = {r.k: r.r for r in stats.average_ranks(df, "x", "r", ["h"]).collect() if r.h == g}
        assert all(rank[k] == (values < x).sum() + ((values == x).sum() + 1) / 2 for x, k in mine)
    assert stats.quantiles(df.limit(0), "x", [0.5]).count() == 0
    assert [r.q for r in stats.quantiles(df.where("k = 3 AND g = 'b'"), "x", [0.5]).collect()] == [[next(x for g, k, x, _ in rows if (g, k) == ("b", 3))]]


def test_logit_and_half_even(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.5, 1.5), (1.0, 2.5)], "p double, x double")
    got = df.select(stats.clipped_logit(F.col("p")).alias("l"), stats.half_even(F.col("x")).alias("r")).collect()
    edge = math.log(1e-4 / (1 - 1e-4))
    assert np.allclose([r.l for r in got], [edge, 0, -edge]) and [r.r for r in got] == [0.0, 2.0, 2.0]


def test_quarter_labels(spark):
    df = spark.createDataFrame([("2020-Q1",), ("2021-Q4",), ("2021-Q5",), ("x",), (None,)], "l string")
    assert [r[0] for r in df.select(S.quarter_end_of(F.col("l"))).collect()] == [datetime.date(2020, 3, 31), datetime.date(2021, 12, 31), None, None, None]


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 2.0), ("a", 50.0, 0.0), ("a", None, 5.0)], "k string, x double, w double")
    assert stats.weighted_median(df, ["k"], "x", "w").first()["weighted_median"] == 2.0


def test_procrustes_recovers_a_rotation(spark):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(0, a.tolist(), b.tolist()) for a, b in zip(x, x @ q, strict=True)], "g int, a array<double>, b array<double>")
    r = align.procrustes(align.gram(df, "a", "b", ["g"])[(0,)])
    assert np.abs(r - q).max() < 1e-9
    c = align.chain({1: q, 2: q.T}, 2, [1, 2, 3])
    assert np.allclose(c[1], q) and np.allclose(c[3], q)
    moved = align.rotated(df, "a", {0: r}, "g", "m")
    assert moved.select(F.max(F.abs(align.displacement(moved, "m", "m"))).alias("d")).first()["d"] is not None


def test_overlap_counts_absent_items_as_nothing(spark):
    a = spark.createDataFrame([("i", "x", 0.5), ("i", "x", 0.2), ("i", "y", 0.3), ("j", "x", 1.0), ("k", "x", 1.0)], "id string, issuer_id string, pw double")
    b = spark.createDataFrame([("i", "x", 0.6), ("i", "z", 0.4), ("j", "q", 1.0)], "id string, issuer_id string, pw double")
    got = {r.id: round(r.wt_overlap, 9) for r in align.holdings_overlap(a, b, ["id"]).collect()}
    assert got == {"i": 0.6, "j": 0.0}


def _cauchy(rng, n, mu, rho):
    """Points of a spherical Cauchy law: uniform points under a Moebius map."""
    d = len(mu)
    u = rng.normal(size=(n, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = rho * mu
    return (1 - rho**2) * (u + g) / ((u + g) ** 2).sum(axis=1, keepdims=True) + g


def test_mixture_recovers_its_parameters(spark):
    rng = np.random.default_rng(3)
    m1, m2 = np.eye(6)[0], np.eye(6)[1]
    x = np.vstack([_cauchy(rng, 600, m1, 0.6), _cauchy(rng, 300, m2, 0.7)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    start = sphere.Mixture(np.stack([np.ones(6) / 6**0.5 + 0.3 * m1, np.ones(6) / 6**0.5 + 0.3 * m2]), np.full(2, 0.3), np.full(2, 0.5))
    start.mu /= np.linalg.norm(start.mu, axis=1, keepdims=True)
    m = sphere.spherical_cauchy_em(df, start, rounds=40)
    assert all(b >= a - 1e-6 for a, b in zip(m.trace, m.trace[1:], strict=False))
    assert abs(m.rho[0] - 0.6) < 0.06 and abs(m.rho[1] - 0.7) < 0.06 and abs(m.pi[0] - 2 / 3) < 0.05
    post = sphere.assign(df, m, ["id"])
    assert abs(post.select(F.max(F.abs(F.aggregate("posterior", F.lit(0.0), lambda s, v: s + v) - 1))).first()[0]) < 1e-9
    again = sphere.from_psi(m.mu * m.rho[:, None], m.pi)
    assert np.abs(sphere.posterior(x, again.mu, again.rho, again.pi)[0] - sphere.posterior(x, m.mu, m.rho, m.pi)[0]).max() < 1e-9


def test_kmeans_improves_and_keeps_empty_clusters(spark):
    rng = np.random.default_rng(4)
    x = _cauchy(rng, 200, np.eye(4)[0], 0.8)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    centres, trace = sphere.spherical_kmeans(df, np.stack([np.eye(4)[0], -np.eye(4)[0]]))
    assert trace[-1] >= trace[0] - 1e-9 and np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_pooling_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 0.0), ("a", [0.0, 1.0], 0.0), ("b", [1.0, 0.0], 3.0), ("b", [0.0, 1.0], 4.0)], "k string, vec array<double>, w double")
    got = {r.k: [round(v, 6) for v in r.embedding] for r in pooling.pooled(df, ["k"], weight="w", d=2).collect()}
    assert got == {"a": [0.707107, 0.707107], "b": [0.6, 0.8]}


def test_lift_and_distinctive(spark):
    df = spark.createDataFrame([("c1", "x", 1.0)] * 3 + [("c1", "y", 1.0)] + [("c2", "y", 1.0)] * 4, "c string, g string, w double")
    rows = lenses.lift_table(df, "c", "g", F.col("w"), min_n=1, top=1).collect()
    assert {(r.c, r.category, r.lift) for r in rows} == {("c1", "x", 2.0), ("c2", "y", 1.6)}


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "x double")
    assert [r[0] for r in df.orderBy("x").select(stats.cut(F.col("x"), [0.0, 1.0, 3.0])).collect()] == [1, 1, 2, 2]


def test_durable_tables(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    path = f"file://{tmp_path}/t"
    assert durable.materialised(spark, path, make).count() == 3 and durable.materialised(spark, path, make).count() == 3
    assert len(made) == 1
    assert durable.covering(spark, path, spark.range(2), make).count() == 3 and len(made) == 1
    durable.covering(spark, path, spark.range(9), make)
    assert len(made) == 2
    durable.save_model(spark, f"file://{tmp_path}/m", spark.range(1), {"k": 3, "n": 5})
    assert durable.load_model(spark, f"file://{tmp_path}/m", {"k": 3}) is not None
    assert durable.load_model(spark, f"file://{tmp_path}/m", {"k": 4}) is None
    assert durable.load_model(spark, f"file://{tmp_path}/none", {"k": 4}) is None


def test_panel_sink_deals_quarters_and_removes_twins(spark, tmp_path):
    path, day = f"file://{tmp_path}/panel", datetime.date(2020, 6, 30)
    stale = spark.createDataFrame([(datetime.date(2020, 7, 1), "old")], "quarter_end date, investor_id string")
    assert panel_files.write_panel(stale, path) == ["2020-07-01"]
    df = spark.createDataFrame([(day, f"i{k}") for k in range(200)], "quarter_end date, investor_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert panel_files.write_panel(df, path) == ["2020-06-30"] and panel_files.write_panel(df, path) == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(panel_files.quarter_folders(spark, path)) == ["2020-06-30"] and spark.read.parquet(path).count() == 200
    assert len(list((tmp_path / "panel" / "quarter_end=2020-06-30").glob("*.parquet"))) > 1


def test_lookups_by_id_lists(spark, tmp_path):
    assert panel_files.id_predicates("id", ["b", None, "a", "it's", "b"], 2, "x > 1") == ["id IN ('a', 'b') AND (x > 1)", "id IN ('it''s') AND (x > 1)"]
    table, tried, reopened = spark.createDataFrame([(k, k * 2.0) for k in range(20)], "id long, x double"), [], []

    def read(predicates):
        tried.append(predicates)
        if len(tried) < 3:
            raise ConnectionError("lost")
        return panel_files.union_present([table.where(p) for p in predicates])

    ids = spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "id long")
    got = panel_files.fetch_by_id_lists(read, "id", ids, f"file://{tmp_path}/got", chunk=2, wait=0)
    assert sorted(r.id for r in got.collect()) == [3, 7] and len(tried) == 3 and tried[0] == ["id IN (3, 7)", "id IN (99)"]
    assert panel_files.fetch_by_id_lists(read, "id", ids.limit(0), f"file://{tmp_path}/none") is None
    with pytest.raises(ConnectionError):
        panel_files.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), attempts=3, wait=0, reopen=lambda: reopened.append(1))
    assert len(reopened) == 2
    assert panel_files.union_present([None, table, None]).count() == 20 and panel_files.union_present([None]) is None


def test_reports_become_holdings(spark):
    q, d = datetime.date(2020, 3, 31), lambda k: datetime.date(2020, 3, 31) + datetime.timedelta(days=k)
    rows = [("h", "HF", q, d(7), "x", 1.0), ("h", "HF", q, d(-7), "x", 2.0), ("h", "HF", q, d(8), "x", 4.0), ("f", "ETF", q, d(1), "x", 1.0), ("f", "ETF", q, d(5), "x", 3.0), ("f", "ETF", q, d(5), "x", 2.0), ("f", "ETF", q, d(6), "x", 9.0)]
    rows += [("p", "PF", q, d(0), "x", 1.0), ("f", "ETF", q, d(0), None, 1.0), ("f", "ETF", q, d(0), "y", -1.0)]
    df = spark.createDataFrame(rows, "investor_id string, investor_type string, quarter_end date, report_date date, issuer_id string, mv double")
    got = {(r.investor_id, r.issuer_id): r.mv for r in holdings.reported(df, ("HF",), ("ETF",), 7, 5).collect()}
    assert got == {("h", "x"): 3.0, ("f", "x"): 3.0}


def test_caches_follow_their_input(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(3).write.parquet(path)
    make = lambda: spark.read.parquet(path)
    assert durable.cached(spark, ("rows", path), make).count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert durable.cached(spark, ("rows", path), make).count() == 5


def test_assembly_keeps_rows(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    dim = spark.createDataFrame([("a", 7), ("c", 8)], "k string, n int")
    rows = assembly.assembled(base, {"one": dim, "two": dim}, "k").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("a", 1, 7, 7), ("b", 2, None, None), (None, 3, None, None)], key=str)
    with pytest.raises(schemas.GateError):
        assembly.assembled(base, {"one": dim.unionByName(dim)}, "k")
    lookup = spark.createDataFrame([("a", 5), ("a", 4)], "k string, x int")
    assert {(r.k, r.x) for r in assembly.first_match(base, lookup, "k", ["x"]).collect()} == {("a", 4), ("b", None), (None, None)}
    assert {(r.k, r.x) for r in assembly.all_of(base.select("k"), lookup.where("x = 4"), "k").collect()} == {("a", 4), ("b", None), (None, None)}


def test_pairs_batches_and_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = pooling.sampled_pairs(df, "vec_id", 500).select("i", "j", "a_vec_id", "b_vec_id").collect()
    assert 450 < len(pairs) <= 500 and all(r.i == r.a_vec_id and r.j == r.b_vec_id and r.i != r.j for r in pairs)
    sizes = [r["count"] for r in pooling.batched(df.withColumn("g", F.lit(1)), "g", "vec_id", 32).groupBy("batch").count().collect()]
    assert sum(sizes) == 120 and len(sizes) == 4
    for block in (7, 1000):  # several query blocks, and one
        got = {}
        for r in pooling.nearest(df.where("vec_id % 5 = 0"), df, 6, block_rows=block).collect():
            got.setdefault(r["query"], {})[r["nth"]] = r["neighbour"]
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        assert {q: [n[k] for k in sorted(n)] for q, n in got.items()} == {q: np.argsort(-cos[q], kind="stable")[:6].tolist() for q in range(0, 120, 5)}
    split = pooling.hash_split(df, "vec_id").groupBy("is_train").count().collect()
    assert sum(r["count"] for r in split) == 120 and {r["is_train"] for r in split} == {True, False}
    odd = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],)], "embedding array<double>")
    assert pooling.valid_vectors(odd).count() == 1


def test_wide_and_array_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    wide = df.select(*vectors.array_to_wide(F.col("v"), 3))
    assert wide.columns == ["dim_000", "dim_001", "dim_002"] and wide.select(vectors.wide_to_array(wide.columns[::-1])).first()[0] == [1.0, 2.0, 3.0]


def test_anchors_fall_back_to_the_most_stable(spark):
    rows = [(2000, f"i{k}", "s", k / 100) for k in range(100)] + [(2001, f"i{k}", "s", 0.5 + k / 1000) for k in range(100)]
    df = spark.createDataFrame(rows, "year int, investor_id string, kind string, wt_overlap double")
    got = {}
    for r in align.anchors(df, "stable_thr", "year", "investor_id", least=10).collect():
        got.setdefault(r.year, set()).add(r.investor_id)
    assert got == {2000: {f"i{k}" for k in range(85, 100)}, 2001: {f"i{k}" for k in range(90, 100)}}
    assert align.anchors(df, "stable_strat", "year", "investor_id", "kind").groupBy("year").count().where("count = 25").count() == 2


def test_noise_floor_of_a_rotated_copy_is_zero(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    a, b = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, embedding array<double>") for m in (x, x @ q.T))
    r, d = align.noise_floor(a, b, "id")
    assert np.abs(r - q).max() < 1e-9 and d.select(F.max(F.abs("displacement"))).first()[0] < 1e-9
    pairs = a.select(F.lit(1).alias("g"), "id", F.col("embedding").alias("a")).join(b.select("id", F.col("embedding").alias("b")), "id")
    dealt = align.shuffled_pairs(pairs, "g", "id", 3).groupBy("seed").agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert [(r.a, r.b, r.n) for r in dealt] == [(60, 60, 60)] * 3


def test_k_scan_prefers_the_true_number(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([_cauchy(rng, 150, np.eye(6)[k], 0.8) for k in range(3)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    rows = {(r.method, r.k): r for r in sphere.scan_k(df, "id", ks=(2, 3, 4), restarts=2, fits=4, rounds=30).collect()}
    assert len(rows) == 6 and all(r.pairs == 6 for r in rows.values())
    assert min((r.criterion, k) for (m, k), r in rows.items() if m == "mixture")[1] == 3
    assert rows["mixture", 3].ari_mean > 0.95 and rows["kmeans", 3].ari_mean > 0.95 and rows["kmeans", 4].ari_mean < rows["kmeans", 3].ari_mean
    local, fit = sphere.local_mixture(x, 3, 1, rounds=40), sphere.Mixture
    start = fit(local.mu.copy(), local.rho.copy(), local.pi.copy())
    assert abs(sphere.spherical_cauchy_em(df, start, rounds=3).loglik - local.loglik) < 1e-3 * abs(local.loglik)
    assert sphere.effective_floor(0.01, 1000) == 0.15 and sphere.effective_floor(0.01, 10**6) == 0.01


def test_refits_of_all_groups_equal_single_fits(spark):
    rng = np.random.default_rng(12)
    rows, starts, single = [], {}, {}
    for g in (1, 2):
        x = np.vstack([_cauchy(rng, 200, np.eye(5)[0], 0.7), _cauchy(rng, 100, np.eye(5)[g], 0.7)])
        rows += [(g, k, v.tolist()) for k, v in enumerate(x)]
        starts[g] = sphere.Mixture(np.stack([np.eye(5)[0], np.eye(5)[g]]), np.full(2, 0.3), np.full(2, 0.5))
    df = spark.createDataFrame(rows, "g int, id int, embedding array<double>")
    for g in (1, 2):
        single[g] = sphere.spherical_cauchy_em(df.where(F.col("g") == g), sphere.Mixture(starts[g].mu.copy(), np.full(2, 0.3), np.full(2, 0.5)), rounds=6)
    fits = dynamics.refit_by(df, "g", starts, rounds=6, floor=0.0)
    assert all(np.allclose(fits[g].mu, single[g].mu) and abs(fits[g].loglik - single[g].loglik) < 1e-6 for g in (1, 2))
    labels = dynamics.assigned_by(df, "g", fits, ["g", "id"])
    assert labels.count() == 600 and labels.where("label = 0").count() > 300
    table = dynamics.refit_persistence(fits, fits[1], {1: {(0, 0): 5, (1, 1): 5}, 2: {(0, 0): 5, (1, 1): 5}})
    assert table[0][:4] == (1, 2, 1.0, pytest.approx(1.0)) and table[0][6] == 1.0


def test_panel_files(spark, tmp_path):
    day = datetime.date(2020, 3, 31)
    df = spark.createDataFrame([(day, "a", 1.0)], "quarter_end date, investor_id string, w double")
    path = f"file://{tmp_path}/panel"
    panel_files.write_panel(df, path)
    panel_files.write_panel(df.withColumn("w", F.lit(9.0)), path)  # the quarter exists and stays
    assert [r.w for r in spark.read.parquet(path).collect()] == [1.0]
    panel_files.write_panel(df.withColumn("w", F.lit(9.0)), path, overwrite=True)
    assert [r.w for r in spark.read.parquet(path).collect()] == [9.0]
    df.coalesce(1).write.parquet(f"file://{tmp_path}/files/q_2020-03-31.parquet")
    assert panel_files.read_panel(spark, f"file://{tmp_path}/files", ["investor_id"]).first().file_quarter == day
    assert panel_files.has_columns(spark, path, ["w"]) and not panel_files.has_columns(spark, path, ["weights"])
    with pytest.raises(ValueError, match="no quarter"):
        panel_files.select_quarters(df, only="2021-03-31")
    assert panel_files.select_quarters(df, start="2020-01-01", end="2020-12-31").count() == 1


def test_training_history(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"pretrain_log": [{"epoch": 1, "loss": 2.5}, {"epoch": 1, "eval_loss": 2.0}], "finetune": [0.5, 0.25]}))
    rows = {(r.metric, r.epoch, r.value) for r in panel_files.training_history(spark, f"file://{tmp_path}/h.json", "mean").collect()}
    assert rows == {("train", 1.0, 2.5), ("eval", 1.0, 2.0), ("finetune", 1.0, 0.5), ("finetune", 2.0, 0.25)}


def test_incremental_pairs(spark, tmp_path):
    src, table = tmp_path / "src", f"file://{tmp_path}/pairs"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "e string, p int").coalesce(1).write.parquet(f"{src}/x=1")
    run = lambda: incremental.accumulate_pairs(spark, spark.readStream.schema("e string, p int").option("recursiveFileLookup", "true").parquet(str(src)), ["e", "p"], table, f"{tmp_path}/ck").awaitTermination()
    run()
    spark.createDataFrame([("a", 1), ("c", 3)], "e string, p int").coalesce(1).write.parquet(f"{src}/x=2")
    run()
    got = sorted((r.e, r.p) for r in spark.read.option("recursiveFileLookup", "true").schema("e string, p int").parquet(table).collect())
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_event_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    q = incremental.event_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/e")).writeStream.outputMode("complete").format("memory").queryName("ev").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ev").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/e").count()


def test_encoders_and_coverage(spark):
    from foliolens.operators import encoder as E

    seq = spark.createDataFrame([(["[CLS]", *[str(k) for k in range(100)]],)] * 3, "tokens array<string>")
    t = E.real_tokens(F.col("tokens"))
    got = seq.select(*[F.transform(E.covered(t, c), F.size).alias(c.replace("-", "_")) for c in ("paper", "first-chunk", "all-chunks", "full-sequence")]).first()
    assert tuple(got) == ([62], [50], [50, 50], [100])
    v = E.Word2VecEncoder(d=8).vectors(seq)
    assert v.count() == 100 and v.select(F.size("vec")).first()[0] == 8
    table = E.TableEncoder(spark.createDataFrame([("1", [1.0]), ("x", [2.0])], "issuer_id string, vec array<double>"))
    assert [r.issuer_id for r in table.vectors(seq).collect()] == ["1"]
    assert [r.k for r in E.relabelled(spark.createDataFrame([(0,), (1,)], "k int"), "k", [1, 0]).collect()] == [1, 0]


def test_command_line(spark, tmp_path, capsys):
    from foliolens import cli

    rows = [(f"i{i}", datetime.date(2020, 3, 31), str(s), 1.0 + s) for i in range(4) for s in range(5)]
    spark.createDataFrame(rows, "investor_id string, quarter_end date, issuer_id string, adj_mv double").write.parquet(f"{tmp_path}/h")
    args = ["build", f"{tmp_path}/h", f"{tmp_path}/p", "--min-issuers", "2", "--min-investors", "2"]
    assert cli.main([*args, "--dry-run"]) == 0 and not (tmp_path / "p").exists()
    assert cli.main(args) == 0 and cli.main(["preflight", f"{tmp_path}/p"]) == 0
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4 and "2020-03-31" in capsys.readouterr().out
    assert cli.main(["preflight", f"{tmp_path}/h"]) == 1
    vec = {str(s): np.eye(5)[s].tolist() for s in range(5)}
    spark.createDataFrame(list(vec.items()), "issuer_id string, vec array<double>").write.parquet(f"{tmp_path}/v")
    for extra, weights in ((["--pooling", "mean"], np.ones(5)), (["--weight-scheme", "zipf"], 1 / np.arange(5, 0, -1)), (["--coverage", "all-chunks"], np.ones(5)), (["--coverage", "full-sequence"], np.arange(1, 6) / 15)):
        assert cli.main(["encode", f"{tmp_path}/p", f"{tmp_path}/v", f"{tmp_path}/e", "--d", "5", *extra]) == 0
        path = capsys.readouterr().out.strip().splitlines()[-1]
        got = spark.read.parquet(path).collect()
        assert len(got) == 4 and all(np.allclose(r.embedding, weights / np.linalg.norm(weights)) for r in got)


def test_command_line_of_models(spark, tmp_path):
    from foliolens import cli

    rng = np.random.default_rng(13)
    x = np.vstack([_cauchy(rng, 120, np.eye(5)[k], 0.8) for k in range(2)])
    df = spark.createDataFrame([(f"i{k}", v.tolist()) for k, v in enumerate(x)] + [("bad", [0.0] * 5)], "investor_id string, embedding array<double>")
    df.write.parquet(f"{tmp_path}/v")
    assert cli.main(["cluster", f"{tmp_path}/v", f"{tmp_path}/c", "--k", "2", "--restarts", "1", "--least-members", "10"]) == 0
    labels = spark.read.parquet(f"{tmp_path}/c/labels")
    assert labels.count() == 240 and labels.where("home").count() > 200 and spark.read.parquet(f"{tmp_path}/c/model/params").count() == 2
    years = labels.select("investor_id", "label", "max_post", F.explode(F.array(F.lit(2000), F.lit(2001), F.lit(2002))).alias("year"))
    years.write.parquet(f"{tmp_path}/l")
    assert cli.main(["dynamics", f"{tmp_path}/l", f"{tmp_path}/d"]) == 0
    assert {(r.year, r.subset, r.switches) for r in spark.read.parquet(f"{tmp_path}/d/rates").collect()} >= {(2000, "all", 0), (2001, "all", 0)}
    assert {(r.h, r.year0, r.same) for r in spark.read.parquet(f"{tmp_path}/d/persistence").collect()} == {(1, 2000, 1.0), (1, 2001, 1.0), (2, 2000, 1.0)}
