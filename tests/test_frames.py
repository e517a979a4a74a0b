"""Anchor rules, leave-one-out checks and grouped k-means against separate fits in numpy."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens.functions import stats
from foliolens.operators import align, contrastive, dynamics, frames, holdings, pooling, sphere
from foliolens.sources import panel_files

D = 4


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def panel(spark):
    """Two steps of 300 rows: b is a turned and noisy, the more so the less overlap; label and stratum by a's first entry."""
    rng, rows, held = np.random.default_rng(2), [], {}
    for year in (2001, 2002):
        r = np.linalg.qr(rng.normal(size=(D, D)))[0]
        a, s = unit(rng.normal(size=(300, D))), rng.random(300)
        b = unit(a @ r + rng.normal(size=(300, D)) * (1 - s)[:, None] * 0.5)
        held[year] = r
        rows += [(year, f"i{k}", float(s[k]), int(a[k, 0] > 0) + int(a[k, 1] > 0), a[k].tolist(), b[k].tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "year int, investor_id string, wt_overlap double, label int, a array<double>, b array<double>").repartition(7, "investor_id")
    return df, rows, held


def out_of(rows, year):
    at = [r for r in rows if r[0] == year]
    return np.array([r[2] for r in at]), np.array([r[3] for r in at]), np.array([r[4] for r in at]), np.array([r[5] for r in at]), [r[1] for r in at]


def chosen(rule, s, stratum, inside, ids, least, at):
    if rule == "all":
        return inside
    if rule == "stable_thr":
        own = inside & (s >= at)
        if own.sum() >= least:
            return own
        order = sorted(np.flatnonzero(inside), key=lambda k: (-s[k], ids[k]))[:least]
        return np.isin(np.arange(len(s)), order)
    cuts = {g: np.quantile(s[inside & (stratum == g)], 0.75) for g in set(stratum[inside])}
    return inside & np.array([x >= cuts.get(g, np.inf) for x, g in zip(s, stratum, strict=True)])


@pytest.mark.parametrize(("least", "at"), [(20, 0.5), (100, 0.9)])
def test_all_rules_from_one_cube_equal_separate_fits(panel, least, at):
    df, rows, _ = panel
    rotations, table = frames.by_rule(frames.memberships(df, "year", "investor_id", "label", least, at), "year", times=5)
    assert {(r["year"], r["rule"]) for r in table} == {(y, r) for y in (2001, 2002) for r in frames.RULES}
    for r in table:
        s, stratum, a, b, ids = out_of(rows, r["year"])
        held = np.array([int(hashlib.md5(f"7/{r['year']}/{i}".encode()).hexdigest()[:8], 16) % 5 == 0 for i in ids])
        fin, train = (chosen(r["rule"], s, stratum, inside, ids, least, at) for inside in (np.ones(len(s), bool), ~held))
        assert (r["n_anchor"], r["n_train"], r["n_held"]) == (fin.sum(), train.sum(), held.sum())
        assert r["fallback"] == (r["rule"] == "stable_thr" and (s >= at).sum() < least)
        assert np.allclose(rotations[r["rule"], r["year"]], align.procrustes(a[fin].T @ b[fin]))
        fitted = align.procrustes(a[train].T @ b[train])
        cos = ((a @ fitted) * b).sum(axis=1)
        assert r["cos_all"] == pytest.approx(cos[held].mean())
        assert r["cos_stable"] == (pytest.approx(cos[held & (s >= at)].mean()) if (held & (s >= at)).sum() >= 5 else None)
        e = np.linalg.svd(a[train], compute_uv=False) ** 2
        assert r["eff_rank"] == pytest.approx(e.sum() ** 2 / (e**2).sum())
        assert r["cos_null"] < 0.5 < r["cos_all"]


def test_cube_is_read_once(panel):
    plan = []
    frames.by_rule(frames.memberships(panel[0], "year", "investor_id", "label", 20, 0.5), "year", times=2)
    rows = frames.memberships(panel[0], "year", "investor_id", "label", 20, 0.5)
    cells, deals = frames.cube(rows, ["year", "mem"], {"all": 3}, 3)
    assert sum(n for n, _, _ in cells.values()) == 600 and {len(v) for v in deals.values()} == {3}
    plan.append(frames.added(cells, lambda y, m: y == 2001))
    assert plan[0][0] == 300 and frames.added(cells, lambda y, m: y == 1999) is None


def test_pairs_dealt_at_random_never_meet_their_own(spark):
    eye = np.eye(3)
    rows = [(1, 8, eye[k % 3].tolist(), eye[k % 3].tolist()) for k in range(3)]
    df = spark.createDataFrame(rows, "year int, mem int, a array<double>, b array<double>").coalesce(1)
    for m in frames.cube(df, ["year", "mem"], {"all": 3}, 10)[1][1, "all"]:
        assert np.trace(m) == 0 and m.sum() == 3


def test_empty_cube(panel):
    assert frames.cube(panel[0].where("false"), ["year"]) == ({}, {})


def test_displacement_under_the_true_rotation(panel):
    df, rows, held = panel
    got = frames.displaced(df, {"true": {(y,): r for y, r in held.items()}, "one": {(2001,): np.eye(D)}}, ["year"]).collect()
    by = {(r.year, r.investor_id): r for r in got}
    for year, i, _, _, a, b in rows:
        assert by[year, i].disp_true == pytest.approx(1 - np.array(a) @ held[year] @ np.array(b))
        assert (by[year, i].disp_one is None) == (year == 2002)


def test_leaving_one_group_out_equals_separate_fits(panel):
    df, rows, _ = panel
    got = {(r.year, r.label): r for r in frames.without_each(df, "year", "label", at=0.5).collect()}
    assert len(got) == 6
    for (year, label), r in got.items():
        s, comp, a, b, ids = out_of(rows, year)
        rest = comp != label
        fits = {"thr": rest & (s >= 0.5), "all": rest, "strat": rest & chosen("stable_strat", s, comp, np.ones(len(s), bool), ids, 0, 0)}
        own = {"st": (comp == label) & (s >= 0.5), "mv": (comp == label) & (s < 0.5)}
        assert (r.n_stable, r.n_movers) == (own["st"].sum(), own["mv"].sum())
        want = {}
        for name, anchor in fits.items():
            d = 1 - ((a @ align.procrustes(a[anchor].T @ b[anchor])) * b).sum(axis=1)
            for part, rows_ in own.items():
                want[part, name] = float(np.median(d[rows_])) if rows_.sum() >= 5 else None
                assert r[f"{part}_{name}"] == (None if want[part, name] is None else pytest.approx(want[part, name]))
        if r.n_stable >= 5:
            assert r.best_on_stable == min(("thr", "strat", "all"), key=lambda n: want["st", n])


def test_labels_in_a_common_space(spark, panel):
    df, rows, held = panel
    rng = np.random.default_rng(1)
    m = sphere.Mixture(unit(rng.normal(size=(3, D))), np.full(3, 0.6), np.full(3, 1 / 3))
    got = frames.labelled_in(df.select("investor_id", "year", F.col("a").alias("embedding")), "year", ["investor_id", "year"], {"x": held, "y": {2001: np.eye(D)}}, m).collect()
    for r in got:
        _, _, a, _, ids = out_of(rows, r.year)
        v = a[ids.index(r.investor_id)][None]
        post, like = sphere.posterior(v @ held[r.year], m.mu, m.rho, m.pi)
        assert (r.label_x, r.max_post, r.loglik) == (post.argmax(), pytest.approx(post.max()), pytest.approx(like[0]))
        assert r.label_y == (sphere.posterior(v, m.mu, m.rho, m.pi)[0].argmax() if r.year == 2001 else None)
    table = {r.year: r for r in frames.agreement(spark.createDataFrame(got), "year", ["x", "y"]).collect()}
    assert table[2001].agree_y == pytest.approx(np.mean([r.label_x == r.label_y for r in got if r.year == 2001])) and table[2002].agree_y is None


def test_kmeans_of_groups_equals_each_by_itself(spark):
    rng, rows = np.random.default_rng(3), []
    for g in (1, 2):
        means = unit(rng.normal(size=(3, D)))
        rows += [(g, f"{g}/{k}", unit(means[k % 3][None] + rng.normal(size=(1, D)) * 0.15)[0].tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "g int, id string, embedding array<double>").repartition(5)
    centres = sphere.kmeans_by(df, "g", "id", 3)
    for g in (1, 2):
        x = np.array([r[2] for r in rows if r[0] == g])
        again, labels, _ = sphere.local_kmeans(x, centres[g])
        assert np.allclose(again, centres[g], atol=1e-9)  # a fixed point
        found = {r.id: r.c for r in sphere.nearest_centre(df, "g", centres, ["id"], "c").collect()}
        assert [found[r[1]] for r in rows if r[0] == g] == labels.tolist()


def test_kmeans_fills_a_cluster_that_empties(spark, monkeypatch):
    """Two starts are one point, so that the second of them gets no row: a drawn row takes its place."""
    eye = np.eye(D)
    rows = [(1, k, eye[0 if k < 40 else 1 + k % 3].tolist()) for k in range(43)]
    df = spark.createDataFrame(rows, "g int, id int, embedding array<double>")
    for seed in range(6):
        centres = sphere.kmeans_by(df, "g", "id", 3, seed=seed, spare=14)[1]
        p = np.array([r[2] for r in rows]) @ centres.T
        assert set(p.argmax(axis=1)) == {0, 1, 2}
    assert sphere.kmeans_by(df.where("false"), "g", "id", 3) == {}
    assert len(sphere.kmeans_by(df.where("id < 2"), "g", "id", 3)[1]) == 2


def mixture_rows(spark, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for g in (1, 2):
        means = unit(rng.normal(size=(3, D)))
        rows += [(g, k + 1000 * g, unit(means[k % 3][None] + rng.normal(size=(1, D)) * 0.2)[0].tolist()) for k in range(240)]
    return rows, spark.createDataFrame(rows, "g int, id int, embedding array<double>").repartition(4)


def test_stacked_fits_equal_single_ones(spark):
    rows, df = mixture_rows(spark)
    rng = np.random.default_rng(1)
    starts = {(g, k, s): sphere.Mixture(unit(rng.normal(size=(k, D))), np.full(k, 0.4), np.full(k, 1 / k)) for g in (1, 2) for k in (2, 3) for s in range(3)}
    fits = sphere.stacked_em(df, starts, "g", rounds=6, tol=0, floor=0.05)
    for (g, k, s), m in fits.items():
        x, own = np.array([r[2] for r in rows if r[0] == g]), starts[g, k, s]
        one = sphere.Mixture(own.mu, own.rho, own.pi)
        for _ in range(6):
            sums, w, ll = sphere.em_sums(x, one.mu, one.rho, one.pi)
            one = sphere.Mixture(*sphere.em_step(one.mu, one.rho, sums, w, len(x), 0.05), ll, len(x))
        assert (m.k, m.n) == (one.k, 240) and m.loglik == pytest.approx(one.loglik)
        assert np.allclose(m.mu, one.mu) and np.allclose(m.rho, one.rho) and np.allclose(m.pi, one.pi)


def test_jobs_do_not_grow_with_starts(spark):
    _, df = mixture_rows(spark)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for restarts in (1, 6):
        group = f"fits-{restarts}"
        spark.sparkContext.setJobGroup(group, group)
        sphere.fit_many(df, "id", [2, 3], restarts, by="g", rounds=4)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 1


def test_free_refits_find_the_groups(spark):
    rows, df = mixture_rows(spark)
    best = sphere.best_of(sphere.fit_many(df, "id", [3], 4, by="g", rounds=40))
    for g in (1, 2):
        m, counts = best[g, 3]
        assert counts["n_ok"] + counts["n_collapse"] == 4 and m.k == 3
        x = np.array([r[2] for r in rows if r[0] == g])
        label = sphere.posterior(x, m.mu, m.rho, m.pi)[0].argmax(axis=1)
        table = np.zeros((3, 3))
        np.add.at(table, (label, np.arange(240) % 3), 1)
        assert stats.rand_index(table) > 0.8
    assert sphere.fit_many(df.where("false"), "id", [3], by="g") == {}
    m, counts = sphere.fit_mixture(df.where("id < 1002"), "id", 3)
    assert m is None and counts["n_fail"] == 4


def test_composed_and_direct_matching_can_differ():
    eye = np.eye(3)
    made = lambda mu: sphere.Mixture(mu, np.full(3, 0.5), np.full(3, 1 / 3))
    reference = made(eye)
    refits = {2001: made(eye), 2002: made(eye), 2003: made(eye[[1, 0, 2]])}
    same, swapped = {(k, k): 10 for k in range(3)}, {(0, 1): 10, (1, 0): 10, (2, 2): 10}
    rows = dynamics.chain_check(refits, reference, {(2001, 2002): swapped, (2002, 2003): swapped})
    # members say that 0 and 1 changed places in the first step, which the centres deny; in the second both agree
    assert rows == [(2001, 2002, 30, 1.0, pytest.approx(1 / 3), pytest.approx(1 / 3)), (2002, 2003, 30, 1.0, 1.0, pytest.approx(1 / 3))]
    assert dynamics.chain_check(refits, reference, {(2001, 2002): same})[0][4:] == (1.0, 1.0)
    more = {2001: sphere.Mixture(eye[:2], np.full(2, 0.5), np.full(2, 0.5)), 2002: made(eye)}
    assert dynamics.chain_check(more, reference, {(2001, 2002): {(0, 0): 3, (1, 1): 3, (1, 2): 1}})[0][4:] == (None, None)


def test_k_diagnostics(spark):
    rows, df = mixture_rows(spark)
    scan = sphere.scan_k(df.where("g = 1"), "id", ks=(3, 4, 5, 6), restarts=2, fits=4, rounds=20).cache()
    by = {(r.method, r.k): r for r in scan.collect()}
    assert by["mixture", 3].cross_ari == by["kmeans", 3].cross_ari > 0.7
    assert by["mixture", 3].rho_median > 0 and by["kmeans", 3].rho_median is None
    told = {r.method: r for r in sphere.k_summary(scan, 240, D).collect()}
    for method in ("mixture", "kmeans"):
        some = {k: by[method, k] for k in (4, 5, 6) if by[method, k].ari_mean is not None}
        if some:
            assert told[method].chosen_k == max(some, key=lambda k: some[k].ari_mean)
            means = [r.ari_mean for r in some.values()]
            assert told[method].flat == (max(means) - min(means) < np.median([r.ari_sd for r in some.values()]))
    assert told["mixture"].bic_penalty == pytest.approx((D + 1) * np.log(240)) and told["kmeans"].bic_penalty is None


def brute_nearest(rows, queries, k):
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for i, v in queries:
        cos = np.round(x @ np.array(v), 12)
        out[i] = [(int(j), float(c)) for c, j in sorted(((-c, j) for c, j in zip(cos, ids, strict=True) if j != i))[:k]]
    return {i: [(j, -c) for j, c in v] for i, v in out.items()}


@pytest.mark.parametrize(("groups", "block"), [(40, 32_768), (40, 50), (1, 70)])
def test_pivots_and_tiles_find_the_exact_neighbours(spark, monkeypatch, groups, block):
    """Tight groups, in which most tiles are skipped, and one broad one with repeated vectors, whose ties fall to the smaller id."""
    monkeypatch.setattr(pooling, "TILE", 64)
    monkeypatch.setattr(pooling, "BOUNDING", 200)
    rng = np.random.default_rng(groups)
    means = unit(rng.normal(size=(groups, 8)))
    x = unit(means[np.arange(3000) % groups] + rng.normal(size=(3000, 8)) * (0.02 if groups > 1 else 2))
    x[2500:2600] = x[:100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5)
    pairs = spark.sparkContext.accumulator(0)
    got: dict = {}
    for r in pooling.nearest(df.where("vec_id % 20 = 0"), df, 7, block_rows=block, pairs=pairs).orderBy("query", "nth").collect():
        got.setdefault(r.query, []).append((r.neighbour, r.cos))
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 7)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(c == pytest.approx(d, abs=1e-11) for q in want for (_, c), (_, d) in zip(got[q], want[q], strict=True))
    assert 0 < pairs.value <= (0.5 if groups > 1 else 1) * 150 * 3000


def test_nearest_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert [(r.query, r.neighbour, r.cos) for r in pooling.nearest(df, df, 5).orderBy("query").collect()] == [(1, 2, 0.0), (2, 1, 0.0)]
    assert pooling.nearest(df.where("false"), df, 5).count() == pooling.nearest(df, df.where("false"), 5).count() == 0


@pytest.mark.parametrize(("t", "df"), [(0.0, 3), (1.0, 1), (2.0, 10), (-3.5, 30), (0.7, 598), (6.0, 4)])
def test_t_tails_equal_the_integral(t, df):
    """Simpson's rule over the density, and closed forms for few degrees of freedom."""
    x = np.linspace(0, abs(t), 200_001)
    y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    h = x[1] - x[0]
    inside = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    assert stats.t_two_sided(t, df) == pytest.approx(1 - 2 * inside, abs=1e-10)
    if df == 1:
        assert stats.t_two_sided(t, df) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)


def test_p_of_correlations(spark):
    df = spark.createDataFrame([("a", 100, 0.3), ("b", 50, -1.0), ("c", 5, None)], "g string, n long, rho double")
    got = {r.g: (r.t, r.p) for r in stats.with_p(df).collect()}
    t = 0.3 * math.sqrt(98 / (1 - 0.09))
    assert got == {"a": (pytest.approx(t), pytest.approx(stats.t_two_sided(t, 98))), "b": (-math.inf, 0.0), "c": (None, None)}


def test_price_window_reaches_the_scan(spark, tmp_path):
    days = ["2020-01-01", "2020-02-10", "2020-03-01", "2020-03-01", "2020-03-02", "2020-02-20"]
    rows = [("x", datetime.datetime.fromisoformat(d), float(k), 2.0) for k, d in enumerate(days)] + [("y", datetime.datetime(2020, 2, 15), None, 1.0), ("y", datetime.datetime(2020, 1, 30), 5.0, 1.0), ("z", datetime.datetime(2020, 3, 1, 23, 59), 1.0, 1.0)]
    path = str(tmp_path / "prices")
    spark.createDataFrame(rows, "id string, day timestamp, price double, shares double").write.parquet(path)
    got = holdings.latest_in_window(spark.read.parquet(path), "id", "day", "2020-03-01", 20, ["price", "shares"])
    assert {(r.id, str(r.day)[:10], r.price) for r in got.collect()} == {("x", "2020-03-01", 3.0), ("z", "2020-03-01", 1.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2020-02-10" in plan and "LessThan(day,2020-03-02" in plan


def test_database_scan_is_pushed_down_and_partitioned(spark):
    """A table in the embedded database that comes with Spark: filters and columns reach it, a partition for each predicate."""
    url, props = "jdbc:derby:memory:foliolens;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(k, f"i{k % 7}", float(k)) for k in range(100)], "ID int, INVESTOR string, MV double")  # upper case, as the database folds names
    rows.coalesce(1).write.jdbc(url, "holdings", mode="overwrite", properties=props)
    predicates = panel_files.id_predicates("id", list(range(50)), 20, "mv >= 5")
    got = panel_files.read_tables(spark, url, "holdings", predicates, props)
    assert got.rdd.getNumPartitions() == len(predicates) == 3
    some = got.where("mv < 30").select("id")
    assert sorted(r[0] for r in some.collect()) == list(range(5, 30))
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "JDBCRelation" in line)
    assert "LessThan(" in scan and "30.0" in scan and "ReadSchema: struct<id:int>" in scan.replace("ID", "id")
    whole = panel_files.read_tables(spark, url, "holdings", properties=props)
    assert whole.count() == 100 and whole.rdd.getNumPartitions() == 1
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in rows.collect()}


def test_contrastive_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    e, w = rng.normal(size=(30, D)), rng.random(30) + 0.1
    book, half = np.arange(30) % 5, (np.arange(30) // 5) % 2
    _, g = contrastive.loss_and_gradient(e, w, book, half, 5)
    for i, j in [(0, 0), (7, 2), (13, 3), (29, 1)]:
        values = []
        for step in (1e-6, -1e-6):
            x = e.copy()
            x[i, j] += step
            values.append(contrastive.loss_and_gradient(x, w, book, half, 5)[0])
        assert g[i, j] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-5, abs=1e-9)


def test_rates_rise_and_fall():
    rates = [contrastive.rate_at(k, 100, 1.0, 10) for k in range(100)]
    assert rates[0] == 0.1 and rates[9] == 1.0 == max(rates) and rates[10:] == sorted(rates[10:], reverse=True) and rates[-1] < 0.01


def test_training_brings_halves_together(spark):
    """Books of one of four topics, tokens with random vectors: the loss falls, on books held out too, and sums over batches are exact."""
    rng, rows = np.random.default_rng(5), []
    for b in range(200):
        topic = b % 20
        for k, t in enumerate(rng.choice(12, 8, replace=False)):
            rows.append((f"b{b}", k % 2, f"t{topic}/{t}", float(rng.random() + 0.5)))
    books = pooling.hash_split(spark.createDataFrame(rows, "book string, half int, token string, w double"), "book")
    train, held = (contrastive.in_batches(books.where(p).drop("is_train"), 32).cache() for p in ("is_train", "NOT is_train"))
    vectors = {t: rng.normal(size=8) for t in sorted({r[2] for r in rows})}
    tokens = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()], "token string, vec array<double>")
    before = contrastive.mean_loss(held, tokens)
    steps = list(contrastive.trained(train, tokens, 6, rate=0.1, held=held))
    assert steps[-1][1] < steps[0][1] and steps[-1][2] < 0.9 * before
    assert steps[-1][0].count() == len(vectors) and len(steps[-1][0].first().vec) == 8
    want: dict = {}
    for r in train.collect():
        want.setdefault(r.batch, []).append(r)
    total, n = 0.0, 0
    for part in want.values():
        names = sorted({r.book for r in part})
        loss, _ = contrastive.loss_and_gradient(np.array([vectors[r.token] for r in part]), np.array([r.w for r in part]), np.array([names.index(r.book) for r in part]), np.array([r.half for r in part]), len(names))
        total, n = total + loss * len(names), n + len(names)
    assert steps[0][1] == pytest.approx(total / n)
    alone = spark.createDataFrame([(0, "b", 0, "t0/1", 1.0)], "batch long, book string, half int, token string, w double")
    assert contrastive.mean_loss(alone, tokens) is None and list(contrastive.trained(alone, tokens, 2)) == []
