"""Work that must not grow faster than the input."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliolens.operators import align, contrastive, encoder, frames, pooling
from foliolens.operators import holdings as H
from foliolens.plans import adapters, model_queries, registry  # noqa: F401  they fill the registry
from foliolens.sources import durable


def stage_sums(spark, run) -> dict[str, int]:
    """Records and bytes that the stages of run() shuffled and wrote."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def total() -> dict[str, int]:
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        found = [stages.apply(i) for i in range(stages.size())]
        return {"records": sum(x.shuffleWriteRecords() + x.outputRecords() for x in found), "bytes": sum(x.shuffleWriteBytes() + x.outputBytes() for x in found)}

    before = total()
    run()
    return {k: v - before[k] for k, v in total().items()}


def pruned(edges: set, least_issuers: int, least_investors: int) -> set:
    while True:
        n = len(edges)
        for end, least in ((0, least_issuers), (1, least_investors)):
            degree = {}
            for e in edges:
                degree[e[end], e[2]] = degree.get((e[end], e[2]), 0) + 1
            edges = {e for e in edges if degree[e[end], e[2]] >= least}
        if len(edges) == n:
            return edges


def test_rounds_of_the_core_do_not_shuffle_all_edges(spark):
    """A dense block that stays beside a chain that goes link by link, in some ten rounds."""
    edges = [(f"a{i}", f"s{j}", 2000) for i in range(60) for j in range(60)]
    edges += [(f"b{i}", f"t{j}", 2000) for i in range(20) for j in (i, i + 1)]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "investor_id string, issuer_id string, period int, mv double")
    got = []
    sums = stage_sums(spark, lambda: got.extend(H.core(df, min_issuers=2, min_investors=2).collect()))
    assert {(r.investor_id, r.issuer_id, r.period) for r in got} == pruned(set(edges), 2, 2) == set(edges[:3600])
    assert sums["records"] < 5 * len(edges)


def test_core_is_the_pruned_graph(spark):
    draw = random.Random(3)
    edges = {(f"a{draw.randrange(40)}", f"s{draw.randrange(30)}", 2000 + draw.randrange(3)) for _ in range(700)}
    rows = [(*e, 1.0) for e in edges] + [(None, "s1", 2000, 1.0), ("a1", None, 2000, 1.0), ("a1", "s1", None, 1.0)]
    df = spark.createDataFrame(rows, "investor_id string, issuer_id string, period int, mv double")
    for least in ((6, 7), (7, 8), (30, 30)):
        got = H.core(df, min_issuers=least[0], min_investors=least[1]).collect()
        assert len(got) == len({tuple(r) for r in got}) and {(r.investor_id, r.issuer_id, r.period) for r in got} == pruned(edges, *least)


def books(spark, n: int = 120, tokens: int = 40, d: int = 6):
    """Rows of books dealt into chunks and halves, some of unknown tokens and without positive weights, and token vectors."""
    draw = random.Random(5)
    rows = [(f"b{b}", b % 3, f"t{t}", k % 2, k // 4, draw.choice([None, -1.0, 0.0, 0.5, 2.0]) if b % 7 else 0.0, b % 20) for b in range(n) for k, t in enumerate(draw.sample(range(tokens + 3), 12))]
    df = spark.createDataFrame(rows, "book string, period int, token string, half int, chunk_id int, w double, batch long")
    return df, spark.createDataFrame([(f"t{t}", [draw.gauss(0, 1) for _ in range(d)]) for t in range(tokens)], "token string, vec array<float>")


def test_books_that_meet_their_tokens_in_packs_are_pooled_alike(spark):
    rows, tokens = books(spark)
    wide, keys = rows.join(tokens, "token"), ["book", "period"]

    def vectors(df):
        return {(r.book, r.period): pytest.approx(list(r.embedding)) for r in df.collect()}

    pooled = lambda **more: vectors(pooling.pooled_tokens(rows, tokens, keys, "token", **more))
    got = {k: list(v.expected) for k, v in pooled(weight="w").items()}
    assert len(got) == 120 and got == vectors(pooling.pooled(wide, keys, weight="w", d=6))
    assert {k: v.expected for k, v in pooled(weight="w", rows_at_once=5).items()} == vectors(pooling.pooled(wide, keys, weight="w", d=6))
    assert {k: v.expected for k, v in pooled().items()} == vectors(pooling.pooled(wide, keys, d=6))
    chunks = rows.withColumn("w", F.lit(1.5) + F.col("chunk_id"))
    got = vectors(pooling.pooled_tokens(chunks, tokens, keys, "token", weight="w", chunk="chunk_id"))
    assert {k: v.expected for k, v in got.items()} == vectors(pooling.all_chunks(chunks.join(tokens, "token"), keys, d=6))
    assert not pooling.pooled_tokens(rows.where("book = 'none'"), tokens, keys, "token").count() and not pooling.pooled_tokens(rows, tokens.limit(0), keys, "token").count()


def test_gradients_come_back_once_for_each_token_and_pack(spark):
    rows, tokens = books(spark)
    rows = rows.withColumn("w", F.lit(1.0))
    assert contrastive.gradients(rows, tokens).count() == 40  # of 20 batches, each with most tokens
    assert contrastive.gradients(rows, tokens, loss_only=True).count() == 1
    assert pooling.asked(pooling.packed(rows, ["batch"], 500), "token").count() <= 43 * 3


def test_word2vec_trains_in_several_tasks(spark):
    rows = spark.createDataFrame([([f"t{(i + k) % 30}" for k in range(6)],) for i in range(200)], "tokens array<string>")
    e = encoder.Word2VecEncoder(d=4, per_task=40)
    assert [e.tasks(n, 8) for n in (0, 39, 80, 200, 10_000)] == [1, 1, 2, 5, 8]
    got = e.vectors(rows).collect()
    assert len(got) == 30 and all(len(r.vec) == 4 and any(r.vec) for r in got)


def test_tokens_that_all_packs_hold_are_sent_without_being_asked_for(spark, monkeypatch):
    rows, tokens = books(spark, 400)  # 4,800 rows of 43 tokens, in 8 packs
    monkeypatch.setattr(pooling, "LEAST_PACK", 400)
    rows, tokens = durable.stored(rows, "rows"), durable.stored(tokens, "tokens")
    got = []
    sums = stage_sums(spark, lambda: got.extend(pooling.pooled_tokens(rows, tokens, ["book", "period"], "token", weight="w").collect()))
    want = {(r.book, r.period): list(r.embedding) for r in pooling.pooled(rows.join(tokens, "token"), ["book", "period"], weight="w", d=6).collect()}
    assert len(got) == len(want) == 400 and all(list(r.embedding) == pytest.approx(want[r.book, r.period]) for r in got)
    assert sums["records"] < 4800 + 8 * 43 + 100
    few = rows.where("book IN ('b1', 'b2')")  # more packs than books
    monkeypatch.setattr(pooling, "LEAST_PACK", 1)
    assert {(r.book, r.period) for r in pooling.pooled_tokens(few, tokens.limit(1), ["book", "period"], "token", weight="w").collect()} <= set(want)
    assert pooling.pooled_tokens(rows.where("book IN ('b1', 'b2', 'b3')"), tokens.limit(2), ["book", "period"], "token").count() <= 3


def test_a_stored_table_is_not_written_again(spark):
    df, path = spark.range(1000), "/root/testdata/sf0.001"
    sums = stage_sums(spark, lambda: durable.cached(spark, ("once", path), lambda: durable.stored(df, "own")))
    assert sums["records"] == 1000 and durable.cached(spark, ("once", path), lambda: df).count() == 1000


def test_weights_are_made_of_sums_of_the_book(spark):
    draw = random.Random(9)
    rows = [(f"a{i}", f"s{j}", 2000, draw.choice([1.5, draw.random(), 40 * draw.random()])) for i in range(200) for j in range(draw.randrange(1, 200))]
    df = spark.createDataFrame(rows, "investor_id string, issuer_id string, period int, mv double").repartition(4, "investor_id")
    keys, out = ["investor_id", "period"], {}
    plain = stage_sums(spark, lambda: out.update(plain=durable.stored(H.slice_weights(H.positions(df, keys), keys), "plain")))
    short = stage_sums(spark, lambda: out.update(short=durable.stored(H.totalled(df, keys), "short")))
    got, want = H.weighed(out["short"]), out["plain"]
    assert got.dtypes == want.dtypes
    for a, b in zip(*(d.orderBy("investor_id", "rank").collect() for d in (got, want)), strict=True):
        assert [pytest.approx(x) if isinstance(x, float) else x for x in a] == list(b)
    assert short["bytes"] < 0.8 * plain["bytes"]


def test_overlap_of_years_deals_the_holdings_once(spark):
    draw = random.Random(4)
    rows = [(f"a{i}", f"s{j}", y, draw.random()) for i in range(60) for y in draw.sample(range(2000, 2006), 4) for j in draw.sample(range(30), 12)] + [("a1", "s1", 2001, 0.5), ("a1", None, 2001, 0.5), ("a1", None, 2002, 0.5)]
    df = durable.stored(spark.createDataFrame(rows, "investor_id string, issuer_id string, year int, pw double"), "slices")
    a, b = df, df.withColumn("year", F.col("year") - 1)
    want = {(r.investor_id, r.year): pytest.approx(r.wt_overlap) for r in align.holdings_overlap(a, b, ["investor_id", "year"]).collect()}
    got = []
    sums = stage_sums(spark, lambda: got.extend(align.overlap_with_next(df, "investor_id", "issuer_id", "year", "pw").collect()))
    assert len(want) > 50 and {(r.investor_id, r.year): r.wt_overlap for r in got} == want
    assert sums["records"] <= len(rows)


def test_memberships_leave_vectors_where_they_are_and_tasks_of_the_cube_are_few(spark):
    draw = random.Random(6)
    rows = [(f"a{i}", 2000 + i % 3, f"g{i % 4}", draw.random(), [draw.gauss(0, 1) for _ in range(64)], [draw.gauss(0, 1) for _ in range(64)]) for i in range(600)]
    df = durable.stored(spark.createDataFrame(rows, "investor_id string, year int, g string, wt_overlap double, a array<double>, b array<double>").repartition(40), "pairs")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        sums = stage_sums(spark, lambda: frames.memberships(df, "year", "investor_id", "g", 20, 0.95).write.format("noop").mode("overwrite").save())
        assert sums["bytes"] < 600 * 128 * 8 / 2
        sums = stage_sums(spark, lambda: frames.by_rule(frames.memberships(df, "year", "investor_id", "g", 20, 0.95), "year", times=1))
        cores, cells = spark.sparkContext.defaultParallelism, 3 * (4 * 2 * 2 + 3)  # 40 files would send up to as many as there are rows
        assert sums["records"] <= 64 * cells * cores + 4 * 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_losses_of_halves_shuffle_no_vectors_of_books(spark):
    draw = random.Random(8)
    tokens = spark.createDataFrame([(f"t{t}", [draw.gauss(0, 1) for _ in range(64)]) for t in range(40)], "issuer_id string, vec array<float>")
    rows = [(f"b{b}", y, f"t{t}", k % 2, 0.1 + draw.random()) for b in range(300) for y in (2000, 2001) for k, t in enumerate(draw.sample(range(40), 8))]
    rows, tokens = durable.stored(spark.createDataFrame(rows, "investor_id string, period int, issuer_id string, half int, w double"), "rows"), durable.stored(tokens, "tokens")
    got = []
    sums = stage_sums(spark, lambda: got.extend(pooling.half_losses(rows, tokens, "period", "investor_id").collect()))
    assert sums["bytes"] < 600 * 64 * 8  # less than one vector for each book
    h = pooling.pooled(rows.join(tokens, "issuer_id"), ["investor_id", "period", "half"], weight="w")
    pairs = h.where("half = 1").withColumnRenamed("embedding", "a").join(h.where("half = 0").withColumnRenamed("embedding", "b"), ["investor_id", "period"]).select("investor_id", "period", "a", "b")
    each = pooling.info_nce(pooling.batched(pairs, "period", "investor_id").withColumn("batch", F.struct("period", "batch")), "batch", "investor_id", "a", "b")
    want = each.groupBy("batch.period").agg(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), F.sum("n")).collect()
    assert sorted(got) == [(p, pytest.approx(loss), n) for p, loss, n in sorted(want)] and [r.n for r in got] == [300, 300]
    assert not pooling.half_losses(rows, tokens.limit(0), "period", "investor_id").count() and not pooling.half_losses(rows.limit(0), tokens, "period", "investor_id").count()
    few = tokens.where("issuer_id IN ('t1', 't2', 't3')")
    assert 0 < pooling.known_books(rows, few.withColumnRenamed("issuer_id", "token"), ["investor_id", "period"]).count() == rows.join(few, "issuer_id").select("investor_id", "period").distinct().count() < 600


def test_the_loss_query_shuffles_no_vectors_of_books(spark):
    sf = "/root/testdata/sf0.01"
    positions = adapters.positions(spark, sf)
    rows, books = positions.where("rank <= 124 AND n_assets_full >= 2").count(), positions.select(*adapters.KEYS).distinct().count()
    tokens = adapters.token_vectors(spark, sf).count()
    sums = stage_sums(spark, lambda: registry.QUERIES["infonce_loss"](spark, sf).collect())
    assert sums["bytes"] < 40 * rows + 2 * 256 * tokens * pooling.packs_of(rows, pooling.PACK, 8) + 64 * books


def test_books_with_unknown_tokens_have_the_loss_of_the_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    os.unlink(tmp_path / "embeddings.parquet")
    drawn = "hash(vec_id) % 16 = 0"  # few books have known tokens in both halves, some in one
    con = duckdb.connect()
    con.sql(f"COPY (SELECT vec_id, CASE WHEN {drawn} THEN embedding END AS embedding, label FROM '{sf}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    for f in os.listdir(tmp_path):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}'")
    want = sorted(con.sql(f"SELECT period, loss, n FROM ({registry.ORACLES['infonce_loss']})").fetchall())
    got = registry.QUERIES["infonce_loss"](spark, str(tmp_path)).select("period", "loss", "n").collect()
    assert want and sorted(map(tuple, got)) == [(p, loss if loss is None else pytest.approx(loss, abs=2e-6), n) for p, loss, n in want]


def test_vectors_of_a_pack_are_not_copied():
    column = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))])
    assert pooling.matrix_of(column, 2).ctypes.data == column.chunk(0).flatten().buffers()[1].address
    assert pooling.matrix_of(pa.chunked_array([pa.array([[1.0, None], [3.0, 4.0]], pa.list_(pa.float32()))]), 2).tolist() == [[1, 0], [3, 4]]
    table = pa.table({"book": ["a", "a", "b", "c"], "token": ["s", "t", "t", "u"], "w": [1.0, 1.0, 2.0, 1.0]})
    for rows, books in ((table, ["a", "b"]), (table.slice(0, 3), ["a", "b"]), (table.slice(3), [])):  # with and without unknown tokens, nothing else
        first, x = pooling.unit_sums(rows, pa.table({"token": ["s", "t"], "vec": column}), ["book"], "token", "w")
        assert first.column("book").to_pylist() == books and x.tolist() == [pytest.approx([4 / 52**0.5, 6 / 52**0.5]), pytest.approx([0.6, 0.8])][: len(books)]


def test_packs_are_read_in_windows_of_whole_groups(spark):
    rows, tokens = books(spark, 400)  # 4,800 rows of 12 for each book
    rows = pooling.dealt(rows.select("book", "token"), ["book"], 3)
    vectors = tokens.select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("of"), "token", "vec")

    def run(table, vectors):
        return pa.table([pa.array([k], pa.int64()) for k in (table.num_rows, len(table.column("book").unique()), vectors.num_rows)], names=["rows", "books", "tokens"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = pooling.meeting(rows, vectors, 3, ["book"], run, "rows long, books long, tokens long", window=200).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.rows for r in got) == 4800 and sum(r.books for r in got) == 400 and {r.tokens for r in got} == {40}
    assert len(got) > 15 and max(r.rows for r in got) <= 200 + 100
    parts = [pa.record_batch({"g": [g] * 30}) for g in (None, 1, 1, 1, 2, 3, 3)][1:]
    assert [t.column("g").unique().to_pylist() for t in pooling.windows(iter(parts), "g", 50)] == [[1], [2], [3]]
    assert [t.num_rows for t in pooling.windows(iter(parts), "g", 50)] == [90, 30, 60] and not list(pooling.windows(iter([]), "g"))


def test_training_leaves_the_batches_where_they_are(spark):
    draw = random.Random(12)
    rows = [(f"b{b}", k % 2, f"t{t}", 0.1 + draw.random()) for b in range(600) for k, t in enumerate(draw.sample(range(43), 16))]  # t40 to t42 are unknown
    df = durable.stored(spark.createDataFrame(rows, "book string, half int, token string, w double"), "rows")
    train, held = (contrastive.in_batches(df.where(p)) for p in ("book NOT LIKE '%7'", "book LIKE '%7'"))
    vectors = {f"t{t}": [draw.gauss(0, 1) for _ in range(8)] if t else None for t in range(40)}  # t0 has no vector
    tokens = durable.stored(spark.createDataFrame(list(vectors.items()), "token string, vec array<float>"), "tokens")
    got = []
    sums = stage_sums(spark, lambda: got.extend(contrastive.trained(train, tokens, 4, held=held)))
    assert len(got) == 4 and sums["records"] < 2 * len(rows)
    assert got[-1][2] == pytest.approx(contrastive.mean_loss(held, got[-1][0]), rel=1e-6) and got[1][1] == pytest.approx(contrastive.mean_loss(train, got[0][0]), rel=1e-6)
    final = {r.token: r.vec for r in got[-1][0].collect()}
    assert final.keys() == vectors.keys() and final["t0"] is None and all(len(v) == 8 for t, v in final.items() if t != "t0")
    assert list(contrastive.trained(train, tokens.limit(0), 2)) == [] and contrastive.mean_loss(train.limit(0), tokens) is None


def test_losses_of_halves_are_the_same_by_windows(spark):
    rows, tokens = books(spark, 300)
    rows, tokens = rows.withColumnRenamed("token", "issuer_id"), tokens.withColumnRenamed("token", "issuer_id")
    want = {tuple(r)[0]: (pytest.approx(r.loss), r.n) for r in pooling.half_losses(rows, tokens, "period", "book", size=8).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = pooling.half_losses(rows, tokens, "period", "book", size=8, window=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) == 3 and {r.period: (r.loss, r.n) for r in got} == want
