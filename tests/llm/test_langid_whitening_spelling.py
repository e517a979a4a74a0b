"""Language identification, whitening and spelling variants against brute force, finite differences and hard inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens.llm import langid, spelling, whitening
from foliolens.llm.registry import QUERIES
from tests.llm.test_llm import SF, clashing, docs, empty, hard, texts  # noqa: F401  fixtures


# --- op11 -----------------------------------------------------------------------------------------------------------


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(3)
    net = langid.begun(["a", "b", "c"], hidden=4, dtype=np.float64)
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    x[5:, 2] = langid.PAD
    _, grads = langid.loss_and_gradients(net.params, x, y)
    for name, g in grads.items():
        cells = [(int(x[0, 0]), j) for j in range(2)] if name[0] == "W" else [tuple(rng.integers(0, n) for n in g.shape) for _ in range(3)]
        for cell in cells:
            held, values = net.params[name][cell], []
            for e in (1e-6, -1e-6):
                net.params[name][cell] = held + e
                values.append(langid.loss_and_gradients(net.params, x, y)[0])
            net.params[name][cell] = held
            assert g[cell] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-5, abs=1e-9), name


def slow_probabilities(net, data):
    """One text, byte by byte, a window at a time."""
    p = {k: v.astype(float) for k, v in net.params.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    total, letters = np.zeros(len(net.languages)), 0
    for a in range(0, len(data), langid.OWN):
        window = [data[i] if 0 <= i < len(data) else langid.PAD for i in range(a - langid.CONTEXT, a + langid.OWN + langid.CONTEXT)]
        out = np.zeros((len(window), len(net.languages)))
        for way, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            h = np.zeros(langid.HIDDEN)
            for t in order:
                b = window[t]
                z, r = (sig(p[f"W{g}{way}"][b] + h @ p[f"U{g}{way}"]) for g in "zr")
                n = np.tanh(p[f"Wn{way}"][b] + r * (h @ p[f"Un{way}"]))
                h = n + z * (h - n)
                out[t] += h @ p[f"V{way}"]
        out += p["c"]
        for t in range(langid.CONTEXT, langid.CONTEXT + langid.OWN):
            if window[t] != langid.PAD and (window[t] >= 128 or chr(window[t]).isalpha()):
                e = np.exp(out[t] - out[t].max())
                total += e / e.sum()
                letters += 1
    return total / max(letters, 1), letters


def test_side_by_side_equals_byte_by_byte():
    net = langid.begun(["x", "y", "z"], seed=5)
    data = ["", "a", "12 34", "é" * 200 + "abc", "The cat, the dog 7 " * 40, "x" * langid.OWN, "y" * (langid.OWN + 1)]
    prob, letters = langid.probabilities(net, [t.encode() for t in data])
    for t, p, n in zip(data, prob, letters, strict=True):
        want, count = slow_probabilities(net, t.encode())
        assert n == count
        assert np.allclose(p, want, atol=1e-4)
    labels = langid.label_positions(net, data[4])
    assert len(labels) == len(data[4].encode()) and set(labels.tolist()) <= {0, 1, 2}


def test_op11(spark, docs):  # noqa: F811
    rows = QUERIES["op11_recurrent_langid"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op11_learns_nothing_from_held_out_rows(spark, docs):  # noqa: F811
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    x, y, languages = langid.labelled_stretches(other)
    again = langid.labelled_stretches(docs)
    assert "zz" not in languages and (x == again[0]).all() and (y == again[1]).all()
    assert len(langid.labelled_stretches(docs, sample=10)[0]) <= 10 * langid.STRETCHES


def test_op11_hard(spark, hard, empty):  # noqa: F811
    net = langid.begun(["de", "en"])
    rows = langid.predict(clashing(hard), net).collect()
    assert len(rows) == hard.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3)} == {"und"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert langid.predict(empty, net).count() == 0
    assert langid.labelled_stretches(empty)[2] == []
    alone = langid.predict(hard, langid.fit(hard.where("doc_id = 4"))).where("doc_id = 4").first()
    assert (alone.lang_pred, alone.score) == ("en", 1.0) or alone.held_out
    assert {r.lang_pred for r in langid.predict(hard, langid.fit(empty)).collect()} == {"und"}
    same = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("ein Text und noch einer").alias("text"), F.lit("de").alias("lang"))
    assert len(langid.labelled_stretches(same, sample=20)[0]) > 0


# --- op12 -----------------------------------------------------------------------------------------------------------


def whitened_by_numpy(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=float)) + 100000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(e), e / np.trace(v)


def against_numpy(rows, held):
    deviation, white, explained = whitened_by_numpy([v for _, v in held])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(held) * white.shape[1] == len(got)
    for c in range(white.shape[1]):
        mine = np.array([got[i, c + 1].whitened for i, _ in held])
        assert np.allclose(np.abs(mine), np.abs(white[:, c]), atol=1e-6)
        assert abs(mine @ white[:, c]) == pytest.approx(float(mine @ mine))  # one sign for all rows
    for k, (i, _) in enumerate(held):
        r = got[i, 1]
        assert (r.n, r.deviation) == (len(held), int(deviation[k]))
        assert r.explained == pytest.approx(explained[0])
        assert r.identity_error < 1e-6


def test_op12(spark):
    held = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    against_numpy(QUERIES["op12_tiled_whitening"](spark, SF).collect(), held)


@pytest.mark.parametrize("tile", [1, 3, 5, 64])
def test_op12_tiles(spark, tile):
    rng = np.random.default_rng(0)
    held = [(k, (rng.normal(size=5) * [1, 5, 2, 9, 3]).tolist()) for k in range(200)]
    against_numpy(whitening.whiten(spark.createDataFrame(held, "vec_id long, embedding array<double>").repartition(7), tile=tile).collect(), held)


def test_op12_hard(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.5, 2.5, 0.25]), (2, [1.5, 2.5, 0.25]), (None, [0.0, 1.0, -7.0]), (4, None), (5, [None, 1.0, 1.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 2.0]), (8, []), (9, [1.0]), (10, [0.25, -3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df.withColumns({"x": F.lit(1), "n": F.lit("n"), "block": F.lit(0), "tile": F.lit(0)})).collect()
    assert Counter(r.vec_id for r in got) == {1: 3, 2: 6, None: 3, 10: 3}
    assert all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(df.where("false")).count() == whitening.whiten(df.where("vec_id = 4")).count() == 0
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in one)
    flat = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert Counter((r.component, r.whitened is None) for r in whitening.whiten(flat).collect()) == {(1, False): 4, (2, True): 4}
    far = spark.createDataFrame([(k, [1e300 * (-1) ** k, float(k)]) for k in range(10)], "vec_id long, embedding array<double>")
    top = whitening.whiten(far).collect()
    assert len(top) == 20 and all(abs(r.whitened) < 10 for r in top if r.component == 1)


def test_op12_deviations_are_exact():
    x, s = np.array([[2**40, 3]]), [2**45, 7]
    assert whitening.deviations(whitening.differences(x, 10, s)) == [None]
    x = np.array([[2**28, 3], [5, 2**27]])
    assert whitening.deviations(whitening.differences(x, 9, [11, 13])) == [(9 * 2**28 - 11) ** 2 + (27 - 13) ** 2, (45 - 11) ** 2 + (9 * 2**27 - 13) ** 2]


# --- op13 -----------------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    total = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 2}


def groups_by_pairs(words):
    """All pairs of words of like length and letters, compared by string."""
    near_of = {w: [] for w in words}
    by_size = {}
    for w in sorted(words):
        by_size.setdefault(len(w), []).append((w, Counter(w)))
    for size, some in by_size.items():
        for other in (some, by_size.get(size + 1, [])):
            for a, ca in some:
                for b, cb in other:
                    if (size != len(b) or a < b) and sum((ca - cb).values()) <= 1 and near(a, b):
                        near_of[a].append(b)
                        near_of[b].append(a)
    form = {}
    for w, ns in near_of.items():
        best = min(ns, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near_of[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_op13(spark, texts):  # noqa: F811
    assert found(QUERIES["op13_spelling_variants"](spark, SF)) == groups_by_pairs(counted(texts))


def test_op13_dense_words(spark):
    """Few letters, runs of equal ones, long chains of forms."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = ["".join(rng.choice("aabé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
        rows.append((k, " ".join(words).upper() if k % 3 else ", ".join(words)))
    rows += [(1000 + k, " ".join(["wordlike"] * 200 + ["wordlika"] * 20 + ["wordlikab"] * 2)) for k in range(3)]
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(6)
    want = groups_by_pairs(counted(rows))
    assert any(r[1] and r[2] != r[1] for r in want)
    assert found(spelling.spelling_groups(df)) == want


def test_op13_many_parts_and_colliding_hashes(spark, texts, monkeypatch):  # noqa: F811
    want = groups_by_pairs(counted(texts))
    words = [w for w, *_ in want]
    keys, of, start, end = spelling.deletion_keys(words)
    left = [words[o] if a < 0 else words[o][:a] + words[o][a + 1 :] for o, a in zip(of, start, strict=True)]
    assert len(set(zip(keys.tolist(), left, strict=True))) == len(set(left)) == len(set(keys.tolist()))
    # all strings of one key: the comparison of strings alone must keep them apart
    n = np.array([r[3] for r in want])
    pairs = spelling.near_words(of, [words[o] for o in of], n[of], start, end).to_pydict()
    total = Counter()
    for i, k in zip(pairs["id"], pairs["near"], strict=True):
        total[words[i]] += k
    assert {w: k for w, k in total.items() if k} == {r[0]: r[4] for r in want if r[4]}
    monkeypatch.setattr(spelling, "PART", 64)
    assert found(spelling.spelling_groups(spark.createDataFrame(texts, "doc_id long, text string"))) == want


def test_op13_hard(spark, hard, empty):  # noqa: F811
    assert spelling.spelling_groups(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    long = "ab" * 30_000
    rows += [(20, "  "), (21, None), (22, f"{long} {long} {long}x x{long}x x{long}x {'z' * 50_000} {'z' * 50_000} {'z' * 50_001} {'z' * 50_001}"), (23, "Straße Straße straßen Ünïcode ünïcode Ünïcode ×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = counted(rows)
    got = {r.word: r for r in spelling.spelling_groups(clashing(df)).collect()}
    assert {w: r.n for w, r in got.items()} == want
    assert got["z" * 50_000].n_near == 1 and got["z" * 50_001].n_near == 1
    hot = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("repeated repeater Repeated").alias("text"))
    assert found(spelling.spelling_groups(hot)) == groups_by_pairs(counted([(7, "repeated repeater Repeated")] * 3000))
