"""Each stage of the corpus pipeline against a brute-force version of its own, over its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from foliolens.llm import common, secrets
from tests.llm.test_llm import HARD, SCHEMA, SECRET, SF, b64, brute_spans, check_pieces, clashing

WORDS = r"[^\x20\x09-\x0D]+"


def brute_good(text):
    """The quality rules, each by itself."""
    words, lines = re.findall(WORDS, text), [x for x in text.split("\n") if re.search(WORDS, x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    hit = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    symbols, chars = sum(c in "#*$%&|<>" for c in text), sum(map(len, words))
    repeated = len(lines) - len(set(lines))
    return len(words) >= 50 and 100 * len(hit) <= 50 * len(words) and 10 * symbols <= len(words) and 2 * len(words) <= chars <= 16 * len(words) and 100 * repeated <= 40 * len(lines)


def brute_shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(WORDS, low)
    return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else frozenset())


def brute_single(rows):
    """The smallest (doc_id, text) of each group, by comparing all pairs of shingle sets."""
    sets = [(d, t, brute_shingles(t or "")) for d, t in dict.fromkeys(rows)]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, _, a) in enumerate(sets):
        for j, (_, _, b) in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for k, (d, _, _) in enumerate(sets):
        g = find(k)
        best[g] = min(best.get(g, d), d, key=lambda x: (x is not None, x or 0))
    return Counter(best.values())


def check_stages(spark, docs, rows):
    """rows: (doc_id, text) of docs. Each stage's rows, all columns."""
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    good = common.stored(stages["quality_rules"](spark, docs, SF), "good")
    want = [(d, t) for d, t in rows if brute_good(t or "")]
    assert good.columns == columns and Counter((r.doc_id, r.text) for r in good.collect()) == Counter(want)

    single = common.stored(stages["simhash_near_dedup"](spark, good, SF), "single")
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert single.columns == columns and Counter(d for d, _ in kept) == brute_single(want) and set(kept) <= set(want)

    clean = common.stored(stages["secret_scans"](spark, single, SF), "clean")
    out = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and set(out) == {d for d, _ in kept}
    for d, t in kept:
        assert not brute_spans(out[d] or "") and (out[d] == t) == (not secrets.find(t or "")[1])
        if brute_spans(t or "") and secrets.find(t)[2] == 0:  # nothing encoded: base spans are all
            marked, at = "", 0
            for s, _, e in brute_spans(t):
                if e > at:
                    marked += (t[at:s] + "[secret]") if s >= at else ""
                    at = e
            assert out[d] == marked + t[at:]

    packed = stages["best_fit_packing"](spark, clean, SF).collect()
    if len(out) == clean.count():
        used, least = check_pieces(packed, sorted(out.items(), key=str))
        assert used <= 1.05 * least + 2
    return packed


def test_stages(spark):
    docs = common.documents(spark, SF)
    packed = check_stages(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert len(packed) == corpus_pipeline.run(spark, SF).count()


def test_stages_of_hard_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, clashing columns; and texts that pass the rules."""
    words = " ".join(f"word{k}" for k in range(90))
    good = [(20, words), (21, words), (21, words), (22, words + " more"), (23, words.upper()), (24, f"{words} {SECRET}"), (25, f"{words[::-1]} {b64(SECRET.encode())}"), (None, words[::-1]), (26, words[::-1])]
    rows = HARD + good + [(27, " ".join(f"w{k}" for k in range(60_000)))]
    df = clashing(spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA))
    check_stages(spark, df, rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, SF).count() == 0


def test_fingerprints_within_two_bits_are_candidates(spark):
    from foliolens.llm import neardup

    prints = {1: 0, 2: 1, 3: 3 << 40, 4: 0, 5: 0x0F0F0F0F0F0F0F0F, 6: (1 << 63) - 1, 7: -1}
    rows = [(c, fp, 100, [0] * neardup.STRIPES) for c, fp in prints.items()] + [(8, 1, 300, [0] * neardup.STRIPES)]
    classes = spark.createDataFrame(rows, "class long, fp long, n long, parity array<long>")
    pairs = {(r.u, r.v) for r in neardup._print_pairs(classes, 0.8).collect()}
    assert {(1, 2), (1, 3), (1, 4), (6, 7)} == pairs
