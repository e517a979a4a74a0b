"""The training-data operators against brute force, exact round trips and hard inputs."""

import base64
import bz2
import gzip
import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliolens.llm import bpe, chat, common, graph, lattice, neardup, packing, quality, secrets, sharding, simhash, syncmers, token_files, unigram
from foliolens.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

HARD = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "one"), (5, "a b"), (5, "a b"), (5, "c d"), (None, "no id at all here"), (None, None), (6, "x" * 40_000), (7, "wörd été ﬁ 漢字仮名 " * 30),
    (8, "tab\tand\x1codd\xa0white　space  double . , á, \x00 end "), (9, "<|endoftext|> a<|startoftext|>b"), (10, "▁ piece ▁▁mark"), (11, "The cat sat on the mat. " * 300), (12, "a b"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in HARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


def clashing(df):
    """df with more columns, named like those that operators add."""
    names = ["fp", "shard", "slot", "row_number", "size", "length", "key", "class", "component_id", "block", "ids", "spans", "rank", "salt", "n", "start"]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])


def next_texts(rows):
    return [t for _, t in rows[1:] + rows[:1]]


# Sharding


@given(st.integers(1, 5000), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_feistel_is_a_permutation(n, seed):
    f = sharding.Feistel(n, seed)
    p = f.place(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and (f.row(p) == np.arange(n)).all()


def check_shards(rows, n):
    rows = [r.asDict() for r in rows]
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1


def test_op1(spark, texts):
    rows = QUERIES["op1_feistel_sharding"](spark, SF).collect()
    check_shards(rows, len(texts))
    want = {(d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    again = {(r.doc_id, r.shard, r.slot) for r in QUERIES["op1_feistel_sharding"](spark, SF).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_sharding_hard_inputs(spark, monkeypatch, hard, empty, tmp_path):
    check_shards(sharding.assign_shards(sharding.digests(clashing(hard))).collect(), len(HARD))
    assert sharding.assign_shards(sharding.digests(empty)).count() == 0
    named = spark.createDataFrame([(1, 2, "x", 3, 4)], "row_number int, shard int, bucket string, count int, digest int")
    assert sharding.assign_shards(named).first().asDict() == {"row_number_": 1, "shard_": 2, "bucket": "x", "count": 3, "digest": 4, "row_number": 0, "shard": 0, "slot": 0}
    same = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    monkeypatch.setattr(common, "BLOCK", 7)
    monkeypatch.setattr(sharding, "BLOCK", 7)
    check_shards(sharding.assign_shards(same).collect(), 500)
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(same, path, 4, rows_per_file=50)
    assert {(r.shard, r["count"]) for r in spark.read.parquet(path).groupBy("shard").count().collect()} == {(k, 125) for k in range(4)}


# Syncmers


def test_anchors_are_closed_syncmers(spark):
    words = "it was the best of times it was the worst of times it was the age of wisdom".split()
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    got = [a.pos for a in df.select(syncmers.anchors(F.col("text")).alias("a")).first().a]
    h = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(F.xxhash64("w")).collect()]
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(h, h[1:], strict=False))], "k int, a long, b long")
    m = [r[0] for r in pairs.orderBy("k").select(F.xxhash64("a", "b")).collect()]
    w = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(words) - syncmers.K + 1) if min(m[i : i + w]) in (m[i], m[i + w - 1])]
    assert got == want and got


def check_op2(rows, texts):
    by = {r.doc_id: r for r in rows}
    assert len(by) == len(texts) == len(rows)
    for (d, t), n in zip(texts, next_texts(texts), strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert by[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[d].n_chars == len(t)
        assert 0 <= by[d].near_edited <= 1 and 0 <= by[d].near_next <= 1


def brute_anchors(text):
    """(position, hash) of the anchors of a text, window by window."""

    def chain(values, digest=42):
        for v in values:
            digest = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), digest)
        return digest

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    alone = "[\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f]"
    words = [w for run in re.findall(r"[^\x20\x09-\x0D]+", text) for w in re.findall(f"{alone}|(?:(?!{alone}).)+", run, re.DOTALL)]
    h, out = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words], []
    for i in range(len(h) - syncmers.K + 1):
        window = h[i : i + syncmers.K]
        inner = [signed(chain(window[j : j + syncmers.S])) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(window) & 0xFFFFFFFF))
    return out or ([(0, xxhash.xxh64_intdigest(" ".join(words).encode(), 42) & 0xFFFFFFFF)] if words else [])


def brute_likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def check_prints(rows, texts):
    """Whole fingerprints and likenesses against brute force; texts by doc_id."""
    by = {r.doc_id: r for r in rows}
    for (d, t), n in zip(texts, next_texts(texts), strict=True):
        half, r = len(t) // 2, by[d]
        a, e, x = brute_anchors(t), brute_anchors(t[: len(t) - half] + n[:half]), brute_anchors(n)
        assert r.fingerprint == "".join(f"{h:08x}" for _, h in a) and r.edited_fingerprint == "".join(f"{h:08x}" for _, h in e)
        assert abs(r.near_edited - brute_likeness(a, e)) < 1e-12 and abs(r.near_next - brute_likeness(a, x)) < 1e-12
        assert r.in_place_edited == len(set(a) & set(e))


def test_op2(spark, texts):
    rows = QUERIES["op2_closed_syncmers"](spark, SF).collect()
    check_op2(rows, texts)
    check_prints(rows, texts)


def test_syncmers_of_long_and_unspaced_texts(spark):
    rng = np.random.default_rng(3)
    texts = [(1, "".join(chr(0x0E01 + k) for k in rng.integers(0, 40, 300))), (2, "漢字" * 50 + "かな交じり文" * 9), (3, "x" * 2_000_000), (4, "word " * 400_000), (5, ""), (6, "a b c d")]
    texts.append((7, texts[0][1][:100] + "ก" + texts[0][1][100:]))
    rows = syncmers.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_prints(rows, texts)
    by = {r.doc_id: {r.fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)} for r in rows}
    assert len(by[1] & by[7]) >= 0.9 * len(by[1])  # an inserted character changes the anchors around it only


def test_syncmers_hard_inputs(spark, monkeypatch, hard, empty):
    rows = syncmers.fingerprint_documents(clashing(hard)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in HARD)
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 12) and r.n_chars == 3}) == 2
    assert syncmers.fingerprint_documents(empty).count() == 0
    monkeypatch.setattr(syncmers, "BLOCK", 2)
    monkeypatch.setattr(common, "BLOCK", 2)
    same = spark.createDataFrame([(7, "abcd efgh")] * 5, "doc_id long, text string")
    assert syncmers.fingerprint_documents(same).count() == 5
    one = syncmers.fingerprint_documents(spark.createDataFrame([(7, "abcd efgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and one.near_next == 1.0


# Token files and byte-pair encoding


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_stretches_encode_like_whole_texts(path, texts):
    e, tok = bpe.StretchEncoder(path, memo=2000), Tokenizer.from_file(path)
    all_texts = [t for _, t in texts] + [t or "" for _, t in HARD]
    for _ in range(2):
        for t, got in zip(all_texts, e.encode_all(all_texts), strict=True):
            assert got == array("I", tok.encode(t, add_special_tokens=False).ids).tobytes(), t[:80]


@given(st.text(alphabet="aBİ\u0958 é.,!?'\n\t 　\x1ć漢1<|>", max_size=40))
@settings(max_examples=300, deadline=None)
def test_stretches_encode_any_text(t):
    for path in (WORD, BYTE):
        e = bpe.encoder(path)
        assert e.encode_all([t])[0] == array("I", e.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()


def check_token_rows(rows, texts):
    tok, start, want = Tokenizer.from_file(WORD), 0, []
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_op3(spark, texts):
    check_token_rows(QUERIES["op3_token_files"](spark, SF).collect(), texts)


def test_token_files_hard_inputs(spark, hard, empty, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(clashing(hard), path, WORD, 2)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in HARD), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert {r.doc_id for r in token_files.read_documents(spark, path, 3, 5).collect()} == {3, 4, 5}
    token_files.write_token_files(empty, path + "0", WORD, 2)
    assert token_files.read_token_files(spark, path + "0").count() == 0


def test_token_files_layout(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_token_files(docs, f"file://{tmp_path}/t", WORD, 2)
    file = next(p for p in sorted((tmp_path / "t").glob("part-*")) if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    kinds = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings
    assert kinds["doc_id"].has_column_index and kinds["doc_id"].has_offset_index


# Secrets


def brute_spans(text):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_op4(spark, texts):
    by = dict(texts)
    for r in QUERIES["op4_recursive_secret_scan"](spark, SF).collect():
        base = brute_spans(by[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(secrets.written(base).encode()).hexdigest()
        assert set(secrets.written(base).split(",")) <= set(r.spans.split(",")) or not base


@given(st.text(alphabet="tokenpassecrApiKeyAKIA09af=:_\"' .", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_spans_of_any_text(t):
    assert secrets.scan(t) == brute_spans(t)


def b64(data):
    return base64.b64encode(data).decode()


SECRET = "password=hunter2hunter2"


@pytest.mark.parametrize(
    ("wrapped", "name"),
    [
        (b64(SECRET.encode()), "base64"),
        (b64(b64(SECRET.encode()).encode()), "twice"),
        (b64(gzip.compress(SECRET.encode() * 3)), "gzip"),
        (b64(zlib.compress(b64(SECRET.encode()).encode())), "base64 in zlib in base64"),
        ("".join(f"%{b:02x}" for b in SECRET.encode()), "percent"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode"),
        ("".join(f"&#{ord(c)};" for c in SECRET), "references"),
        ("".join(f"%{b:02X}" for b in "".join(f"\\u{ord(c):04x}" for c in SECRET).encode()), "unicode in percent"),
    ],
)
def test_secrets_are_found_in_layers(wrapped, name):
    text = f"é before {wrapped} after"
    base, spans, layers, cut = secrets.find(text)
    inner = [(s, e) for s, k, e in spans if k == 0]
    assert not [b for b in base if b[1] == 0] and layers and not cut and inner, name
    assert all(9 <= s < e <= 9 + len(wrapped) for s, e in inner)
    assert "hunter2" not in secrets.redacted(text) and secrets.redacted(text).startswith("é before ") and secrets.redacted(text).endswith(" after")


@pytest.mark.parametrize(
    "wrapped",
    [
        b64(f"set {SECRET} now".encode("utf-16-le")),
        b64(f"set {SECRET} now".encode("utf-16-be")),
        b64(b"name\0\0\0 \x1b[31m" + SECRET.encode()),
        b64(f"café {SECRET} ".encode("latin-1")),
        b64(gzip.compress(b"dir/\0\0\0ustar\xff " + SECRET.encode())),
        "".join(f"%{b:02x}" for b in b"\xe9 " + SECRET.encode()),
        "".join(f"\\u{ord(c):04x}" for c in f"\ud800 {SECRET}"),
    ],
)
def test_secrets_among_bytes_that_are_no_text(wrapped):
    assert "assign" in secrets.written(secrets.find(f"before {wrapped} after")[1])


def noise(n):
    return np.random.default_rng(11).bytes(n)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress])
def test_compressed_layers_are_read_to_their_end(monkeypatch, pack):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 12)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 6)

    def found(data):
        return "assign" in secrets.written(secrets.find(f"before {b64(data)} after")[1])

    secret = f" {SECRET} ".encode()
    assert found(pack(b"one ") + pack(b"two ") + pack(secret))  # members
    assert found(pack(b"one ") + secret)  # bytes after the last
    nested = b64(secret + noise(9000) + secret.replace(b"2", b"3")).encode()
    assert found(pack(b"word " * 1000 + nested + b" word" * 3000))  # an inner run over many windows
    spoiled = bytearray(pack(secret + noise(1 << 20)))
    spoiled[-20_000] ^= 255
    assert found(bytes(spoiled)) and found(pack(secret + noise(1 << 20))[:-20_000])


@pytest.mark.parametrize("filler", [b"a", b"0123456789", b"some words and others, "])
def test_a_long_layer_is_read_in_bounded_memory(filler):
    """A layer of 256 MB, most of it one run or spaced words, in a process of its own."""
    code = f"""
import base64, resource, sys, time, zlib
from foliolens.llm import secrets
c = zlib.compressobj(1, zlib.DEFLATED, 31)
block = ({filler!r} * (1 << 20))[: 1 << 20]
parts = [c.compress(b"token=abcdef123456 ")] + [c.compress(block) for _ in range(256)] + [c.compress(b" password: zyxwvu987654"), c.flush()]
text = "x " + base64.b64encode(b"".join(parts)).decode() + " y"
start, held = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
base, spans, layers, cut = secrets.find(text)
print(len(spans), cut, round(time.process_time() - start, 1), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    spans, cut, seconds, mb = map(float, done.stdout.split())
    assert spans >= 1 and cut == 0
    assert seconds < 40 and mb < 300  # 20 s on a quiet machine


def test_a_run_longer_than_a_window_is_decoded_as_a_stream(monkeypatch):
    """Secrets, nested runs and compressed data inside of runs that fill several windows, at every alignment and near the cuts."""
    monkeypatch.setattr(secrets, "WINDOW", 1 << 12)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 8)

    def found(data):
        spans = secrets.find(f"before {b64(gzip.compress(data))} after")[1]
        return "assign" in secrets.written(spans)

    secret = f" {SECRET} ".encode()
    rng = np.random.default_rng(3)
    filler = lambda n: bytes(rng.integers(0, 256, n, dtype=np.uint8))
    for shift in range(4):
        for place in (0, 3000, 9001, 20_000, 29_990):
            body = filler(place) + secret + filler(30_000 - place)
            assert found(b"word " * 10 + b"A" * shift + base64.b64encode(body) + b" word" * 900), (shift, place)
    for size in (100, 20_000):
        packed = gzip.compress(filler(size) + secret + filler(20_000))  # the inner stream ends far behind the window it begins in
        assert found(b"x " + base64.b64encode(packed) + b" y")
    wrapped = base64.encodebytes(gzip.compress(filler(20_000) + secret))
    assert found(b"x\n" + wrapped + b"\ny")


MIME = base64.encodebytes(b"f" * 50 + f" {SECRET} ".encode()).decode()


@pytest.mark.parametrize(
    "wrapped",
    [
        MIME,
        MIME.replace("\n", "\r\n"),
        base64.encodebytes(gzip.compress(noise(300) + SECRET.encode())).decode(),
        base64.encodebytes(zlib.compress(noise(300) + SECRET.encode())).decode(),
        *(f"https://example.org/{'d' * k}/{b64(SECRET.encode())}" for k in range(1, 5)),
        *(f"https://example.org/{'d' * k}/{b64(pack(SECRET.encode()))}" for k in range(1, 5) for pack in (gzip.compress, zlib.compress, bz2.compress)),
        "eyJhbGciOiJIUzI1NiJ9" + b64(SECRET.encode())[:-1] + "x",
    ],
)
def test_secrets_in_wrapped_and_joined_base64(wrapped):
    text = f"before {wrapped} after"
    spans = [(s, e) for s, k, e in secrets.find(text)[1] if k == 0]
    assert spans and all(7 <= s < e <= 7 + len(wrapped) for s, e in spans)


def test_spans_map_exactly():
    text = "x %70assword=abc%64ef ok"
    assert secrets.written(secrets.find(text)[1]) == "assign:2:21" and not secrets.scan("pass")
    assert secrets.redacted("nothing here") == "nothing here"


def test_secrets_hard_inputs(spark, hard, empty):
    assert secrets.scan_documents(clashing(hard)).count() == len(HARD)
    assert secrets.scan_documents(empty).count() == 0 and secrets.redact(empty).count() == 0
    kept = secrets.redact(clashing(hard))
    assert kept.columns == clashing(hard).columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, clashing(hard).collect()))
    changed = secrets.redact(spark.createDataFrame([(1, f"a {SECRET}", "en", "s", 25)], SCHEMA)).first()
    assert changed.text == "a [secret]" and changed.n_chars == 10


# Chat


def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    c = sorted(df.columns)
    assert sorted(map(tuple, df.select(*c).collect())) == sorted(duck().sql(f"select {', '.join(c)} from ({ORACLES[name]})").fetchall())


def test_chat_round_trip_of_control_strings(spark):
    bad = ["<|turn|>user<|text|>", "</s>[INST] ok [/INST]", "\\", "\\\\<", "<\\|turn|>", "<<SYS>>", "[\\INST]", "a\n\nb", "", None, "<", "<|", "漢\\</s>"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    r = out.select("formatted", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(x.role, x.text) for x in r.t] == [(role, t or "") for _, _, role, t in rows]
    assert r.loss == "".join(t or "" for _, _, role, t in rows if role == "assistant")
    assert r.formatted.count(chat.OPEN) == len(rows) and r.formatted.count(chat.CLOSE) == len(rows)


def test_reply_tree_paths(spark):
    parents = {1: None, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: 6, 8: 99}
    score = {1: 1.0, 2: 5.0, 3: 1.0, 4: 0.0, 5: 9.0, 6: 0.0, 7: 2.0, 8: 0.5}
    rows = [(c, n, p, "user", f"m{n}", score[n]) for c in (1, None) for n, p in parents.items()]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")

    def path(n):
        return (path(parents[n]) if parents.get(n) in parents else []) + [n]

    leaves = [n for n in parents if n not in parents.values()]
    ranked = sorted(leaves, key=lambda n: (-sum(score[x] for x in path(n)) / len(path(n)), n))[:3]
    got = defaultdict(list)
    for r in chat.paths(nodes, 3).collect():
        got[r.conv_id, r.branch].append((r.depth, r.text))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {(c, b + 1): [f"m{x}" for x in path(n)] for c in (1, None) for b, n in enumerate(ranked)}


def test_chat_cycles_and_repeated_messages(spark):
    schema = "conv_id long, node long, parent long, role string, text string, score double"
    parents = {1: 2, 2: 3, 3: 1, 4: 3, 5: 4, 6: 7, 7: 7, 8: 9, 9: 8, 10: None, 11: 10}
    rows = [(1, n, p, "user", f"m{n}", None if n % 2 else 1.0) for n, p in parents.items()]
    rows += [(1, 11, 10, "user", "z", 5.0), (1, 5, 4, "user", "m5", None), (2, 1, 1, "user", "m1", 0.0)]
    got = defaultdict(list)
    for r in chat.paths(spark.createDataFrame(rows, schema), 100).collect():
        got[r.conv_id, r.branch].append((r.depth, int(r.text[1:])))
    # the smallest message of each cycle is its root: 1 of 1-2-3, 7 of itself, 8 of 8-9
    assert sorted([t for _, t in sorted(v)] for (c, _), v in got.items() if c == 1) == [[1, 3, 2], [1, 3, 4, 5], [7, 6], [8, 9], [10, 11]]
    assert got[2, 1] == [(1, 1)]


def test_chat_deep_and_empty(spark):
    deep = spark.createDataFrame([(1, k, "user", str(k)) for k in range(150)] + [(2, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digest(chat.format_conversations(deep)).collect()}
    assert got == {1: 150, 2: 2}
    assert chat.digest(chat.format_conversations(deep.limit(0))).count() == 0


# Near-duplicates


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, near):
    parent = {k: k for k in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    items = list(fps.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if near(x, y) and (r := find(a)) != (s := find(b)):
                parent[max(r, s)] = min(r, s)
    return {k: find(k) for k in fps}


def test_op6(spark, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts}
    roots = brute_components(fps, lambda x, y: (x ^ y).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_pigeonring"](spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", roots[d]) for d in fps}


@pytest.mark.parametrize("small", [0, 3, 1000])
def test_links_lose_nothing(spark, small):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for k in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(k)
            fps.add(x)
    signed = {k: x - (1 << 64) if x >> 63 else x for k, x in enumerate(sorted(fps))}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(df, 2, small=small).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in edges)
    want = brute_components(signed, lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 2)
    got = brute_components(signed, lambda x, y, e=set(edges): (x, y) in e or (y, x) in e)
    assert got == want


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100}


def test_simhash_hard_inputs(hard, empty):
    rows = simhash.simhash_groups(clashing(hard)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in HARD)
    zero = {r.component_id for r in rows if r.fp == 0}
    assert zero == {1}
    assert simhash.simhash_groups(empty).count() == 0


def similarity_groups(rows):
    sets = {d: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    return brute_components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))


@pytest.mark.parametrize("small", [2, 64])
def test_near_dedup(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for n in (30, 120, 700):
        words = [str(w) for w in rng.choice(vocabulary, n)]
        for _ in range(12):
            copy = list(words)
            for k in rng.integers(0, n, max(1, n // 150)):
                copy[k] = "edit"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(str(w) for w in rng.choice(vocabulary, 200))) for k in range(20)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    got = {r.doc_id for r in neardup.drop_near_duplicates(df).collect()}
    assert got == set(similarity_groups(rows).values())


def test_near_dedup_of_the_table(docs, texts):
    assert {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()} == set(similarity_groups(texts).values())


def test_near_dedup_hard_inputs(hard, empty):
    kept = neardup.drop_near_duplicates(clashing(hard))
    assert kept.columns == clashing(hard).columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert (None, None) in rows and (1, None) not in rows and rows.count((5, "a b")) == 1 and (5, "c d") in rows and (12, "a b") not in rows
    assert neardup.drop_near_duplicates(empty).count() == 0


def kept_of(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    return {r.doc_id for r in neardup.drop_near_duplicates(df).collect()}


def test_near_dedup_of_repeated_lines(spark):
    rng, rows = np.random.default_rng(9), []
    for k in range(40):
        words, line = ([f"w{w}" for w in rng.integers(0, 30_000, n)] for n in (104, 10))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + line * 8))]
    assert kept_of(spark, rows) == set(similarity_groups(rows).values()) == {2 * k for k in range(40)}


def edges_by(spark, texts, keys):
    """Near pairs of texts, numbered, if all of them have these stripe keys only."""
    marks = []
    for d, t in enumerate(texts):
        distinct = np.unique(simhash.shingle_hashes(t.encode(), 5))
        fp = np.array([simhash.majority(distinct)], dtype=np.uint64).view(np.int64)[0]
        marks.append((d, int(fp), len(distinct), keys, neardup.parity(distinct).tolist()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(marks, "class long, fp long, n long, keys array<long>, parity array<long>")
    classes = marks.join(df.select(F.col("doc_id").alias("class"), *neardup._keys()), "class")
    found, roots = neardup.linked(df, classes, 5, 0.8)
    links = {(min(r.u, r.v), max(r.u, r.v)) for r in found.collect()}
    assert {r["class"]: r.root for r in roots.collect()} == {r.node: r.root for r in graph.components(found).collect()}
    return links


def test_near_dedup_of_a_shared_passage_grows_linearly(spark, monkeypatch):
    """Otherwise different texts with one passage of 60 words: their stripes are hot, but few pairs are compared in the end."""
    rng, work, several = np.random.default_rng(4), [], neardup._several

    def recorded(rows):
        out = several(rows)
        if "times" not in rows.columns:
            work.append(out.agg(F.sum(F.when(F.col("root") != F.col("top"), F.col("size")))).first()[0] or 0)
        return out

    monkeypatch.setattr(neardup, "_several", recorded)
    passage = " ".join(f"p{k}" for k in range(60))
    last = []
    for many in (500, 2000):
        rows = [(k, " ".join(f"w{w}" for w in rng.integers(0, 40_000, 120)) + " " + passage) for k in range(many)]
        rows += [(many + k, f"{rows[k][1]} end") for k in range(20)]  # near copies
        work.clear()
        assert kept_of(spark, rows) == set(range(many))
        assert work[0] > 200 * many  # as stripes they would be quadratic
        last.append(work[-1])
    assert last[1] <= 4.5 * max(last[0], 500)


def test_near_dedup_of_texts_that_are_mostly_one_passage(spark, monkeypatch):
    """Texts around the similarity by a passage that all share, without hubs to help."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng, rows = np.random.default_rng(8), []
    passage = [f"p{k}" for k in range(90)]
    for k in range(120):
        own = [f"w{w}" for w in rng.integers(0, 40_000, int(rng.integers(2, 40)))]
        rows.append((k, " ".join(own + passage)))
    assert kept_of(spark, rows) == set(similarity_groups(rows).values())


def test_near_dedup_of_a_drifting_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "HUBS", 2)
    words, texts = [f"w{k}" for k in range(400)], []
    for k in range(60):  # each copy is near to the few before and after it only
        words[6 * k : 6 * k + 6] = [f"e{k}"] * 6
        texts.append(" ".join(words))
    links = edges_by(spark, texts, [7, 8])
    roots = brute_components({k: k for k in range(60)}, lambda a, b: (min(a, b), max(a, b)) in links)
    assert roots == dict.fromkeys(range(60), 0)


@pytest.mark.parametrize("small", [2, 64])
def test_near_dedup_by_one_key(spark, monkeypatch, small):
    """Near pairs whose only equal stripe is one that many classes have."""
    monkeypatch.setattr(neardup, "SMALL", small)
    rng, texts = np.random.default_rng(8), []
    for _ in range(6):
        words = [f"w{w}" for w in rng.integers(0, 3000, 120)]
        texts += [" ".join(words), " ".join([*words[:-1], "edit"])]
    assert edges_by(spark, texts, [7]) == {(2 * k, 2 * k + 1) for k in range(6)}


def test_parity_bounds_the_difference_of_sets():
    rng = np.random.default_rng(10)
    for n in (5, 80, 3000):
        a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2))
        b = np.concatenate([a[: n // 2], b[n // 2 :]])
        apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(neardup.parity(a).view(np.uint64), neardup.parity(b).view(np.uint64), strict=True))
        assert not (neardup.parity(a) != neardup.parity(a[::-1])).any() and 0 < apart <= len(np.setxor1d(a, b))


# Quality


def test_cascade_order_does_not_change_verdicts(texts):
    data = [t.encode() for _, t in texts]
    order = quality.cascade(data[:50])
    assert {r.name for r in order} == {r.name for r in quality.RULES}
    for d in data:
        assert quality.passes(quality.Text(d), order) == quality.passes(quality.Text(d), list(quality.RULES))
    assert quality.cascade([]) == list(quality.RULES)


def test_cascade_takes_conditional_rejections_per_cost():
    """A rule that rejects what others have rejected before comes last, however much it rejects alone."""

    def slow(t):
        return [t.get("n_words") for _ in range(20_000)] and t.get("n_words") < 60

    quality.MEASURES["slow"] = slow
    try:
        rules = (quality.Rule("same", lambda t: t.get("slow")), quality.Rule("few", lambda t: t.get("n_words") < 60), quality.Rule("marks", lambda t: t.get("n_symbols") > 0))
        sample = [b"a " * 10] * 20 + [b"b " * 100] * 20 + [b"# " * 100] * 5
        assert [r.name for r in quality.cascade(sample, rules)] in (["few", "marks", "same"], ["marks", "few", "same"])
    finally:
        del quality.MEASURES["slow"]


def test_quality_hard_inputs(hard, empty):
    rows = {(r.doc_id, r.n_words, r.kept) for r in quality.report(clashing(hard)).collect()}
    assert (1, 0, False) in rows and (6, 1, False) in rows
    assert quality.report(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert quality.keep_good(clashing(hard)).columns == clashing(hard).columns


def test_labelled_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    kept = quality.report(common.documents(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = kept.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.99 * good.count()


# Packing


def check_pieces(rows, texts, capacity=1024):
    tok, by = Tokenizer.from_file(BYTE), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by.pop(d), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (len(ids) > capacity or r.length == len(ids)) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = 0
        for o, n in sorted(b):
            assert o == ends
            ends += n
        assert ends <= capacity
    return len(bins), math.ceil(total / capacity)


def test_op8(spark, texts):
    used, least = check_pieces(QUERIES["op8_best_fit_packing"](spark, SF).collect(), texts)
    assert used <= 1.03 * least + 2


def bins_of(columns):
    return sum(k for _, k in columns)


@given(st.dictionaries(st.integers(1, 63), st.integers(0, 40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_layout_holds_the_demand(demand):
    columns, least = packing.layout(demand, 64)
    held = Counter()
    for column, count in columns:
        assert sum(n * k for n, k in column.items()) <= 64
        for n, k in column.items():
            held[n] += k * count
    assert held == Counter({n: k for n, k in demand.items() if k})
    assert math.ceil(sum(n * k for n, k in demand.items()) / 64) <= least <= bins_of(columns) <= bins_of(packing.best_fit({n: k for n, k in demand.items() if k}, 64))


def fewest_bins(pieces, capacity, rooms=()):
    """Every assignment of a few pieces, longest first."""
    if not pieces:
        return len(rooms)
    n, best = pieces[0], fewest_bins(pieces[1:], capacity, (*rooms, capacity - pieces[0]))
    for room in {r for r in rooms if r >= n}:
        k = rooms.index(room)
        best = min(best, fewest_bins(pieces[1:], capacity, (*rooms[:k], room - n, *rooms[k + 1 :])))
    return best


@given(st.lists(st.integers(1, 19), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_bound_and_layout_around_the_optimum(pieces):
    columns, least = packing.layout(dict(Counter(pieces)), 20)
    best = fewest_bins(sorted(pieces, reverse=True), 20)
    assert least <= best <= bins_of(columns) <= best + 1


@pytest.mark.parametrize(
    ("demand", "most", "bound"),
    [  # the optima of the first two can be worked out by hand
        ({513: 20_000, 300: 40_000, 211: 20_000}, 26_667, 26_660),
        ({518: 6000, 271: 6000, 263: 6000, 239: 12_000}, 9010, 8990),
        ({130: 3000, 250: 3000, 333: 4000, 512: 2000, 611: 2500}, 5050, 4980),
        ({n: 500 + 97 * n % 2000 for n in range(203, 500, 10)}, 0, 0),
    ],
)
def test_program_beats_best_fit(demand, most, bound):
    columns, least = packing.layout(demand, 1024)
    assert bound <= least <= bins_of(columns) <= (most or bins_of(packing.best_fit(demand, 1024)))
    if not most:
        assert bins_of(columns) <= 1.02 * least


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_layout_of_a_tables_histogram_is_the_programs(table, histogram):
    """Plain best fit is the yardstick only: the program needs no more, and its columns are what comes out."""
    demand = histogram(table)
    columns, least = packing.layout(demand, 1024)
    plain = packing.best_fit(demand, 1024)
    assert least <= bins_of(columns) <= bins_of(plain)
    assert sorted(columns, key=str) != sorted(plain, key=str)
    tries = [packing.rounded(demand, 1024, *way) for way in packing.TRIES]
    used = [program for found, program, _ in tries if sorted(found, key=str) == sorted(columns, key=str)]
    assert used and max(used) >= 0.7 * bins_of(columns)
    if table == "sf0.1":
        assert bins_of(columns) <= 1.001 * least
        many = {n: 1000 * k + n % 7 for n, k in demand.items()}
        columns, least = packing.layout(many, 1024)
        assert bins_of(columns) <= 1.0005 * least and bins_of(columns) < bins_of(packing.best_fit(many, 1024))


@pytest.fixture(scope="module")
def histogram():
    """Lengths of the pieces of a table, full ones apart, by the library alone."""
    tokenizer = Tokenizer.from_file(BYTE)

    def of(table):
        rows = duckdb.sql(f"SELECT coalesce(text, '') FROM '/root/testdata/{table}/documents.parquet'").fetchall()
        sizes = [len(e.ids) + 1 for e in tokenizer.encode_batch([r[0] for r in rows], add_special_tokens=False)]
        found = Counter(n for size in sizes for _, n in packing.cut(size, 1024))
        return {n: k for n, k in found.items() if n < 1024}

    return of


def test_pricing_finds_the_best_column():
    rng = np.random.default_rng(7)
    lengths = np.array([3, 7, 8, 11, 19])
    w = rng.random(5)
    order = np.argsort(-lengths)
    values, last = packing.price(lengths[order], w[order], 30)
    places = packing.chosen(lengths[order], last, 30)
    column, value = np.bincount(order[places], minlength=5), values[30]
    best = {0: 0.0}
    for c in range(1, 31):
        best[c] = max([best[c - 1], *(best[c - n] + x for n, x in zip(lengths.tolist(), w.tolist(), strict=True) if n <= c)])
    assert abs(column @ w - best[30]) < 1e-9 and abs(value - best[30]) < 1e-9 and column @ lengths <= 30


def test_packing_hard_inputs(hard, empty):
    rows = packing.pack(clashing(hard), BYTE).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d for d, _ in HARD)
    unique = [(d, t) for d, t in HARD if d is not None and d != 5]
    ids = {d for d, _ in unique}
    assert {r.doc_id for r in rows} == ids | {5, None}
    assert packing.pack(empty, BYTE).count() == 0


# Pieces


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(PIECES)


def viterbi(pieces, text):
    """Pieces of the best segmentation of a whole text, without pre-tokens."""
    if not text:
        return 0
    t = " " + text
    best, count = [0.0], [0]
    for e in range(1, len(t) + 1):
        options = [(best[s] + pieces.table[t[s:e]][1], count[s] + 1) for s in range(max(0, e - pieces.longest), e) if t[s:e] in pieces.table]
        if t[e - 1] not in pieces.table:
            n = len(t[e - 1].encode())
            options.append((best[e - 1] + lattice.BYTE * n, count[e - 1] + n))
        s, c = max(options, key=lambda x: x[0])
        best.append(s)
        count.append(c)
    return count[-1]


def test_op9(spark, pieces, texts):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op9_trie_token_counts"](spark, SF).collect()}
    short = [(d, t) for d, t in texts if len(t) < 4000]
    assert len(got) == len(texts) and {d: got[d] for d, _ in short} == {d: viterbi(pieces, t) for d, t in short}


def test_parts_and_long_pretokens_change_nothing(monkeypatch, pieces, texts):
    some = [t for _, t in texts][:40]
    want = [viterbi(pieces, t) for t in some if len(t) < 3000]
    keys = unigram.row_keys(list(range(len(some))), 3)
    whole = unigram.encode_texts(pieces, some, keys)
    one = [unigram.encode_texts(pieces, [t], keys[k : k + 1])[0] for k, t in enumerate(some)]

    def counted():
        rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(some))), "text": some})
        return [n for t, n in zip(some, unigram._count(rows, PIECES).column("n_tokens").to_pylist(), strict=True) if len(t) < 3000]

    assert counted() == want and all(a.tolist() == b.tolist() for a, b in zip(whole, one, strict=True))
    for long, together in ((4096, 100), (4, 1_000_000), (4, 100), (0, 1000)):
        monkeypatch.setattr(unigram, "LONG", long)
        monkeypatch.setattr(unigram, "TOGETHER", together)
        assert counted() == want
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, unigram.encode_texts(pieces, some, keys), strict=True))


def test_trie_shares_prefixes(pieces):
    units = sorted({u for w in ("then", "there", "the", "other", "漢字", "漢", "x", "é") for u in (w, " " + w)})
    for ways in (False, True):
        trie = lattice.Trie(pieces, units, ways)
        assert len(trie) == 1 + len({u[:k] for u in units for k in range(1, len(u) + 1)})
    assert lattice.Trie(pieces, units, False).count[trie.end].tolist() == [lattice.long_count(pieces, u) for u in units]
    assert len(lattice.Trie(pieces, [], True)) == 1


def test_long_pretokens_stay_out_of_the_trie(pieces):
    text = "no" * 300_000 + " and " + "xyz漢" * 100_000
    ids = unigram.encode_texts(pieces, [text], unigram.row_keys([5], 3))[0]
    assert unigram.decode(pieces, ids.tolist()) == text
    _, trie, long, _ = unigram._numbered([lattice.units(text)], pieces, False)
    assert len(trie) < 100 and len(long) == 2 and unigram._counts(pieces, [lattice.units(text)])[0] > 100_000


def test_op10(spark, texts):
    rows = QUERIES["op10_sampled_pieces"](spark, SF).collect()
    by = dict(texts)
    assert len(rows) == len(texts) and all(r.lossless and r.decoded_crc32 == zlib.crc32(by[r.doc_id].encode()) for r in rows)


@given(st.text(max_size=40), st.integers(0, 2**60))
@settings(max_examples=200, deadline=None)
def test_sampling_is_lossless_and_reproducible(t, row):
    p = unigram._pieces(PIECES)
    keys = unigram.row_keys([row], 1)
    a, b = (unigram.encode_texts(p, [t], keys)[0].tolist() for _ in range(2))
    assert a == b and unigram.decode(p, a) == t


def test_samples_follow_the_model(pieces):
    """Each segmentation of a word is drawn as often as its score says."""
    unit, ways = " then", {}

    def walk(s, ids, score):
        if s == len(unit):
            ways[tuple(ids)] = score
        for e in range(s + 1, len(unit) + 1):
            if unit[s:e] in pieces.table:
                k, p = pieces.table[unit[s:e]]
                walk(e, [*ids, k], score + p)

    walk(0, [], 0.0)
    whole = sum(map(math.exp, ways.values()))
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in unigram.encode_texts(pieces, ["then"] * n, unigram.row_keys(list(range(n)), 9)))
    for ids, score in ways.items():
        p = math.exp(score) / whole
        assert abs(got[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_pieces_hard_inputs(hard, empty):
    assert unigram.count_tokens(clashing(hard), PIECES).count() == len(HARD) and unigram.count_tokens(empty, PIECES).count() == 0
    assert unigram.round_trip(clashing(hard), PIECES).where("lossless").count() == len(HARD)
    back = unigram.decode_documents(unigram.sample_encode(hard, PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in HARD)
    assert unigram.round_trip(empty, PIECES).count() == 0


# Very long texts


@pytest.fixture(scope="module")
def long_texts():
    words = " ".join(f"word{k % 9973}" for k in range(500_000))
    return [(1, words), (2, words + " " + SECRET), (3, "ab" * 400_000), (4, "line one\n" * 200_000), (5, "漢字" * 200_000), (6, "short"), (7, None)]


@pytest.fixture(scope="module")
def long(spark, long_texts):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in long_texts], SCHEMA)


def test_very_long_texts(spark, long, long_texts, tmp_path):
    by = {d: t or "" for d, t in long_texts}
    check_shards(sharding.assign_shards(sharding.digests(long)).collect(), len(by))
    path = f"file://{tmp_path}/long"
    token_files.write_token_files(long, path, WORD, 2)
    check_token_rows(token_files.read_token_files(spark, path).collect(), sorted(by.items()))
    spans = {r.doc_id: r.spans for r in secrets.scan_documents(long).collect()}
    assert spans[2].startswith(f"assign:{len(by[2]) - len(SECRET)}:") and spans[1] == ""
    prints = {r.doc_id: r.fp for r in simhash.simhash_groups(long).collect()}
    assert len(prints) == len(by) and (prints[1] ^ prints[2]).bit_count() <= 2
    report = {r.doc_id: r for r in quality.report(long).collect()}
    assert report[1].n_words == 500_000 and report[4].n_dup_lines == 199_999 and report[5].word_chars == 400_000
    check_pieces(packing.pack(long, BYTE).collect(), sorted(by.items()))
    kept = {r.doc_id for r in neardup.drop_near_duplicates(long).collect()}
    assert kept == {1, 3, 4, 5, 6, 7}
    assert unigram.count_tokens(long, PIECES).where("n_tokens > 0").count() == 6
    assert unigram.round_trip(long, PIECES).where("lossless").count() == len(by)


def test_batches_are_bounded_by_bytes(spark):
    """Rows of a few MB come in small batches, whatever their number."""
    df = spark.range(0, 20, 1, 1).select(F.repeat(F.lit("x"), 3_000_000).alias("text"))
    common.small_batches(spark)
    rows = df.mapInArrow(common.per_batch(lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows]})), "n long").collect()
    assert sum(r.n for r in rows) == 20 and max(r.n for r in rows) <= 3


def test_an_unset_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d=None: d)}), Context

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.checkpoint_dir(Session)
