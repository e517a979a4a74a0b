"""Token counts and sampled segmentations under a unigram piece model.

`count_tokens` gives the number of pieces of each text's best segmentation. The distinct pre-tokens of some texts go
into a trie, whose nodes hold the forward scores, each computed once for all pre-tokens that share the prefix; terminal
nodes hold the counts that documents then look up.

`sample_encode` draws a segmentation by forward filtering and backward sampling: the forward scores are those of
the trie, the draws depend on the seed, the row's doc_id and the place in the text alone, so a row is segmented
alike wherever and whenever it is read. `decode` gives the text back without loss.

Defined cases: a null text is an empty one without tokens; texts are read whole, blanks and line ends included;
a null doc_id draws like 0; rows of equal doc_id and text give equal rows; repeated rows stay; other columns are
ignored; an empty table gives no rows; of segmentations with equal scores the one with the longest last piece counts.
Texts are worked on together, TOGETHER characters at once, and very long ones in parts, at pre-tokens, so
that a trie holds no more than that. Pre-tokens over LONG characters, which share nothing, go without a trie, by the
same scores and draws.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliolens.llm.common import documents, id_text, per_batch, rows_to_batch, small_batches, texts_of
from foliolens.llm.lattice import UNIT, Pieces, Trie, long_count, long_sample, mixed, sample_paths, spread, units

#: Pre-tokens longer than this go without a trie.
LONG = 4096
#: Characters of texts that are worked on together.
TOGETHER = 2_000_000

_HELD: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    if path not in _HELD:
        _HELD[path] = Pieces(path)
    return _HELD[path]


def _unit_lists(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists of TOGETHER characters or so."""
    if len(text) <= TOGETHER:
        yield units(text)
        return
    some, chars = [], 0
    for m in UNIT.finditer(" " + text):
        some.append(m[0])
        chars += len(m[0])
        if chars >= TOGETHER:
            yield some
            some, chars = [], 0
    yield some


def _parts(texts: list[str]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """What is worked on together: a text's number, the place of the first of these pre-tokens in it, and the pre-tokens."""
    part, chars = [], 0
    for k, text in enumerate(texts):
        place = 0
        for some in _unit_lists(text):
            if part and chars + min(len(text), TOGETHER) > TOGETHER:
                yield part
                part, chars = [], 0
            part.append((k, place, some))
            chars += min(len(text), TOGETHER)
            place += len(some)
    if part:
        yield part


def _numbered(split: list[list[str]], pieces: Pieces, ways: bool) -> tuple[np.ndarray, Trie, dict[str, int], list[str]]:
    """The node of each pre-token, -1 for a long one; the trie; the long ones with their numbers, and all pre-tokens in order."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__  # numbers in order of first use
    all_units = [u for s in split for u in s]
    which = np.array([number[u] for u in all_units], dtype=np.int64)
    short = sorted(u for u in number if len(u) <= LONG)
    trie = Trie(pieces, short, ways)
    node = np.full(len(number), -1, dtype=np.int64)
    node[[number[u] for u in short]] = trie.end
    return node[which], trie, {u: k for u, k in number.items() if len(u) > LONG} if len(short) < len(number) else {}, all_units


def _counts(pieces: Pieces, split: list[list[str]]) -> list[int]:
    """Terminal counts summed for each list of pre-tokens."""
    node, trie, long, all_units = _numbered(split, pieces, False)
    each = np.where(node >= 0, trie.count[node], 0)
    if long:
        found = {u: long_count(pieces, u) for u in long}
        for k in np.flatnonzero(node < 0).tolist():
            each[k] = found[all_units[k]]
    ends = np.cumsum([len(s) for s in split])
    sums = np.concatenate([[0], np.cumsum(each)])
    return (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).tolist()


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def _count(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    pieces = _pieces(path)
    n_units, n_tokens = [0] * batch.num_rows, [0] * batch.num_rows
    for part in _parts(texts_of(batch.column("text"))):
        for (k, _, some), n in zip(part, _counts(pieces, [some for _, _, some in part]), strict=True):
            n_units[k] += len(some)
            n_tokens[k] += n
    return rows_to_batch(_COUNTS, [batch.column("doc_id"), n_units, n_tokens])


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each text's best segmentation."""
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(per_batch(_count, model_path), "doc_id long, n_pretokens long, n_tokens long")


def row_keys(doc_ids: list[int | None], seed: int) -> np.ndarray:
    ids = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _drawn(pieces: Pieces, split: list[list[str]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece codes of all pre-tokens in order, and their number for each."""
    node, trie, long, all_units = _numbered(split, pieces, True)
    if not long:
        return sample_paths(trie, node, keys)
    known = np.flatnonzero(node >= 0)
    parts = [(known, *sample_paths(trie, node[known], keys[known]))]
    for k in np.flatnonzero(node < 0):
        codes = long_sample(pieces, all_units[k], keys[k])
        parts.append((np.array([k]), codes, np.array([len(codes)])))
    n = np.zeros(len(node), dtype=np.int64)
    for which, _, m in parts:
        n[which] = m
    first = np.cumsum(n) - n
    codes = np.empty(int(n.sum()), dtype=np.int64)
    for which, c, m in parts:
        codes[spread(first[which], m)] = c
    return codes, n


def _part_ids(pieces: Pieces, part: list[tuple[int, int, list[str]]], keys: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each list of pre-tokens of a part; keys: of each text."""
    split = [some for _, _, some in part]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    place = np.concatenate([np.arange(at, at + len(s)) for _, at, s in part])
    with np.errstate(over="ignore"):
        unit_keys = mixed(np.repeat(keys[[k for k, _, _ in part]], sizes) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    codes, n = _drawn(pieces, split, unit_keys)
    owner = np.repeat(np.repeat(np.arange(len(part)), sizes), n)
    odd = np.flatnonzero(codes < 0)
    if len(odd):  # characters without a piece: their UTF-8 bytes
        spelled = {c: [pieces.byte_ids[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in set(codes[odd].tolist())}
        wide = np.ones(len(codes), dtype=np.int64)
        wide[odd] = [len(spelled[c]) for c in codes[odd].tolist()]
        at = (np.cumsum(wide) - wide)[odd]
        codes, owner = np.repeat(codes, wide), np.repeat(owner, wide)
        for p, c in zip(at.tolist(), codes[at].tolist(), strict=True):
            codes[p : p + len(spelled[c])] = spelled[c]
    return np.split(codes, np.cumsum(np.bincount(owner, minlength=len(part)))[:-1])


def encode_texts(pieces: Pieces, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for part in _parts(texts):
        for (k, _, _), ids in zip(part, _part_ids(pieces, part, keys), strict=True):
            found[k].append(ids.astype(np.int32))
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]


def decode(pieces: Pieces, ids) -> str:
    """The text of ids: pieces and bytes one after another, without the blank put before the text."""
    return pieces.bytes_of(ids)[1:].decode("utf-8", "surrogatepass")


def _sample_lists(batch: pa.RecordBatch, path: str, seed: int) -> Iterator[tuple[str, np.ndarray]]:
    texts = texts_of(batch.column("text"))
    return zip(texts, encode_texts(_pieces(path), texts, row_keys(batch.column("doc_id").to_pylist(), seed)), strict=True)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(batch: pa.RecordBatch, path: str, seed: int) -> pa.RecordBatch:
    return rows_to_batch(_IDS, [batch.column("doc_id"), [ids for _, ids in _sample_lists(batch, path, seed)]])


def sample_encode(docs: DataFrame, model_path: str, seed: int = 17) -> DataFrame:
    """doc_id and the ids of a sampled segmentation."""
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(per_batch(_encode, model_path, seed), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _pieces(model_path)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        return rows_to_batch(schema, [batch.column("doc_id"), [decode(pieces, ids) for ids in batch.column("ids").to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(per_batch(run), "doc_id long, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("lossless", pa.bool_())])


def _digest(batch: pa.RecordBatch, path: str, seed: int) -> pa.RecordBatch:
    pieces = _pieces(path)
    rows = []
    for text, ids in _sample_lists(batch, path, seed):
        back = decode(pieces, ids.tolist())
        rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text))
    return rows_to_batch(_DIGEST, [batch.column("doc_id"), *zip(*rows, strict=True)])


def round_trip(docs: DataFrame, model_path: str, seed: int = 17) -> DataFrame:
    """Per document: the sampled ids' number and checksum, the decoded text's checksum, and whether it is the text."""
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(per_batch(_digest, model_path, seed), "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
