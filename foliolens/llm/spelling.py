"""Groups of spelling variants: words one edit apart, found by rolling hashes of their deletions.

Words are counted in each task and then added up. Two words differ by one replaced character if they are equal without the one at
the same place, and by one inserted or deleted character if one of them is equal to the other without a character. Polynomial
hashes of a word's prefix and of its suffix give the hash of the word without any one character, for all
characters of a block of words at once in numpy. Keys are dealt by their leading bits (a radix partition, whose number of parts
follows the number of keys) and sorted in each part; keys of several words are candidates, whose words are then
fetched, and whose strings without the character are compared, so that a collision of hashes links nothing.

Within a run of equal characters any deletion gives the same string, so a run is one key, with the places that it covers. Words
of one key differ by a replacement if their runs share a place, of which there is one at most. Each pair of near words is thus
found once, and a key's words are counted and ranked together without writing out pairs: a key has at most as many words as
there are places and letters.

A form has at least RATIO times the word's occurrences, so that chains of forms are short; roots are found by jumps of doubled reach.

Defined cases: a null text has no words; a row without doc_id counts as one whose id is written as nothing; words of any length
are read whole; repeated rows each count; ties between forms fall to the smaller word in code-point order; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import bytes_of, documents, id_text, small_batches, stored

#: Code points of a word, occurrences of a word, and times the occurrences of a word that its form has, at least.
LEAST, OFTEN, RATIO = 7, 2, 10
#: One run in so many loses a character.
ODDS = 31
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Distinct words, and their bytes, that a task counts before it hands them on; characters whose keys are made at once; keys of a part.
HELD, HELD_BYTES, BLOCK, PART = 400_000, 32 << 20, 1 << 20, 1 << 19
#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def variants(docs: DataFrame, least: int = LEAST, odds: int = ODDS) -> DataFrame:
    """word, n: words of at least `least` code points, after one run in `odds` has lost a character, and their occurrences."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        size = 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                base, own = zlib.crc32(b":" if doc is None else b"%d:" % doc), {}
                for w in runs.findall(text.translate(_LOWER).decode()):
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), base)
                    if h % odds == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                        if len(w) < least:
                            continue
                    if w in total:
                        total[w] += n
                    else:
                        total[w] = n
                        size += len(w)
                if len(total) >= HELD or size >= HELD_BYTES:
                    yield handed()
                    total, size = {}, 0
        yield handed()

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, number of the word, first and last place of the run of equal characters that loses one; -1 for the word itself.

    A key is the hash of the string that is left, and of its length: the prefix' hash plus the suffix' hash one place lower.
    """
    if not words:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    chars = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    size = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(chars)) - first[of]
    power = np.full(int(size.max()), _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    term = _mixed(chars.astype(np.uint64) + np.uint64(1)) * power[place]
    upto = np.cumsum(term)
    upto -= (upto[first] - term[first])[of]  # within the word, this character included
    whole = upto[first + size - 1]
    without = upto - term + (whole[of] - upto) * np.uint64(_BACK)
    starts = np.flatnonzero((place == 0) | np.concatenate([[True], chars[1:] != chars[:-1]]))
    ends = np.concatenate([starts[1:], [len(chars)]]) - 1
    none = np.full(len(words), -1)
    length = np.uint64(0xD1B54A32D192ED03)
    keys = np.concatenate([_mixed(whole + size.astype(np.uint64) * length), _mixed(without[starts] + (size[of[starts]] - 1).astype(np.uint64) * length)])
    return keys, np.concatenate([np.arange(len(words)), of[starts]]), np.concatenate([none, place[starts]]), np.concatenate([none, place[ends]])


def shared_places(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start to end) of groups that share a place: the number of each such run, and a number for the group and place it
    is in. A place is the start of some run of the group; two runs of a group share one at most."""
    width = int(end.max(initial=0)) + 2
    at = np.flatnonzero(start >= 0)
    places = np.unique(group[at] * width + start[at])
    low = np.searchsorted(places, group[at] * width + start[at])
    times = np.searchsorted(places, group[at] * width + end[at], side="right") - low
    row = np.repeat(at, times)
    place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    many = np.bincount(place, minlength=len(places))[place] > 1
    return row[many], place[many]


_RADIX = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
_FOUND = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def radix_parts(words: DataFrame, bits: int) -> DataFrame:
    """part, keys, ids, starts, ends: the deletion keys of blocks of words, dealt by their leading bits, as bytes of arrays."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, of, start, end = deletion_keys(held)
            part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
            order = np.argsort(part, kind="stable")
            columns = keys[order], np.array(ids, dtype=np.int64)[of[order]], start[order], end[order]
            found, at = np.unique(part[order], return_index=True)
            for k in range(0, len(found), 1000):
                cuts = [*at[k : k + 1001], *([len(keys)] if k + 1000 >= len(found) else [])]
                blobs = [[np.ascontiguousarray(c[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 1000]), *(pa.array(b, type=pa.binary()) for b in blobs)], schema=_RADIX)

        for batch in batches:
            for i, w in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                held.append(w)
                ids.append(i)
                size += len(w)
                if size >= BLOCK:
                    yield from dealt()
                    held, ids, size = [], [], 0
        if held:
            yield from dealt()

    return words.select("id", "word").mapInArrow(deal, "part long, keys binary, ids binary, starts binary, ends binary")


def candidates(parts: DataFrame) -> DataFrame:
    """key, id, first, last: the words whose keys, sorted in each part, meet others of a near word."""

    def meet(table: pa.Table) -> pa.Table:
        keys, ids, start, end = (np.concatenate([np.frombuffer(v.as_buffer(), dtype=t) for v in table.column(c)]) for c, t in (("keys", np.uint64), ("ids", np.int64), ("starts", np.int64), ("ends", np.int64)))
        order = np.argsort(keys, kind="stable")
        keys, ids, start, end = keys[order], ids[order], start[order], end[order]
        group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
        several = np.bincount(group)[group] > 1
        whole = np.zeros(group[-1] + 1, dtype=bool)
        whole[group[start < 0]] = True
        keep = several & whole[group]
        keep[shared_places(group, start, end)[0]] = True
        return pa.table([pa.array(keys[keep].view(np.int64)), pa.array(ids[keep]), pa.array(start[keep]), pa.array(end[keep])], schema=_FOUND)

    return parts.groupBy("part").applyInArrow(meet, "key long, id long, first long, last long")


_NEAR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(ids: np.ndarray, words: list[str], n: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """id, near, best_n, best: for each word and string that is left of it, its near words by that string and the most frequent
    of them. The strings themselves are compared."""
    strings: dict[str, int] = {}
    group = np.array([strings.setdefault(w if a < 0 else w[:a] + w[a + 1 :], len(strings)) for w, a in zip(words, start.tolist(), strict=True)], dtype=np.int64)
    rank_of = {w: k for k, w in enumerate(sorted(set(words)))}
    rank = np.array([rank_of[w] for w in words], dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    # Replacements: the words at one place are all near to one another; the first of them is the best of all but itself.
    row, place = shared_places(group, start, end)
    order = np.lexsort((rank[row], -n[row], place))
    row, place = row[order], place[order]
    if len(row):
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.diff(np.concatenate([head, [len(row)]]))
        of = np.repeat(np.arange(len(head)), size)
        best = np.where(np.arange(len(row)) == head[of], row[np.repeat(head + 1, size)], row[head[of]])
        out.append((row, size[of] - 1, best))

    # Insertions: the word that is the string itself, and those that are it with one more character.
    own = np.full(len(strings), -1)
    own[group[start < 0]] = np.flatnonzero(start < 0)
    row = np.flatnonzero((start >= 0) & (own[group] >= 0))
    if len(row):
        out.append((row, np.ones(len(row), dtype=np.int64), own[group[row]]))
        row = row[np.lexsort((rank[row], -n[row], group[row]))]
        g = group[row]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out.append((own[g[head]], np.diff(np.concatenate([head, [len(row)]])), row[head]))
    row, near, best = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near), pa.array(n[best]), pa.array([words[b] for b in best.tolist()], type=pa.string())], schema=_NEAR)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near_words over rows sorted by key; the last key of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> pa.RecordBatch:
        number = lambda c: table.column(c).to_numpy()
        return near_words(number("id"), table.column("word").to_pylist(), number("n"), number("first"), number("last"))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column("key")[-1]
        if batch.column("key")[0] == last:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(table.column("key").to_numpy(), last.as_py()))
        if cut:
            yield done(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form (word, form): the end of their chain."""
    reach = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reach.select(F.col("word").alias("via"), F.col("root").alias("next"))
        further = reach.join(on, F.col("root") == F.col("via"), "left")
        reach = stored(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if not reach.where("moved").limit(1).count():
            return reach.select("word", "root")
        reach = reach.drop("moved")


def spelling_groups(docs: DataFrame, least: int = LEAST, often: int = OFTEN, ratio: int = RATIO, odds: int = ODDS) -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    counted = variants(docs, least, odds).where(F.col("n") >= often)
    words = stored(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(keys, 1) / PART))))
    met = candidates(radix_parts(words, bits)).join(words, "id")
    near = met.select("key", "id", "first", "last", "word", "n").repartition("key").sortWithinPartitions("key").mapInArrow(_by_key, "id long, near long, best_n long, best string")
    most = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("most")
    near = near.groupBy("id").agg(F.sum("near").alias("n_near"), most)
    has = -F.col("most.n") >= ratio * F.col("n")
    rows = words.join(near, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("most.word")).alias("form"), F.when(has, -F.col("most.n")).cast("long").alias("form_n")
    )
    rows = stored(rows, "near-words")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))
