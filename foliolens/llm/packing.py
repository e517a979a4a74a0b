"""Best-fit packing of token sequences by a configuration linear program.

A document longer than the capacity is cut into full pieces, the remainder first. Only the histogram of
piece lengths (at most `capacity` numbers) reaches the driver. There the configuration program, whose
columns are the multisets of lengths that fit into one sequence, is solved fractionally by multiplicative
weights (`solve`): each length has a weight that falls as its demand gets covered, and a knapsack dynamic program
prices the best column of each length under the present weights; the weights also give a lower bound of any layout. The solution is
rounded down to whole columns, and what they leave is solved and rounded again; the last few sequences are placed by best fit
(`rounded`). Each piece finds its place by its rank among the pieces of its length.

Defined cases: a null text is an empty one, whose piece holds the end id only; a text of any length is encoded whole,
in parts of a few MB at word gaps, and cut; repeated rows stay and each
gets a place; ties of rank fall to the piece's own numbers; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.bpe import id_lists
from foliolens.llm.common import documents, id_text, per_batch, rows_to_batch, small_batches, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Groups into which the pieces of one length are dealt, so that no length is ranked in one task; full pieces, any number of them, into FULL times as many.
SALTS, FULL = 64, 64


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, the others are full."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(batch: pa.RecordBatch, tokenizer_path: str, end_id: int, capacity: int) -> pa.RecordBatch:
    lengths, ids = id_lists(tokenizer_path, batch.column("text"), end_id)
    data, at, rows = memoryview(np.ascontiguousarray(ids)).cast("B"), 0, []
    for doc, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
        rows += [(doc, k, s, m, zlib.crc32(data[4 * (at + s) : 4 * (at + s + m)])) for k, (s, m) in enumerate(cut(n, capacity))]
        at += n
    return rows_to_batch(_PIECES, zip(*rows, strict=True))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(per_batch(_pieces, tokenizer_path, end_id, capacity), PIECES)


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest total weight that fits into each room from 0 to capacity, by an unbounded knapsack program, and a length of
    that choice (-1: none beyond that of a smaller room). lengths: falling, so that of equal choices the longest is taken."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(-lengths, -np.arange(capacity + 1))
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if (k := fit[c]) < len(lengths):
            v = best[c - lengths[k:]] + weights[k:]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], last[c] = v[j], k + j
    return best, last


def chosen(lengths: np.ndarray, last: np.ndarray, room: int) -> list[int]:
    """The lengths (their places) that price() found best for a room."""
    out = []
    while room > 0:
        if (j := int(last[room])) < 0:
            room -= 1
        else:
            out.append(j)
            room -= int(lengths[j])
    return out


#: Of many rounds, only columns of at least this share of the best one's weight are used.
NEAR = 0.99
Column = tuple[tuple[int, ...], tuple[int, ...]]  # places of lengths, rising, and how often each is used


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int, rate: float, fade: float = 1.0) -> tuple[dict[Column, float], float]:
    """The configuration program, fractionally: how often each column is used, and a lower bound of the optimum.

    Multiplicative weights: a length's weight begins at its share of the capacity and falls by a power of the share of its
    demand that a round covers. Each round prices, by one knapsack program, the best column that holds each length, and
    uses it so often that it covers the scarcest of its lengths once. x over the mean cover is the average of the rounds; the rate falls by `fade`; weights over the
    weight of the best column are a solution of the dual program, whose value bounds every layout from below.
    """
    share = lengths / capacity
    log_weights, cover = np.zeros(len(lengths)), np.zeros(len(lengths))
    x: dict[Column, float] = defaultdict(float)
    low = 0.0
    for r in range(rounds):
        # of columns of one weight those of longer pieces come first: short ones fill the last gaps
        weights = share * np.exp(log_weights - log_weights.max()) + 1e-7 * share**2
        best, last = price(lengths, weights, capacity)
        low = max(low, float(weights @ need) / float(best[capacity]))
        if fade > 1 and r == rounds // 2:  # by now the weights have settled
            x.clear()
            cover[:] = 0
        covered = np.zeros(len(lengths))
        for k in range(len(lengths)):
            if fade > 1 and weights[k] + best[capacity - int(lengths[k])] < NEAR * best[capacity]:
                continue
            column = sorted([k, *chosen(lengths, last, capacity - int(lengths[k]))])
            parts = tuple(dict.fromkeys(column))
            each = tuple(column.count(p) for p in parts)
            where, times = np.array(parts), np.array(each)
            amount = float((need[where] / times).min())
            x[parts, each] += amount
            covered[where] += times * amount / need[where]
        cover += covered
        log_weights = np.maximum(log_weights - rate * fade ** (-r / rounds) * covered, log_weights.max() - 30)
    mean = max(float(cover.mean()), 1e-9)
    return {column: v / mean for column, v in x.items()}, low


def rounded(demand: dict[int, int], capacity: int, rounds: int, rate: float, fade: float, last: float) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """Whole counts of columns that hold the demand, how many sequences are columns of the program, and its lower bound.

    The fractional solution is rounded down, most used full columns first (after many rounds, with a rate that falls, others too); then,
    of a solution after few rounds or too small to round, columns of the longest pieces
    and the fullest of them first, as long as all their pieces are there. What is left is a smaller demand, whose program is solved again, until
    at most `last` of the sequences remain, or no column's pieces are all there; best fit places the rest, in the gaps of the columns too.
    """
    lengths = np.array(sorted((n for n, k in demand.items() if k > 0), reverse=True), dtype=np.int64)
    left = np.array([demand[n] for n in lengths.tolist()], dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = []
    low, all_of_it, before = 0.0, int(lengths @ left), math.inf
    while max(2 * capacity, last * all_of_it) < (todo := int(lengths @ left)) < before or not low:
        before = todo
        live = np.flatnonzero(left)
        own, rest = lengths[live], left[live].copy()
        x, bound = solve(own, rest, capacity, rounds, rate, fade)
        low = low or bound
        fill = {column: sum(int(own[p]) * e for p, e in zip(*column, strict=True)) for column in x}
        used = sorted((c for c in x if fill[c] == capacity or fade > 1), key=lambda c: (-x[c], c))
        whole = [(c, int(x[c])) for c in used]
        if fade == 1 or sum(k * fill[c] for c, k in whole) < 0.1 * todo:
            whole += [(c, todo) for c in sorted(x, key=lambda c: (c[0][0], -fill[c], -x[c], c))]
        for (parts, each), most in whole:
            where, times = np.array(parts), np.array(each)
            if count := min(most, int((rest[where] // times).min())):
                rest[where] -= times * count
                out.append(({int(own[p]): e for p, e in zip(parts, each, strict=True)}, count))
        left[live] = rest
    program = sum(k for _, k in out)
    return best_fit({int(n): int(k) for n, k in zip(lengths, left, strict=True) if k}, capacity, out), program, low


def best_fit(rest: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over counts of equal bins, into bins begun already too: {room: {contents: bins}}."""
    bins: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for column, k in begun:
        bins[capacity - sum(n * c for n, c in column.items())][tuple(sorted(column.items()))] += k
    for n in sorted(rest, reverse=True):
        todo = rest[n]
        while todo:
            room = min((r for r, groups in bins.items() if r >= n and groups), default=None)
            if room is None:
                fit = capacity // n
                if todo >= fit:
                    bins[capacity - n * fit][((n, fit),)] += todo // fit
                if todo % fit:
                    bins[capacity - n * (todo % fit)][((n, todo % fit),)] += 1
                break
            held, count = bins[room].popitem()
            put = min(todo, count)
            if count > put:
                bins[room][held] += count - put
            more = dict(held)
            more[n] = more.get(n, 0) + 1
            bins[room - n][tuple(sorted(more.items()))] += put
            todo -= put
    return [(dict(held), k) for groups in bins.values() for held, k in groups.items()]


#: Rounds, rate and its fall, and the share of the sequences that is left to best fit, of one rounding after another; more rounds where few lengths make them cheap.
TRIES, FEW, MORE = ((2, 0.1, 1.0, 0.0), (4, 0.1, 1.0, 0.2), (3, 0.1, 1.0, 0.0)), 64, ((100, 0.02, 10.0, 0.0),)


def layout(demand: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Columns and counts that hold the demand exactly, and a lower bound of the sequences of any layout.

    The program is rounded by each of TRIES until one needs no more sequences than the bound; the one of fewest
    sequences is the layout. Only if plain best fit needs fewer than all of them is that taken.
    """
    full, parts = demand.get(capacity, 0), {n: k for n, k in demand.items() if n < capacity and k}
    whole = [({capacity: 1}, full)] * (full > 0)
    if not parts:
        return whole, full
    least, found, count = -(-sum(n * k for n, k in parts.items()) // capacity), None, math.inf
    for way in (*TRIES, *(MORE if len(parts) <= FEW else ())):
        columns, _, low = rounded(parts, capacity, *way)
        least = max(least, math.ceil(low - 1e-6))
        if (n := sum(k for _, k in columns)) < count:
            found, count = columns, n
        if count <= least:
            break
    plain = best_fit(parts, capacity) if count > least else found
    if sum(k for _, k in plain) < count:
        found = plain
    return whole + found, full + least


def intervals(columns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go where: rank r of an interval goes to sequence base + (r - first) // each."""
    at: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for column, count in columns:
        offset = 0
        for n, k in sorted(column.items(), reverse=True):
            rows.append((n, at[n], sequence, k, offset))
            at[n] += k * count
            offset += n * k
        sequence += count
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "first": a[:, 1], "base": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


_PLACED = pa.schema([*_PIECES, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()), pa.field("least_sequences", pa.int64())])


def _place(batch: pa.RecordBatch, plan: dict[str, np.ndarray], least: int) -> pa.RecordBatch:
    n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
    k = np.searchsorted(plan["key"], (n << 44) + rank, side="right") - 1
    nth, each = rank - plan["first"][k], plan["each"][k]
    return rows_to_batch(_PLACED, [*(batch.column(f.name) for f in _PIECES), plan["base"][k] + nth // each, plan["offset"][k] + nth % each * n, np.full(len(n), least)])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, salts: int = SALTS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and in all rows the bound
    least_sequences, below which no layout of these pieces can get."""
    pieces = stored(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.when(F.col("length") == capacity, salts * FULL).otherwise(salts)).cast("int"))
    groups = pieces.groupBy("length", "salt").count().collect()  # at most (capacity + FULL) x salts rows
    demand: dict[int, int] = defaultdict(int)
    before = {}
    for r in sorted(groups, key=lambda r: (r["length"], r["salt"])):
        before[r["length"], r["salt"]] = demand[r["length"]]
        demand[r["length"]] += r["count"]
    keys = sorted(before)
    table = {"key": np.array([n * salts * FULL + s for n, s in keys], dtype=np.int64), "before": np.array([before[k] for k in keys], dtype=np.int64)}
    columns, least = layout(dict(demand), capacity)
    plan = intervals(columns)
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = pieces.withColumn("nth", (nth - 1).cast("long"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column("length").to_numpy() * salts * FULL + batch.column("salt").to_numpy()
        rank = table["before"][np.searchsorted(table["key"], key)] + batch.column("nth").to_numpy()
        return _place(batch.append_column("rank", pa.array(rank)), plan, least)

    return ranked.mapInArrow(per_batch(place), PIECES + ", sequence_id long, offset long, least_sequences long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
