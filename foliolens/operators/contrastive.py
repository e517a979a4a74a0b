"""Contrastive training of token vectors: the two halves of a book shall be nearer to one another than to other books'.

A round takes all batches at once. Batches of books are laid out once, a row for each, with the numbers of their tokens; they stay where they are, and each
task reads the token vectors from the shared folder, as it would read a model. A batch pools its halves, takes the symmetric InfoNCE loss and carries its
gradient back to the tokens, summed by token over the task and then in the shuffle. The update (Adam with decoupled weight decay, warm-up, cosine decay, a
clipped gradient) is an expression over the token table, which is stored each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions.stats import numbered
from foliolens.operators.pooling import BATCH, dealt, group_codes, matrix_of, packs_of, whole, windows
from foliolens.sources.durable import read_in_task, stored, stored_at


def loss_and_gradient(e: np.ndarray, w: np.ndarray, book: np.ndarray, half: np.ndarray, n: int, scale: float = 20.0) -> tuple[float, np.ndarray]:
    """The symmetric loss of a batch of n books, and its gradient by each row's token vector. Rows: token vector, weight, number of the book,
    half 0 or 1. Books need both halves; the loss is the mean over books and both directions."""
    sums = np.zeros((2, n, e.shape[1]))
    np.add.at(sums, (half, book), w[:, None] * e)
    loss, back = _of_sums(sums, scale)
    return loss, w[:, None] * back[half, book]


def _of_sums(sums: np.ndarray, scale: float = 20.0) -> tuple[float, np.ndarray]:
    """The loss of a batch, and its gradient by the sums of both halves of its books."""
    n = sums.shape[1]
    size = np.maximum(np.linalg.norm(sums, axis=2, keepdims=True), 1e-12)
    u = sums / size
    s = scale * u[0] @ u[1].T
    own = np.arange(n)

    def soft(x: np.ndarray) -> tuple[np.ndarray, float]:
        x = x - x.max(axis=1, keepdims=True)
        p = np.exp(x)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((np.log(total[:, 0]) - x[own, own]).sum())

    (rows, l0), (cols, l1) = soft(s), soft(s.T)
    ds = (rows + cols.T) / (2 * n)
    ds[own, own] -= 1 / n
    du = scale * np.stack([ds @ u[1], ds.T @ u[0]])
    return (l0 + l1) / (2 * n), (du - u * (du * u).sum(axis=2, keepdims=True)) / size


#: Rows that are laid out by one task, at most.
PACK = 4_000_000
_LAID = pa.schema([("held", pa.bool_()), ("at", pa.list_(pa.int32())), ("w", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32()))])
_LOST = pa.schema([("nth", pa.int32()), ("g", pa.list_(pa.float32())), ("loss", pa.float64()), ("n", pa.int64()), ("held_loss", pa.float64()), ("held_n", pa.int64())])


def known_tokens(tokens: DataFrame) -> tuple[DataFrame, str]:
    """token, vec, nth, stored, and the path: numbers from 0 on."""
    return stored_at(numbered(tokens.select("token", F.col("vec").cast("array<double>").alias("vec")), [], ["token"], "nth").select("token", "vec", F.col("nth").cast("int").alias("nth")), "tokens")


def laid_out(rows: DataFrame, path: str, held: DataFrame | None = None) -> DataFrame:
    """held, at, w, sizes: a row for each batch of books, stored. Its positions are in order of half and book, sizes has their number for each of them; at:
    the number of a position's token. rows, and held (batches that are not trained on): batch, book, half, token, w; path: `known_tokens`. Positions of
    unknown tokens are left out, and then books without a half, as it pairs with nothing."""
    kind = lambda df, is_held: df.select(F.lit(is_held).alias("held"), "batch", "book", "half", "token", F.col("w").cast("double").alias("w"))
    rows = kind(rows, False) if held is None else kind(rows, False).unionByName(kind(held, True))
    packs = packs_of(rows.count(), PACK, rows.sparkSession.sparkContext.defaultParallelism)
    rows = dealt(rows, ["held", "batch"], packs).withColumn("__group", F.xxhash64("held", "batch"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for table in windows(batches, "__group"):
            if names is None:
                found = [b.filter(b.column("vec").is_valid()) for b in read_in_task(path, ["token", "nth", "vec"])]
                names, nth = (pa.chunked_array([b.column(c) for b in found], kind).combine_chunks() for c, kind in (("token", pa.string()), ("nth", pa.int32())))
                nth = nth.to_numpy()
                del found
            at = pc.index_in(whole(table.column("token")), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            table, at = table.filter(pa.array(at >= 0)), at[at >= 0]
            if not len(at):
                continue
            book, half = group_codes(table, ["held", "batch", "book"]), table.column("half").to_numpy().astype(np.int64)
            halves = np.zeros((int(book.max()) + 1, 2), dtype=bool)
            halves[book, half] = True
            batch = group_codes(table, ["held", "batch"])
            order = np.lexsort((book, half, batch))
            order = order[halves.all(axis=1)[book[order]]]
            if not len(order):
                continue
            first = np.flatnonzero(np.diff(batch[order], prepend=-1))  # of each batch
            some = np.flatnonzero((np.diff(batch[order], prepend=-1) != 0) | (np.diff(book[order], prepend=-1) != 0) | (np.diff(half[order], prepend=-1) != 0))  # of each half of a book
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            sizes = pa.array(np.diff(some, append=len(order)).astype(np.int32))
            columns = [
                table.column("held").take(pa.array(order[first])),
                pa.ListArray.from_arrays(ends, pa.array(nth[at[order]])),
                pa.ListArray.from_arrays(ends, pa.array(table.column("w").to_numpy()[order])),
                pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(some, first), len(some)).astype(np.int32)), sizes),
            ]
            yield from pa.table(columns, schema=_LAID).to_batches()

    out = rows.repartitionById(packs, "pack").sortWithinPartitions("__group").mapInArrow(lay, "held boolean, at array<int>, w array<double>, sizes array<int>")
    return stored(out, "laid")


def losses(laid: DataFrame, path: str, tokens: int, loss_only: bool = False) -> DataFrame:
    """nth, g, loss, n, held_loss, held_n: what each task's batches add to their tokens' gradients; one row of a task has the losses of its batches
    times their books, and the number of books, of those that are trained on and of the others. laid: `laid_out`; path: stored vectors of all `tokens` tokens.

    Vectors and gradients go to and from tasks as floats; sums, and the vectors that are trained, are doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = total = used = None
        found = {False: [0.0, 0], True: [0.0, 0]}
        for batch in batches:
            if not batch.num_rows:
                continue
            if x is None:
                for b in read_in_task(path, ["nth", "vec"]):
                    b = b.filter(b.column("vec").is_valid())
                    if b.num_rows:
                        part = matrix_of(pa.chunked_array([b.column("vec")]), b.num_rows)
                        x = np.zeros((tokens, part.shape[1]), dtype=np.float32) if x is None else x
                        x[b.column("nth").to_numpy()] = part
                total, used = np.zeros((0 if loss_only else tokens, x.shape[1])), np.zeros(tokens, dtype=bool)
            at, w, sizes = (batch.column(c).flatten().to_numpy() for c in ("at", "w", "sizes"))
            ends, books = (np.append(0, np.cumsum(pc.list_value_length(batch.column(c)).to_numpy())) for c in ("at", "sizes"))
            for k, is_held in enumerate(batch.column("held").to_pylist()):
                i, v, size = at[ends[k] : ends[k + 1]], w[ends[k] : ends[k + 1], None], sizes[books[k] : books[k + 1]]
                n = len(size) // 2
                loss, back = _of_sums(np.add.reduceat(x[i] * v, np.append(0, np.cumsum(size[:-1]))).reshape(2, n, -1))
                found[is_held][0] += loss * n
                found[is_held][1] += n
                if not is_held and not loss_only:
                    order = np.argsort(i, kind="stable")
                    g = (np.repeat(back.reshape(2 * n, -1), size, axis=0) * (v * n))[order]
                    first = np.flatnonzero(np.diff(i[order], prepend=-1))
                    total[i[order[first]]] += np.add.reduceat(g, first)
                    used[i] = True
        if x is not None:
            some = np.flatnonzero(used) if used.any() else np.array([-1])
            for a in range(0, len(some), 10_000):
                part = some[a : a + 10_000]
                lead = np.arange(a, a + len(part)) == 0
                g = total[part].astype(np.float32) if part[0] >= 0 else np.zeros((1, x.shape[1]), dtype=np.float32)
                g = pa.FixedSizeListArray.from_arrays(pa.array(g.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                sums = [pa.array(np.where(lead, found[is_held][c], 0)).cast((pa.float64(), pa.int64())[c]) for is_held in (False, True) for c in (0, 1)]
                yield pa.record_batch([pa.array(part.astype(np.int32)), g, *sums], schema=_LOST)

    rows = laid.coalesce(laid.sparkSession.sparkContext.defaultParallelism)  # a task has one table of vectors, whatever its batches
    return rows.mapInArrow(run, "nth int, g array<float>, loss double, n long, held_loss double, held_n long")


def gradients(rows: DataFrame, tokens: DataFrame, loss_only: bool = False) -> DataFrame:
    """`losses` of rows (batch, book, half, token, w) by tokens (token, vec)."""
    table, path = known_tokens(tokens)
    return losses(laid_out(rows, path), path, table.count(), loss_only)


def rate_at(step: int, steps: int, base: float, warm: int) -> float:
    """A linear rise over the first `warm` steps, then a cosine down to zero."""
    return base * (step + 1) / max(warm, 1) if step < warm else base * 0.5 * (1 + math.cos(math.pi * (step - warm) / max(steps - warm, 1)))


def mean_loss(rows: DataFrame, tokens: DataFrame) -> float | None:
    return gradients(rows, tokens, loss_only=True).agg(F.try_divide(F.sum("loss"), F.sum("n"))).first()[0]


def halves_of(positions: DataFrame, keys: list[str], item: str, weight: str = "w", rank: str = "rank", most: int = 124) -> DataFrame:
    """book, half, token, w: the even and odd ranks of each book's first positions."""
    rows = positions.where((F.col(rank) <= most) & (F.col(weight) > 0))
    return rows.select(F.concat_ws("/", *keys).alias("book"), (F.col(rank) % 2).cast("int").alias("half"), F.col(item).cast("string").alias("token"), F.col(weight).cast("double").alias("w"))


def in_batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """rows of books dealt into batches of about `size` books by hash; books are counted, rows are not moved."""
    n = rows.select("book").distinct().count()
    number = F.conv(F.substring(F.md5(F.col("book").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("batch", number % max(1, -(-n // size)))


def rounds(rows: DataFrame, tokens: DataFrame, steps: int = 10, rate: float = 0.02, warm_share: float = 0.1, decay: float = 0.01, most: float = 1.0, held: DataFrame | None = None) -> Iterator[tuple[DataFrame, float | None, float | None]]:
    """Before the first step and after each: the token table (token, vec), the training loss before the step, and the loss of the held-out batches now.
    Books that are trained on and others are read in the same pass."""
    state, path = known_tokens(tokens)
    n_tokens, zero = state.count(), F.transform("vec", lambda _: F.lit(0.0))
    laid = laid_out(rows, path, held)
    first = state.where("vec IS NOT NULL").select(F.size("vec")).first()
    state, loss, alone = state.withColumns({"m": zero, "v": zero}), None, laid.where("held")
    for k in range(steps + 1):
        last = k == steps
        parts = losses(alone if last else laid, path, n_tokens, last) if first else None
        if last:
            found = (None, None, *parts.agg(F.sum("held_loss"), F.sum("held_n")).first(), None) if first else None
        elif first:
            sums = F.array(*[F.sum(F.get("g", j).cast("double")) for j in range(first[0])])
            added = [F.sum(c).alias(c) for c in ("loss", "n", "held_loss", "held_n")]
            g = stored(parts.repartition("nth").groupBy("nth").agg(sums.alias("g"), *added), "gradient")
            square = F.sum(F.when(F.col("nth") >= 0, F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x)))
            found = g.agg(*[F.sum(c) for c in ("loss", "n", "held_loss", "held_n")], square).first()
        yield state.select("token", "vec"), loss, found[2] / found[3] if first and found[3] else None
        if last or not first or not found[1]:
            return
        loss, n = found[0] / found[1], found[1]
        norm = math.sqrt(found[4]) / n
        shrink, now = min(1.0, most / max(norm, 1e-12)), rate_at(k, steps, rate, max(1, round(warm_share * steps)))
        new = state.join(g.select("nth", "g"), "nth", "left").withColumn("g", F.coalesce(F.transform("g", lambda x: x / float(n) * shrink), F.transform("vec", lambda _: F.lit(0.0))))
        new = new.withColumns({"m": F.zip_with("m", "g", lambda m, x: 0.9 * m + 0.1 * x), "v": F.zip_with("v", "g", lambda v, x: 0.999 * v + 0.001 * x * x)})
        step = F.zip_with("m", "v", lambda m, v: m / (1 - 0.9 ** (k + 1)) / (F.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-8))
        state, path = stored_at(new.select("token", F.zip_with("vec", step, lambda x, s: x * (1 - now * decay) - now * s).alias("vec"), "nth", "m", "v"), "tokens")


def trained(rows: DataFrame, tokens: DataFrame, steps: int = 10, held: DataFrame | None = None, **more) -> Iterator[tuple[DataFrame, float, float | None]]:
    """After each step the token table (token, vec), the training loss before it, and that of the held-out batches after it."""
    for k, found in enumerate(rounds(rows, tokens, steps, held=held, **more)):
        if k:
            yield found
