"""Whitening of embeddings by a covariance that is computed in tiles.

Dimensions are cut into tiles of TILE. Each Arrow batch of vectors is a row-block: its centred values are cut into column
blocks, one for each tile, which are shuffled by row-block; a pair of tiles is a key, for which the row-block's two
column blocks are multiplied; products are added up in each task and then by tile. A task never holds more than the
column blocks of a row-block and the sums of the tile pairs. The d x d covariance is assembled on the driver, whose eigenvectors
project every vector; the covariance of what comes out is measured by the same tiles.

Vectors become integers, x = floor(1024 c) + 100000, so that counts and sums are exact; sums are decimals of 38 digits, and
values are centred from n x - S, an integer too, before they are multiplied.

Defined cases: vectors that are null, or hold a null or a number that is not finite, are dropped; so are those of another length
than the most frequent one (the longer of equally frequent ones), and empty ones; entries beyond 2**30 in size count as
2**30; repeated rows each count, and a row without an id stays; a deviation that no long can hold is null; a component without
variance has whitened null and is left out of identity_error; fewer dimensions than components give fewer components; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import documents, small_batches, stored

SCALE, SHIFT, MOST = 1024, 100_000, 2.0**30
#: Dimensions of a tile; components that are returned.
TILE, COMPONENTS = 32, 8
REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and x, an array of longs, of the rows whose vectors are whole."""
    c = F.col(vec).cast("array<double>")
    whole = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), v)) * SCALE) + SHIFT)
    return df.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The lists of an Arrow column, all of length d, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def totals(rows: DataFrame, d: int, vec: str = "x") -> tuple[int, list]:
    """The number of rows and the exact sum of each dimension."""
    kind = dict(rows.dtypes)[vec]
    exact = kind == "array<bigint>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                s = [a + b for a, b in zip(s, _matrix(batch.column(vec), d).sum(axis=0).tolist(), strict=True)]
        if n:
            values = pa.array([Decimal(v) for v in s], type=pa.decimal128(38, 0)) if exact else pa.array(s, type=pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array([n] * d, type=pa.int64()), values], names=["i", "n", "s"])

    parts = rows.select(vec).mapInArrow(sums, f"i int, n long, s {'decimal(38,0)' if exact else 'double'}")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # d rows
    return (got[0]["n"], [int(r["s"]) if exact else r["s"] for r in got]) if got else (0, [0] * d)


def differences(x: np.ndarray, n: int, s: Sequence) -> np.ndarray:
    """n x - S: exact, as longs or, where those are too short, as Python's integers; as doubles for doubles."""
    if x.dtype.kind == "f":
        return n * x - np.array(s, dtype=float)
    if not x.size or n * int(np.abs(x).max()) < 2**61 and max(map(abs, s)) < 2**61:
        return n * x - np.array(s, dtype=np.int64)
    return n * x.astype(object) - np.array(s, dtype=object)


def deviations(diff: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; None beyond a long."""
    if diff.dtype != object and (not diff.size or int(np.abs(diff).max()) ** 2 * diff.shape[1] < 2**63):
        return (diff * diff).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in (sum(int(a) * int(a) for a in row) for row in diff)]


def column_blocks(rows: DataFrame, n: int, s: Sequence, tile: int = TILE, vec: str = "x") -> DataFrame:
    """block, tile, height, values: the centred columns of each row-block, as bytes of doubles, row by row."""
    d = len(s)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(b for b in batches if b.num_rows):
            y = differences(_matrix(batch.column(vec), d), n, s).astype(float) / n
            parts = [np.ascontiguousarray(y[:, j : j + tile]).tobytes() for j in range(0, d, tile)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k] * len(parts), type=pa.int64()), pa.array(range(len(parts)), type=pa.int32()), pa.array([len(y)] * len(parts), type=pa.int32()), pa.array(parts, type=pa.binary())],
                names=["block", "tile", "height", "values"],
            )

    return rows.select(vec).mapInArrow(cut, "block long, tile int, height int, values binary")


def covariance(rows: DataFrame, n: int, s: Sequence, tile: int = TILE, vec: str = "x") -> np.ndarray:
    """The covariance (divisor n) of the vectors, tile pair by tile pair."""
    d = len(s)
    blocks = column_blocks(rows, n, s, tile, vec)
    left = blocks.select("block", F.col("tile").alias("i"), "height", F.col("values").alias("a"))
    right = blocks.select(F.col("block").alias("other"), F.col("tile").alias("j"), F.col("values").alias("b"))
    pairs = left.join(right, (F.col("block") == F.col("other")) & (F.col("i") <= F.col("j"))).select("i", "j", "height", "a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, height, a, b in zip(*(batch.column(c) for c in ("i", "j", "height", "a", "b")), strict=True):
                x, y = (np.frombuffer(v.as_buffer()).reshape(height.as_py(), -1) for v in (a, b))
                key = i.as_py(), j.as_py()
                sums[key] = sums.get(key, 0) + x.T @ y
        for (i, j), m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(m), type=pa.int32()), pa.array([j] * len(m), type=pa.int32()), pa.array(range(len(m)), type=pa.int32()), pa.array(list(m), type=pa.list_(pa.float64()))], names=["i", "j", "r", "row"]
            )

    parts = pairs.mapInArrow(multiply, "i int, j int, r int, row array<double>")
    width = min(tile, d)
    got = parts.groupBy("i", "j", "r").agg(F.array(*[F.sum(F.get("row", k)) for k in range(width)]).alias("row")).collect()  # d * d numbers
    v = np.zeros((d, d))
    for r in got:
        row = np.array([x for x in r["row"] if x is not None])
        v[r["i"] * tile + r["r"], r["j"] * tile : r["j"] * tile + len(row)] = row
    v = np.triu(v) / n
    return v + np.triu(v, 1).T


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; of either sign the one whose largest entry is positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(v))])
    return values, vectors * np.where(sign == 0, 1, sign)


def whiten(df: DataFrame, vec: str = "embedding", most: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """A row for each whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    small_batches(spark)
    x = integer_vectors(df, vec)
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if length is None:
        return spark.createDataFrame([], REPORT)
    d = length["d"]
    rows = x.where(F.size("x") == d)
    n, s = totals(rows, d)
    v = covariance(rows, n, s, tile)
    values, vectors = components(v)
    k = min(most, d)
    trace = float(np.trace(v))
    good = values[:k] > max(trace, 0.0) * d * np.finfo(float).eps
    project = np.where(good, vectors[:, :k] / np.sqrt(np.where(good, values[:k], 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                diff = differences(_matrix(batch.column("x"), d), n, s)
                w = diff.astype(float) / n @ project
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(diff), type=pa.int64()), pa.array(list(w), type=pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    done = stored(rows.mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whitened")
    m, sums = totals(done, k, "w")
    error = np.abs(covariance(done, m, sums, tile, "w") - np.eye(k))[np.ix_(good, good)]
    explained = [float(e / trace) if trace > 0 else None for e in values[:k]]
    parts = [F.struct(F.lit(c + 1).alias("component"), (F.get("w", F.lit(c)) if good[c] else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[c]).cast("double").alias("explained")) for c in range(k)]
    out = done.select("vec_id", "deviation", F.explode(F.array(*parts)).alias("p"))
    return out.select("vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(float(error.max()) if error.size else 0.0).alias("identity_error"))


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(documents(spark, sf_dir, "embeddings"))
