"""Shards by a Feistel permutation of global row numbers.

Rows get global numbers in a fixed order that does not depend on files or partitions: by the bucket of
the row's hash, then by the row's values. A keyed Feistel network with cycle walking permutes 0..n-1;
row number r goes to shard p(r) mod shards, slot p(r) div shards. So the shuffle is reproducible,
every row's place can be computed from its number, a place's row number from the inverse, and shard
sizes differ by one row at most (the law `rows`).

Equal rows are counted before they are numbered, and written in blocks by many tasks, so a third of all rows
may be one row. The driver gets one number for each bucket.

Defined cases: nulls in any column are values like others; empty and very long texts count by size and checksum
alone, as no text is shuffled; repeated rows get places of their own, ties of hash fall to the values; an empty table
gives no rows; other columns than those asked for are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.common import BLOCK, block_numbers, documents, free_name, numbers_in_block, per_batch, small_batches

BUCKETS = 4096


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0..n-1: `rounds` of an alternating network on a x b >= n cells, walked until below n."""

    n: int
    seed: int = 17
    rounds: int = 6

    @property
    def bits(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _mix(self, half: np.ndarray, k: int) -> np.ndarray:
        x = half + np.uint64((self.seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.bits) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        width, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        left, right = x >> width, x & mask
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            left, right = (right ^ self._mix(left, k), left) if back else (right, left ^ self._mix(right, k))
        return (left << width) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def place(self, rows) -> np.ndarray:
        return self._walk(rows, False)

    def row(self, places) -> np.ndarray:
        return self._walk(places, True)


def numbered(df: DataFrame, buckets: int = BUCKETS, name: str = "row_number") -> tuple[DataFrame, int]:
    """df with a global row number, and the number of rows."""
    columns = df.columns
    bucket, digest, count, start, before, block = (free_name(c, columns) for c in ("bucket", "digest", "count", "start", "before", "block"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    counted = df.select(F.pmod(hashed, F.lit(buckets)).cast("int").alias(bucket), hashed.alias(digest), *[F.col(f"`{c}`") for c in columns])
    counted = counted.groupBy(*[F.col(f"`{c}`") for c in counted.columns]).agg(F.count(F.lit(1)).alias(count))
    sizes = {r[0]: r[1:] for r in counted.groupBy(bucket).agg(F.sum(count), F.max(count)).collect()}
    starts, n = [], 0
    for b in range(buckets):
        starts.append(n)
        n += sizes.get(b, (0,))[0]
    so_far = F.sum(count).over(Window.partitionBy(bucket).orderBy(digest, *[F.col(f"`{c}`") for c in columns]).rowsBetween(Window.unboundedPreceding, -1))
    first = df.sparkSession.createDataFrame([(b, s) for b, s in enumerate(starts)], f"`{bucket}` int, `{start}` long")
    placed = counted.withColumn(before, F.coalesce(so_far, F.lit(0))).join(F.broadcast(first), bucket).withColumn(block, F.explode(block_numbers(F.col(count))))
    if max((most for _, most in sizes.values()), default=0) > BLOCK:  # the copies of one row are written by many tasks
        placed = placed.repartition(digest, block)
    nth = F.transform(numbers_in_block(F.col(block), F.col(count)), lambda k: F.col(start) + F.col(before) + k)
    return placed.select(*[F.col(f"`{c}`") for c in columns], F.explode(nth).alias(name)), n


def assign_shards(df: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """df (its columns must be comparable) with row_number, shard and slot; own columns of these names get an underscore behind them."""
    for c in ("row_number", "shard", "slot"):
        if c in df.columns:
            df = df.withColumnRenamed(c, free_name(c, df.columns))
    rows, n = numbered(df)
    permutation = Feistel(n, seed)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = permutation.place(batch.column("row_number").to_numpy())
        return batch.append_column("shard", pa.array((p % shards).astype(np.int32))).append_column("slot", pa.array(p // shards))

    small_batches(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(per_batch(place), f"{kinds}, shard int, slot long")


def write_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 17, rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard, its files sorted by slot; a shard is spread over files by ranges of slots."""
    part = F.floor(F.col("slot") / rows_per_file)
    assign_shards(df, shards, seed).withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size and checksum of each document: what a loader needs to find and verify a row."""
    data = F.col("text").cast("string").cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.length(data), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
    )


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(digests(documents(spark, sf_dir)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
