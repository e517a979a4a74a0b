"""Token-ID files: Parquet list columns in document order, read back selectively.

`write_token_files` range-partitions the documents by id, encodes each whole text, and lets Spark's
Parquet writer store one file for each range: the token ids as a dictionary-encoded list column, the
numbers (doc_id, places, counts) delta-encoded, in row groups and pages of a set size with page indexes,
so that a reader of a few documents or of the numbers alone touches few pages. `read_token_files` gives
each document's place in the whole stream from the files alone.

Defined cases: a null text is an empty one; an empty text has the end id only; a text of any length is one row,
encoded whole in parts of a few MB at word gaps, so only a single unbroken word must fit a worker; documents of equal id
stand in order of their text's hash; repeated rows stay; other columns are ignored; an empty table gives
no files' rows; a null id comes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.bpe import id_lists
from foliolens.llm.common import documents, id_text, per_batch, rows_to_batch, shared_path, small_batches

FILE_SCHEMA = "doc_id long, block int, row long, block_start long, n_tokens long, ids array<int>"

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "4000",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where there is no dictionary
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#row": "false",
    "parquet.enable.dictionary#block_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("row", pa.int64()), ("block_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode_blocks(tokenizer_path: str, end_id: int):
    def run(batches):
        block, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lengths, ids = id_lists(tokenizer_path, batch.column("text"), end_id)
            ends = np.cumsum(lengths)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), pa.array(ids, type=pa.int32()))
            yield rows_to_batch(_SCHEMA, [batch.column("doc_id"), np.full(n, block, dtype=np.int32), np.arange(row, row + n), start + ends - lengths, lengths, lists])
            row, start = row + n, start + int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, options: dict[str, str] | None = None) -> None:
    small_batches(docs.sparkSession)
    ordered = id_text(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode_blocks(tokenizer_path, end_id), FILE_SCHEMA).write.options(**WRITE_OPTIONS | (options or {})).parquet(path)


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("ids")
    offsets = lists.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("block_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return rows_to_batch(schema, [batch.column("doc_id"), batch.column("block"), batch.column("block_start"), np.diff(offsets).astype(np.int64), crc])


def block_starts(numbers: DataFrame) -> DataFrame:
    """Ids before each block: a row for each file, so at most as many as there are shuffle partitions."""
    totals = numbers.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    small_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = files.select("doc_id", "block", "block_start", "ids").mapInArrow(per_batch(_digest), "doc_id long, block int, block_start long, n_tokens long, ids_crc32 long")
    starts = block_starts(files.select("block", "n_tokens"))
    return rows.join(F.broadcast(starts), "block").select("doc_id", (F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The token ids of documents first..last: row groups and pages outside are skipped by their statistics."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(spark, path)
