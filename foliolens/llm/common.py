"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, whichever is reached first: a batch holds a few MB, or one longer text.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of its own only in local mode, as in tests, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="foliolens-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that very long texts fit a Python worker."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        held = str(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, a null text as an empty one; other columns are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free_name(name: str, columns: Iterable[str]) -> str:
    """name, with underscores behind it as long as a column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Copies of one row that one task writes in a row.
BLOCK = 10_000


def block_numbers(times: Column) -> Column:
    """0, 1, ... for the blocks of at most BLOCK copies."""
    return F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / BLOCK).cast("long"))


def numbers_in_block(block: Column, times: Column) -> Column:
    """The copies' numbers in a block, from 0 on over all blocks."""
    first = block * BLOCK
    return F.sequence(first, F.least(first + BLOCK, times) - 1)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def rows_to_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def per_batch(fn, *args):
    """A mapInArrow function that applies fn(batch, *args) -> RecordBatch to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch, *args)

    return run
