"""Tables in the shared folder of the session: cut lineage, survive lost executors, and serve as named caches."""

from __future__ import annotations

import json
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only in local mode, as in tests, where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="foliolens-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_STORED: weakref.WeakSet = weakref.WeakSet()


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The stored table and its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED.add(found)
    return found, path


#: Names of Hadoop's file systems that are others in Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def read_in_task(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A stored table as a task reads it from the shared folder, batch by batch."""
    at = urlsplit(path)
    if at.scheme in ("", "file"):
        files, root = fs.LocalFileSystem(), unquote(at.path) if at.scheme else path
    else:
        files, root = fs.FileSystem.from_uri(path.replace(at.scheme, _SCHEMES.get(at.scheme, at.scheme), 1))
    for part in sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")):
        with files.open_input_file(part) as f:
            yield from pq.ParquetFile(f).iter_batches(10_000, columns=columns)


_NAMED: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, path: str) -> int:
    """A number for the files of a folder, its subfolders' one level down too: names, sizes and times of change."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    found = []
    for s in files.listStatus(root):
        inner = files.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in inner]
    return zlib.crc32(repr(sorted(found)).encode())


def cached(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored table, made once for each application, key and state of its input; key: a name, the input's folder, and more. What make()
    has stored itself is not written again."""
    held = (spark.sparkContext.applicationId, *key, input_state(spark, key[1]))
    if held not in _NAMED:
        made = make()
        _NAMED[held] = made if made in _STORED else stored(made, "-".join(str(k).split("/")[-1] for k in key))
    return _NAMED[held]


def forget() -> None:
    """Drop all named tables, so that the next use makes them anew."""
    _NAMED.clear()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Read path if it is complete, else make and write it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def covering(spark: SparkSession, path: str, ids: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """Reuse path only if it holds every requested id; ids: one column, the key."""
    if exists(spark, f"{path}/_SUCCESS"):
        held = spark.read.parquet(path)
        if not ids.join(held, ids.columns, "left_anti").limit(1).count():
            return held
    new = stored(make(), "covering")
    new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(spark: SparkSession, path: str, params: DataFrame, provenance: dict) -> None:
    """A model as a table of parameters and one row of provenance."""
    params.write.mode("overwrite").parquet(f"{path}/params")
    spark.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "provenance string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")


def load_model(spark: SparkSession, path: str, provenance: dict) -> DataFrame | None:
    """The parameters, or None if they were fitted on something else."""
    if not exists(spark, f"{path}/provenance/_SUCCESS"):
        return None
    found = json.loads(spark.read.text(f"{path}/provenance").first()[0])
    return spark.read.parquet(f"{path}/params") if all(found.get(k) == v for k, v in provenance.items()) else None
