"""Snapshot files, logs and sinks.

A panel is a folder of q_YYYY-MM-DD.parquet files or one table partitioned by quarter_end; either way one scan
reads all of it, and quarters are chosen by a filter that prunes files.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
QUARTER_FILE = r"q_(\d{4}-\d{2}-\d{2})\.parquet"


def read_panel(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All snapshot files of a folder; file_quarter is the date in the file's name."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    label = F.to_date(F.regexp_extract(F.input_file_name(), QUARTER_FILE, 1))
    return df.select(*(columns or df.columns), label.alias("file_quarter"))


def select_quarters(df: DataFrame, only: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    col = F.col("quarter_end")
    if only:
        df = df.where(col == F.lit(only).cast("date"))
        if not df.limit(1).count():
            raise ValueError(f"no quarter {only}")
    if start:
        df = df.where(col >= F.lit(start).cast("date"))
    return df.where(col <= F.lit(end).cast("date")) if end else df


def quarter_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The quarters of a panel, by their folders' names, and the folders."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return {n.removeprefix("quarter_end="): f"{path}/{n}" for n in names if n.startswith("quarter_end=")}


def remove_twins(spark: SparkSession, path: str, written: list[str]) -> list[str]:
    """Remove mislabelled twins of quarters that were written: older runs named some quarters by the day after their end."""
    folders, removed = quarter_folders(spark, path), []
    for day in written:
        twin = (datetime.date.fromisoformat(day) + datetime.timedelta(days=1)).isoformat()
        if twin in folders and day in folders:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders[twin])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            removed.append(twin)
    return removed


def write_panel(df: DataFrame, path: str, overwrite: bool = False, key: str = "investor_id", files: int = 8) -> list[str]:
    """One partition for each quarter, written by `files` tasks by the hash of the key. Without overwrite, quarters that
    exist are left as they are. Returns the quarters written; their mislabelled twins go after that."""
    if not overwrite and (held := list(quarter_folders(df.sparkSession, path))):
        df = df.where(~F.col("quarter_end").cast("string").isin(held))
    df = df.withColumn("__file", F.pmod(F.xxhash64(key), F.lit(files)))
    before = set(quarter_folders(df.sparkSession, path))
    written = sorted(str(r[0]) for r in df.select(F.col("quarter_end").cast("string")).distinct().collect()) if overwrite else None
    df.repartition("quarter_end", "__file").drop("__file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter_end").parquet(path)
    if written is None:
        written = sorted(set(quarter_folders(df.sparkSession, path)) - before)
    remove_twins(df.sparkSession, path, written)
    return written


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def has_columns(spark: SparkSession, path: str, columns: list[str]) -> bool:
    """A schema probe: only footers are read."""
    return set(columns) <= set(spark.read.parquet(path).columns)


def read_tables(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, properties: dict | None = None) -> DataFrame:
    """A database table, one partition for each predicate; filters and column choices are pushed down."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {}) if predicates else spark.read.jdbc(url, table, properties=properties or {})


def with_retries(action: Callable[[], T], attempts: int = 4, wait: float = 5.0, reopen: Callable[[], None] | None = None) -> T:
    """action's result; a failed attempt waits `wait` seconds times its number, reopens the source and is done again."""
    for k in range(1, attempts):
        try:
            return action()
        except Exception:  # whatever a source throws; the last attempt's error goes through
            time.sleep(wait * k)
            if reopen is not None:
                reopen()
    return action()


def id_predicates(id_col: str, ids: list, chunk: int = 4000, where: str | None = None) -> list[str]:
    """Conditions `id IN (...)` of at most `chunk` distinct non-null ids each, for one partition of a database scan each."""
    quoted = [str(i) if isinstance(i, int) else "'" + str(i).replace("'", "''") + "'" for i in sorted({i for i in ids if i is not None})]
    extra = f" AND ({where})" if where else ""
    return [f"{id_col} IN ({', '.join(quoted[k : k + chunk])}){extra}" for k in range(0, len(quoted), chunk)]


def fetch_by_id_lists(read: Callable[[list[str]], DataFrame], id_col: str, ids: DataFrame, path: str, chunk: int = 4000, where: str | None = None, attempts: int = 4, wait: float = 5.0) -> DataFrame | None:
    """Rows of a remote table for a list of ids (one column) that the remote side must filter: read(predicates) scans
    one partition for each chunk, and the result is stored at path, so that a failed fetch is done again as a whole.
    None if there are no ids. Tables that Spark can read itself go through `lookup_by_ids`.
    """
    wanted = [r[0] for r in ids.distinct().collect()]
    predicates = id_predicates(id_col, wanted, chunk, where)
    if not predicates:
        return None
    with_retries(lambda: read(predicates).write.mode("overwrite").parquet(path), attempts, wait)
    return ids.sparkSession.read.parquet(path)


def union_present(frames: list[DataFrame | None]) -> DataFrame | None:
    """The union by name of the frames that are there."""
    out = None
    for f in (f for f in frames if f is not None):
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def lookup_by_ids(table: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of table whose id is among the distinct non-null ids (one column): a semi join in place of lists of ids."""
    wanted = ids.select(F.col(ids.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return table.join(wanted, id_col, "left_semi")


def training_history(spark: SparkSession, path: str, arm: str) -> DataFrame:
    """Loss logs (JSON, one object a file) as rows arm, metric, epoch, value; either spelling of a log's key is read."""
    schema = "pretrain_log array<struct<epoch:double, loss:double, eval_loss:double>>, finetune array<double>, finetune_log array<double>"
    h = spark.read.schema(schema).option("multiLine", True).json(path)
    pre = h.select(F.explode("pretrain_log").alias("p"))
    rows = pre.select(F.lit("train").alias("metric"), F.col("p.epoch").alias("epoch"), F.col("p.loss").alias("value"))
    rows = rows.unionByName(pre.select(F.lit("eval").alias("metric"), F.col("p.epoch").alias("epoch"), F.col("p.eval_loss").alias("value")))
    fine = h.select(F.posexplode(F.coalesce("finetune_log", "finetune")).alias("k", "value"))
    rows = rows.unionByName(fine.select(F.lit("finetune").alias("metric"), (F.col("k") + 1).cast("double").alias("epoch"), "value"))
    return rows.where("value IS NOT NULL").select(F.lit(arm).alias("arm"), "metric", "epoch", "value")
