"""Table schemas (as DDL), and the guards that stages run before they trust a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOLDINGS = "investor_id string, investor_type string, quarter_end date, issuer_id string, adj_mv double"
SEQUENCES = "quarter_end date, investor_id string, investor_type string, chunk_id int, tokens array<string>, weights array<double>, n_tokens int, n_assets_full int"
VECTORS = "investor_id string, investor_type string, quarter_end date, embedding array<double>"


class GateError(ValueError):
    """One or more quality gates failed; all of them are listed."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise GateError(f"missing columns: {', '.join(missing)}")
    return df


def optional_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a typed null for each column that it lacks."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns])


def assert_rows(df: DataFrame, rows: int, what: str) -> DataFrame:
    if (n := df.count()) != rows:
        raise GateError(f"{what}: {n} rows, expected {rows}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise GateError(f"{', '.join(keys)} is not unique: {twice[0].asDict()}")
    return df


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Every column but the keys with a prefix, so that joined dimensions never collide."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip nulls but not NaN: turn NaN into null where data come in."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])
