"""Wide tables from many dimensions, without losing or multiplying rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.schemas import assert_rows, assert_unique


def assembled(base: DataFrame, dims: dict[str, DataFrame], key: str) -> DataFrame:
    """base with the columns of each dimension, by left joins on the key; the number of rows is checked.

    A dimension must have its key once. A column that is there already gets the dimension's name behind it. A null key
    matches nothing.
    """
    out, rows = base, base.count()
    for name, dim in dims.items():
        assert_unique(dim.where(F.col(key).isNotNull()), [key])
        taken = set(out.columns) - {key}
        out = out.join(dim.select(key, *[F.col(c).alias(f"{c}_{name}" if c in taken else c) for c in dim.columns if c != key]), key, "left")
    return assert_rows(out, rows, "assembly")


def first_match(df: DataFrame, lookup: DataFrame, key: str, order: list) -> DataFrame:
    """df with the first row in order of those that lookup has for its key; nulls where there is none."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.join(lookup.withColumn("__nth", nth).where("__nth = 1").drop("__nth"), key, "left")


def all_of(groups: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """A summary for every member of groups, those without one included: the right join of summary and groups."""
    return summary.join(groups, key, "right")
