"""Columns that shape token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 62


def chunk_of(rank: Column, n: Column, context: int = CONTEXT) -> Column:
    """The chunk of a position: equal chunks, as few as fit the context."""
    k = F.ceil(n / F.lit(context))
    return F.when(n <= context, 1).otherwise(F.ceil(rank / F.ceil(n / k))).cast("int")


def chunks(tokens: Column, context: int = CONTEXT) -> Column:
    """An array cut into equal chunks."""
    n = F.size(tokens)
    k = F.greatest(F.ceil(n / F.lit(context)), F.lit(1)).cast("int")
    each = F.greatest(F.ceil(n / k), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(tokens, i * each + 1, each))


def halves(tokens: Column, context: int = CONTEXT) -> tuple[Column, Column]:
    """Ranks 1, 3, 5 ... and 2, 4, 6 ... of the first two contexts."""
    top = F.slice(tokens, 1, 2 * context)
    return F.filter(top, lambda x, i: i % 2 == 0), F.filter(top, lambda x, i: i % 2 == 1)


def wrapped(ids: Column, context: int = CONTEXT, pad: int = 0, cls: int = 2, sep: int = 3) -> Column:
    """cls, the first ids, sep, and padding up to context + 2."""
    body = F.slice(ids, 1, context)
    return F.concat(F.array(F.lit(cls)), body, F.array(F.lit(sep)), F.array_repeat(F.lit(pad), F.lit(context) - F.size(body)))


def rank_weights(n: Column, scheme: str, alpha: float = 1.0) -> Column:
    """Weights of ranks 1..n that sum to 1: uniform, zipf (1/r), power (r^-alpha) or exp (e^-alpha(r-1))."""
    raw = {
        "uniform": lambda r: F.lit(1.0),
        "zipf": lambda r: 1.0 / r,
        "power": lambda r: F.pow(r.cast("double"), F.lit(-alpha)),
        "exp": lambda r: F.exp(-alpha * (r - 1)),
    }[scheme]
    w = F.transform(F.sequence(F.lit(1), n), raw)
    return F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda s, v: s + v))


def normalised(weights: Column) -> Column:
    """Negative weights clipped, the rest over their sum; uniform if nothing is left."""
    kept = F.transform(weights, lambda x: F.greatest(F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)
    return F.transform(kept, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(kept)))


def quarter_ends(start: Column, end: Column) -> Column:
    """Month ends of quarters between two dates, from quarter starts, so that no month-end rolls over."""
    starts = F.sequence(F.date_trunc("quarter", start).cast("date"), F.date_trunc("quarter", end).cast("date"), F.expr("INTERVAL 3 MONTHS"))
    return F.transform(starts, lambda d: F.last_day(F.add_months(d, 2)))


def quarter_end_of(label: Column) -> Column:
    """The last day of a quarter written as YYYY-Qn; null for anything else."""
    year, quarter = F.regexp_extract(label, r"^(\d{4})-Q([1-4])$", 1), F.regexp_extract(label, r"^(\d{4})-Q([1-4])$", 2)
    return F.when(year != "", F.last_day(F.make_date(year.try_cast("int"), quarter.try_cast("int") * 3, F.lit(1))))


def quarter_label(d: Column) -> Column:
    """YYYY-Qn of a date."""
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def is_quarter_end(d: Column) -> Column:
    return F.date_format(d, "MM-dd").isin("03-31", "06-30", "09-30", "12-31")


def truthy(flag: Column) -> Column:
    """A flag that is missing or says 1, Y or TRUE."""
    return flag.isNull() | F.upper(flag.cast("string")).isin("1", "Y", "TRUE")
