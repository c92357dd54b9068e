"""Column expressions: typed access to fields, and summaries of a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import attach, numbered

#: Types a field can be read as.
KINDS = ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean", "binary")


def get(name: str, kind: str) -> Column:
    """A field as another type; numbers convert to each other, and what can't be converted is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown type {kind!r}")
    return F.col(name).cast(kind)


def get_or_default(name: str, kind: str, default: object) -> Column:
    """A field, or ``default`` where it is null."""
    return F.coalesce(get(name, kind), F.lit(default).cast(kind))


def get_or_fail(name: str, kind: str) -> Column:
    """A field; a null one ends the query with an error."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(get(name, kind))


def contains(name: str) -> Column:
    return F.col(name).isNotNull()


def list_or_empty(name: str) -> Column:
    """An array, or an empty one where it is null."""
    return F.coalesce(F.col(name), F.array())


def latest_of(*times: Column) -> Column:
    """The latest of several times, null if any is null."""
    known = F.lit(True)
    for t in times:
        known = known & t.isNotNull()
    return F.when(known, F.greatest(*times) if len(times) > 1 else times[0])


#: Percentiles of a summary.
SHARES = {"median": 0.5, "p75": 0.75, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p999": 0.999}


def summaries(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """``keys`` and mean, deviation, extremes and percentiles (exact, between two values in proportion) of a column's values that aren't null.

    Values get their positions range by range, and the few that a percentile lies between are picked by position, so no
    task holds the values of a group.
    """
    own = {"mean": F.avg(value), "stddev": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    whole = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in own.items()), F.count("*").alias("_n"))
    below = {n: F.floor((F.col("_n") - 1) * p) + 1 for n, p in SHARES.items()}
    placed = attach(numbered(rows, keys, [value], "_pos"), whole, keys, ["_n"])
    near = [c for b in below.values() for c in (b, b + 1)]
    at = lambda c: F.max(F.when(F.col("_pos") == c, F.col(value)))
    picked = placed.where(F.col("_pos").isin(*near)).groupBy(*keys).agg(*(c.alias(f"{s}_{n}") for n, b in below.items() for s, c in (("_low", at(b)), ("_high", at(b + 1)))))
    both = attach(whole, picked, keys, [c for c in picked.columns if c not in keys])
    rest = {n: (F.col("_n") - 1) * p - (below[n] - 1) for n, p in SHARES.items()}
    between = {n: F.col(f"_low_{n}") + rest[n] * (F.coalesce(f"_high_{n}", f"_low_{n}") - F.col(f"_low_{n}")) for n in SHARES}
    return both.select(*keys, *(F.round(n, digits).alias(n) for n in own), *(F.round(c, digits).alias(n) for n, c in between.items()))
