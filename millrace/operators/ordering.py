"""Positions of rows in an order, by key, however many of the rows a key holds.

A key's rows are dealt to ranges of the first order column. Each range is put in
order by itself, and what the ranges before it hold is added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: About so many rows of all keys together lie in a range of the order column.
RANGE_ROWS = 200_000

#: Ranges there are at most, so that their bounds stay a short list; beyond, ranges hold more rows each.
MOST_RANGES = 4096
#: Values sampled for each bound of a column that isn't a number or a time.
_SAMPLED = 100

_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal", "boolean")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _bounds(df: DataFrame, by: str, ranges: int | None = None) -> tuple[Column, list]:
    """What to compare, and ascending values of it that cut the rows into about equal ranges. Numbers and times take one pass over ``df``."""
    kind = df.schema[by].dataType.typeName().split("(")[0]
    if kind in _NUMBERS or kind in _TIMES:
        value = F.col(by).cast("double") if kind in _NUMBERS else F.col(by).cast("timestamp").cast("double")
        share = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
        n, found = df.agg(F.count("*"), F.percentile_approx(value, F.lit(share), F.lit(4 * MOST_RANGES))).first()
    else:
        value = F.col(by)
        n = df.count()
        wanted = min(MOST_RANGES, ranges or math.ceil(n / RANGE_ROWS))
        if wanted <= 1:
            return value, []
        some = df.select(by).where(value.isNotNull()).sample(min(1.0, _SAMPLED * wanted / n), 7)
        found = [r[0] for r in some.orderBy(by).collect()]
    ranges = min(MOST_RANGES, ranges or math.ceil(n / RANGE_ROWS))
    found = found or []
    picked = [found[min(len(found) - 1, len(found) * k // ranges)] for k in range(1, ranges)] if found else []
    return value, list(dict.fromkeys(picked))


def _literal(value: object) -> Column:
    if isinstance(value, Row):
        return F.struct(*(_literal(v).alias(n) for n, v in value.asDict().items()))
    return F.array(*(_literal(v) for v in value)) if isinstance(value, list) else F.lit(value)


def ranges_of(df: DataFrame, by: str) -> Column | None:
    """The number of the range a row's ``by`` lies in, from 0, or None where one range holds all rows.

    Any type that can be put in order will do, and it is ranged by its whole values. Nulls are in the first range, as they
    come first in order; equal values share a range.
    """
    value, bounds = _bounds(df, by)
    if not bounds:
        return None
    powers = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    table = F.lit(bounds) if isinstance(bounds[0], (int, float, str)) else F.array(*(_literal(b).cast(df.schema[by].dataType) for b in bounds))
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when(F.get(table, at + p - 1) < value, at + p).otherwise(at))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns ``take`` of the row of ``right`` that has the same ``keys``; nulls equal each other."""
    names = [f"_key{i}" for i in range(len(keys))]
    other = right.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *take)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)), F.lit(True))
    return left.join(other, same, how).drop(*names)


def numbered(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "pos") -> DataFrame:
    """Adds a row's position among those of its key, from 1, in ascending ``order_by``, nulls first.

    ``order_by`` should be a total order: rows that tie in it take their positions in any order. Without ``keys`` all
    rows have one numbering. Rows of equal first order column and key are put in order by one task.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out!r} already")
    ranges = ranges_of(df, order_by[0])
    if ranges is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)).cast("long"))
    placed = df.withColumn("_range", ranges)
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order_by))
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return attach(placed.withColumn("_here", here), offsets, [*keys, "_range"], ["_before"]).withColumn(out, F.col("_here") + F.col("_before")).drop("_range", "_here", "_before")
