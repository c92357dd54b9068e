"""Count windows and running aggregates over rows in order, by key.

All take ``keys`` (none: all rows are one sequence) and ``order_by``, a total
order. A key's rows are split into ranges and blocks, so that none of these
operators needs a key's rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import attach, numbered, ranges_of

#: Rows of a key that one task looks at together, at least; more where a window is larger.
BLOCK_ROWS = 4096


def count_window(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], size: int, aggs: Mapping[str, Column], partial: bool = False, out: str = "window") -> DataFrame:
    """``keys``, ``window`` (0, 1, ... by key) and aggregates of every ``size`` rows; the last incomplete window only if ``partial``."""
    if size < 1:
        raise ValueError(f"size must be positive, not {size}")
    placed = numbered(df, keys, order_by, "_pos").withColumn(out, ((F.col("_pos") - 1) / size).cast("int"))
    found = placed.groupBy(*keys, out).agg(*(c.alias(n) for n, c in aggs.items()), F.count("*").alias("_n"))
    return (found if partial else found.where(F.col("_n") == size)).drop("_n")


def fold_window(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], size: int, start: Column, step: Callable[[Column, Column], Column], out: str = "value") -> DataFrame:
    """``keys``, ``window`` and the fold of every ``size`` rows in order: ``step(accumulator, row)`` from ``start``.

    ``row`` is a struct of all columns. A window is one row of ``size`` structs while it is folded.
    """
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)), F.struct(*df.columns).alias("row"))))
    found = count_window(df, keys, order_by, size, {"_rows": rows})
    return found.withColumn(out, F.aggregate("_rows", start, lambda acc, r: step(acc, r["row"]))).drop("_rows")


def moving(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], size: int, aggs: Mapping[str, Column], pos: str = "pos") -> DataFrame:
    """Adds ``pos`` (from 1) and aggregates over each row and the ``size - 1`` rows of its key before it, fewer at the start."""
    if size < 1:
        raise ValueError(f"size must be positive, not {size}")
    block = max(BLOCK_ROWS, 8 * size)
    own = ((F.col(pos) - 1) / block).cast("long")
    late = (F.col(pos) - 1) % block >= block - (size - 1)
    rows = numbered(df, keys, order_by, pos).withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-(size - 1), 0)
    return rows.withColumns({n: c.over(window) for n, c in aggs.items()}).where(F.col("_block") == own).drop("_block")


def sliding_count_window(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], size: int, aggs: Mapping[str, Column], slide: int = 1) -> DataFrame:
    """Columns of the last row of each window of ``size`` rows, and the window's aggregates; a window every ``slide`` rows once there are ``size``."""
    if slide < 1:
        raise ValueError(f"slide must be positive, not {slide}")
    found = moving(df, keys, order_by, size, aggs, "_pos")
    return found.where((F.col("_pos") >= size) & ((F.col("_pos") - size) % slide == 0)).drop("_pos")


def running(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds aggregates over all rows of the key up to each row.

    ``aggs`` gives for each new column a kind (sum, count, min, max, or last: the last value that isn't null) and a column.
    """
    made = {
        "sum": (F.sum, F.sum, lambda now, before: F.when(now.isNull(), before).otherwise(now + F.coalesce(before, F.lit(0)))),
        "count": (F.count, F.sum, lambda now, before: now + F.coalesce(before, F.lit(0))),
        "min": (F.min, F.min, F.least),
        "max": (F.max, F.max, F.greatest),
        "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), F.coalesce),
    }
    if unknown := {kind for kind, _ in aggs.values()} - set(made):
        raise ValueError(f"unknown aggregates: {sorted(unknown)}")
    ranges = ranges_of(df, order_by[0])
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    if ranges is None:
        return df.withColumns({n: made[kind][0](c).over(upto(*keys)) for n, (kind, c) in aggs.items()})
    placed = df.withColumn("_range", ranges)
    local = placed.withColumns({f"_now_{n}": made[kind][0](c).over(upto(*keys, "_range")) for n, (kind, c) in aggs.items()})
    end = lambda kind, c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order_by))) if kind == "last" else made[kind][0](c)
    ends = placed.groupBy(*keys, "_range").agg(*(end(kind, c).alias(f"_end_{n}") for n, (kind, c) in aggs.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_before_{n}": made[kind][1](f"_end_{n}").over(earlier) for n, (kind, _) in aggs.items()})
    both = attach(local, ends, [*keys, "_range"], [f"_before_{n}" for n in aggs])
    total = {n: made[kind][2](F.col(f"_now_{n}"), F.col(f"_before_{n}")) for n, (kind, _) in aggs.items()}
    return both.withColumns(total).drop("_range", *(f"_{s}_{n}" for n in aggs for s in ("now", "before")))


def ema(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, weight: float, out: str = "value") -> DataFrame:
    """``keys``, ``order_by`` and the exponential moving average at each row: the first value, then ``weight * x + (1 - weight) * before``.

    A null value counts as 0. Within blocks of a key the recurrence is a sum of values scaled by powers of
    ``1 - weight``; blocks are so short that the powers stay far from a double's limits, and each block adds what the
    blocks before it hand on, as far back as that isn't below a double's least.
    """
    if not 0 < weight <= 1:
        raise ValueError(f"weight must be above 0 and at most 1, not {weight}")
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    rows = numbered(df, keys, order_by, "_pos").select(*keys, *(c for c in order_by if c not in keys), x.alias("_x"), "_pos")
    if weight == 1:
        return rows.withColumn(out, F.col("_x")).drop("_x", "_pos")
    fall = -math.log(1 - weight)
    size = max(1, min(10_000, math.floor(138 / fall)))
    back = math.ceil(710 / (fall * size))
    rows = rows.withColumns({"_block": ((F.col("_pos") - 1) / size).cast("long"), "_k": ((F.col("_pos") - 1) % size + 1).cast("double")})
    scaled = F.when(F.col("_pos") == 1, F.col("_x")).otherwise(F.col("_x") * weight) * F.exp(F.col("_k") * fall)
    within = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_own", F.sum(scaled).over(within) * F.exp(F.col("_k") * -fall))
    ends = local.groupBy(*keys, "_block").agg(F.max_by("_own", "_k").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-back, -1)
    handed = F.aggregate(F.collect_list("_end").over(earlier), F.lit(0.0), lambda acc, e: acc * math.exp(-fall * size) + e)
    both = attach(local, ends.withColumn("_in", handed), [*keys, "_block"], ["_in"])
    return both.withColumn(out, F.col("_own") + F.col("_in") * F.exp(F.col("_k") * -fall)).drop("_x", "_pos", "_block", "_k", "_own", "_in")


def keyed_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key; only one row of a key leaves each task."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order_by)).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)
