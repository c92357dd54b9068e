"""Operators with several inputs that aren't joined by value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import attach, numbered

KEEP, OVERWRITE = "keep", "overwrite"


def interleave(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs; columns go by name, and one that an input lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def merge_sorted(left: DataFrame, right: DataFrame, by: str, order: Sequence[str] = (), keys: Sequence[str] = (), side: str = "side", pos: str = "pos") -> DataFrame:
    """Rows of both, with ``side`` (0: left) and their position ``pos`` in ascending ``by``; left ones come first where ``by`` ties, then ``order``."""
    both = interleave(left.withColumn(side, F.lit(0)), right.withColumn(side, F.lit(1)))
    return numbered(both, keys, [by, side, *order], pos)


def barrier(inputs: Sequence[DataFrame], order_by: Sequence[Sequence[str]], keys: Sequence[str] = (), policy: str = KEEP, unequal: str = "drop") -> DataFrame:
    """The k-th rows of all inputs as one row, for each key or over all rows.

    Of a column in several inputs the first value that isn't null counts (``keep``), or the last (``overwrite``).
    ``order_by`` has the order of each input. Rows without a partner in every input are dropped, or an error if
    ``unequal`` is ``error``.
    """
    if policy not in (KEEP, OVERWRITE):
        raise ValueError(f"policy must be {KEEP} or {OVERWRITE}, not {policy!r}")
    if unequal not in ("drop", "error"):
        raise ValueError(f"unequal must be drop or error, not {unequal!r}")
    if len(inputs) != len(order_by) or not inputs:
        raise ValueError("there must be an order for each input")
    if unequal == "error":
        counts = reduce(lambda a, b: a.unionByName(b), (df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, "n", F.lit(i).alias("port")) for i, df in enumerate(inputs)))
        odd = counts.groupBy(*keys).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("ports")).where((F.col("a") != F.col("b")) | (F.col("ports") != len(inputs)))
        if not odd.isEmpty():
            raise ValueError("the inputs have different numbers of rows")
    names = list(dict.fromkeys(c for df in inputs for c in df.columns if c not in keys))
    placed = []
    for i, (df, order) in enumerate(zip(inputs, order_by, strict=True)):
        rows = numbered(df, keys, order, "_pos")
        placed.append(rows.select(*keys, "_pos", *(F.col(c).alias(f"_{i}_{c}") for c in df.columns if c not in keys)))
    joined = placed[0]
    for other in placed[1:]:
        joined = attach(joined, other, [*keys, "_pos"], [c for c in other.columns if c not in (*keys, "_pos")])
    ports = range(len(inputs)) if policy == KEEP else reversed(range(len(inputs)))
    ports = list(ports)
    return joined.select(*keys, *(F.coalesce(*(F.col(f"_{i}_{c}") for i in ports if c in inputs[i].columns)).alias(c) for c in names))
