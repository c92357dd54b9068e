"""Joins by position and by time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranges_of


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, take: Sequence[str], order: Sequence[str] = (), exact: bool = True, how: str = "inner") -> DataFrame:
    """Each row of ``left`` with the columns ``take`` of the latest row of ``right`` that has the same ``keys`` and an earlier ``by``, or the same if ``exact``.

    Of right rows with equal ``by`` the last in ``order`` counts. Null keys match each other; a right row with a null
    ``by`` is never met, and a left one meets nothing. ``how`` is inner or left. Taken columns must not be in ``left``.

    ``by`` may be of any type that can be put in order. A key may hold any share of the rows: these are dealt to ranges of ``by``, each range is put in order by itself,
    and what a range ends with is handed on to the later ranges of its key.
    """
    keys, take = list(keys), list(take)
    if clash := set(take) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    taken = F.struct(*take)
    ours = left.select(*keys, F.col(by).alias("_by"), F.lit(1 if exact else 0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(taken.alias("t")).schema["t"].dataType).alias("_taken"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)))
    theirs = right.where(F.col(by).isNotNull()).select(*keys, F.col(by).alias("_by"), F.lit(0 if exact else 1).alias("_side"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), taken.alias("_taken"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    both = ours.unionByName(theirs)
    ranges = ranges_of(both, "_by")
    both = both.withColumn("_range", F.lit(0) if ranges is None else ranges)
    sort = [F.col("_by"), F.col("_side"), *(F.col(f"_o{i}") for i in range(len(order)))]
    here = F.last("_taken", ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_met", here).where(F.col("_row").isNotNull())
    if ranges is not None:
        when = F.when(F.col("_taken").isNotNull(), F.struct("_by", *(f"_o{i}" for i in range(len(order)))))
        ends = both.groupBy(*keys, "_range").agg(F.max_by("_taken", when).alias("_end"))
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        handed = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), before.alias("_handed"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
        found = found.join(handed, same).withColumn("_met", F.coalesce("_met", "_handed"))
    found = found.withColumn("_met", F.when(F.col("_by").isNotNull(), F.col("_met")))
    if how == "inner":
        found = found.where(F.col("_met").isNotNull())
    elif how != "left":
        raise ValueError(f"how must be inner or left, not {how!r}")
    return found.select("_row.*", *(F.col("_met")[c].alias(c) for c in take))
