"""Operators that look at one row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import numbered


def map_rows(df: DataFrame, **outputs: Column) -> DataFrame:
    """A new row for each row, of the named expressions only; nothing else is carried over."""
    return df.select(*(c.alias(n) for n, c in outputs.items()))


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of which ``condition`` is true; a null one drops the row."""
    return df.where(condition)


def flat_map(df: DataFrame, rows: Column, keep: Sequence[str] = (), out: str = "value") -> DataFrame:
    """No, one or more rows for each row: the elements of the array ``rows``, beside the columns ``keep``.

    Elements that are structs become columns; a null or empty array gives no row.
    """
    flat = df.select(*keep, F.explode(rows).alias(out))
    kind = flat.schema[out].dataType
    return flat.select(*keep, f"{out}.*") if isinstance(kind, T.StructType) else flat


def map_batches(df: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A Python mapper, filter or flat-mapper over Arrow batches, for what expressions can't say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield make(batch)

    return df.mapInPandas(run, schema)


def duplicate(df: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times; 0 drops all."""
    if times < 0:
        raise ValueError(f"times must not be negative, not {times}")
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_copy")


def passthrough(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The same rows, dealt out by ``keys``."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def mod_filter(df: DataFrame, mod: int, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows 0, ``mod``, 2 * ``mod`` ... of all, or of each key, in ``order_by``."""
    if mod < 1:
        raise ValueError(f"mod must be positive, not {mod}")
    return numbered(df, keys, order_by, "_pos").where((F.col("_pos") - 1) % mod == 0).drop("_pos")


def split_words(df: DataFrame, sentence: str, keep: Sequence[str] = (), out: str = "word") -> DataFrame:
    """One row for each piece between blanks of a text without its outer control characters and blanks.

    Blanks in a row have empty words between them, and an empty text is one empty word. A null text has none.
    """
    inner = F.regexp_replace(sentence, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    pieces = F.split(inner, " ")
    return df.select(*keep, F.explode(pieces).alias(out))


def cvwap(df: DataFrame) -> DataFrame:
    """``cvwap`` (100 times ``svwap`` by ``svolume``, null where that is 0) beside ticker and time."""
    return df.select("tickersymbol", F.try_divide(F.col("svwap"), F.col("svolume")).__mul__(100).alias("cvwap"), "timestamp")


def multiply(df: DataFrame, times: int, every: int = 17) -> DataFrame:
    """A load of known cost: ``val1 + val2``, multiplied ``times`` times by ``val1``; ``val1`` is the result, ``val2`` its negative.

    Every 17th row takes ``max(1, times / 64)`` more rounds, by its number in column ``seq``. Doubles throughout.
    """
    extra = F.when(F.col("seq") % every == 0, F.lit(max(1, times // 64))).otherwise(F.lit(0))
    rounds = F.sequence(F.lit(1), F.lit(times) + extra) if times else F.when(extra > 0, F.sequence(F.lit(1), extra)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(rounds, (F.col("val1") + F.col("val2")).cast("double"), lambda acc, _: acc * F.col("val1"))
    return df.withColumn("_total", total).withColumns({"val1": F.col("_total"), "val2": -F.col("_total")}).drop("_total")
