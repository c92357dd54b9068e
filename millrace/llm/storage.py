"""Where intermediate results go when a lineage has to be cut."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import files
from ..sources.files import release

__all__ = ["cut", "release"]


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """As ``files.cut``: ``df`` written to the shared folder and read again.

    What was shuffled to make it isn't needed any more: Spark deletes it once the driver's plans of it are collected as
    garbage. ``free`` asks for that now, after large shuffles.
    """
    again = files.cut(df)
    if free:
        df.sparkSession.sparkContext._jvm.System.gc()
    return again
