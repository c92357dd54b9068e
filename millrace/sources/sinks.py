"""Side effects on rows that pass on unchanged."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TextIO

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from .files import cut

#: Lines that a task prints at a time.
_LINES = 1_000


def for_each(df: DataFrame, effect: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``effect`` on the rows and return the same rows.

    In a batch the rows are computed once and written to the shared folder; the effect runs at once, on all of them. On a
    stream it runs on each micro-batch, with ``start_for_each``.
    """
    if df.isStreaming:
        raise ValueError("use start_for_each on a stream")
    kept = cut(df)
    effect(kept)
    return kept


def start_for_each(df: DataFrame, effect: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a stream that hands each micro-batch and its number to ``effect``."""
    return df.writeStream.foreachBatch(effect).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watched(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation | None]:
    """The same rows, and aggregates over them that are there once an action has run; those of a stream's micro-batches go to a ``MetricsLog``."""
    if df.isStreaming:
        return df.observe(name, *(c.alias(n) for n, c in metrics.items())), None
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in metrics.items())), seen


def format_tuple(df: DataFrame, fields: list[str] | None = None) -> Column:
    """``Tuple({name=value},...)`` of the fields that aren't null."""
    names = sorted(fields or df.columns)
    each = [F.concat(F.lit(f"{{{n}="), F.col(n).cast("string"), F.lit("}")) for n in names]
    return F.concat(F.lit("Tuple("), F.array_join(F.array_compact(F.array(*each)), ","), F.lit(")"))


def console(df: DataFrame, text: Column | None = None, out: TextIO | str | None = None) -> DataFrame:
    """Print every row as text, and return the rows.

    Each task prints its own rows, whole lines at a time, and the driver gets none of them: to the console (log) of its
    executor, or to the file or device that ``out`` names on each machine. Only to an open file as ``out``, which the
    driver alone has, the driver prints; it takes all rows then, one partition at a time.
    """
    kept = cut(df)
    lines = kept.select((format_tuple(df) if text is None else text).alias("tuple"))
    if out is None or isinstance(out, str):
        lines.foreachPartition(lambda rows: _put(rows, out))
    else:
        for row in lines.toLocalIterator():
            print(row["tuple"], file=out)
    return kept


def _put(rows: Iterator[Row], path: str | None) -> None:
    with open(sys.stderr.fileno() if path is None else path, "ab", buffering=0, closefd=path is not None) as to:
        while some := list(islice(rows, _LINES)):
            to.write("".join(f"{row['tuple']}\n" for row in some).encode())


class MetricsLog(StreamingQueryListener):
    """Hands the metrics that ``df.observe`` gathers in each micro-batch of a stream to ``sink``: name, batch and values by name.

    Add it with ``spark.streams.addListener``.
    """

    def __init__(self, sink: Callable[[str, int, dict], None]) -> None:
        self.sink = sink

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.sink(name, event.progress.batchId, row.asDict())

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def metrics(df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    """``metric`` and ``value`` (a double) of aggregates gathered while the rows of ``df`` pass to a sink."""
    rows, seen = watched(df, name, **aggregates)
    rows.write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in seen.get.items()], "metric string, value double")
