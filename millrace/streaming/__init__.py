"""Keyed operators on streams: what a key has seen so far is its state, kept by Spark between micro-batches.

A micro-batch's rows are put in order by key before a step sees them; between
micro-batches the order is that of the source. Streams need the RocksDB state
store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import fresh_path

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: From a key's state (None at first) and its new rows in order to its state then and output rows (without the key).
Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


class _Keyed(StatefulProcessor):
    def __init__(self, keys: list[str], order_by: list[str], state: T.StructType, step: Step, outputs: list[str]) -> None:
        self.keys, self.order_by, self.schema, self.step, self.outputs = keys, order_by, state, step, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(self.order_by, kind="stable", ignore_index=True)
        state, out = self.step(self.state.get() if self.state.exists() else None, new)
        self.state.update(state)
        for name, value in zip(self.keys, key, strict=True):
            out[name] = value
        yield out[self.outputs]

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], state: str, step: Step, outputs: str) -> DataFrame:
    """A custom operator: ``step`` for each key and micro-batch; ``outputs`` are the columns beside ``keys``."""
    schema = T.StructType([*(stream.schema[k] for k in keys), *T.StructType.fromDDL(outputs)])
    processor = _Keyed(list(keys), list(order_by), T.StructType.fromDDL(state), step, schema.names)
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


#: Numbers of lots into which ``in_lots`` deals keys; a lot's keys share one state and one call for each micro-batch.
LOTS = 256

#: From the states of keys (a row each, null where there was none) and new rows (by key in order, ``_key`` the number of
#: its row of states, none skipped) to the states then and output columns, which keep the index of the rows they come from.
LotStep = Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]


class _Lots(StatefulProcessor):
    def __init__(self, columns: list[str], order_by: list[str], flags: dict[str, int], state: T.StructType, step: LotStep, carried: list[str], outputs: list[str]) -> None:
        self.columns, self.order_by, self.flags, self.fields, self.step, self.carried, self.outputs = columns, order_by, flags, state.fields, step, carried, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [T.StructField("_key", T.StringType()), *self.fields]
        self.state = handle.getValueState("states", T.StructType([T.StructField(c.name, T.ArrayType(c.dataType)) for c in columns]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1)  # Spark renames columns that begin with _
        own, names = pd.factorize(new["_key"])
        empty = {f"_null_{c}": new["_nulls"].to_numpy() >> k & 1 for c, k in self.flags.items()}
        new = new.assign(_key=own, **empty).sort_values(["_key", *(n for c in self.order_by for n in (f"_null_{c}", c) if n in new or n in empty)], kind="stable", ignore_index=True)
        known, *values = self.state.get() or [[] for _ in range(len(self.fields) + 1)]
        before = pd.DataFrame({f.name: pd.Series(v, dtype=None if v else object) for f, v in zip(self.fields, values, strict=True)})
        at = pd.Index(known, dtype=object).get_indexer(names)
        after, out = self.step(before.reindex(at).reset_index(drop=True), new)
        other = pd.Series(True, index=before.index)
        other.iloc[at[at >= 0]] = False
        kept = other.to_numpy().nonzero()[0]
        both = [[v[i] for i in kept] + after[f.name].tolist() for f, v in zip(self.fields, values, strict=True)]
        self.state.update(([known[i] for i in kept] + list(names), *both))
        yield new.loc[out.index, self.carried].assign(**out)[self.outputs]

    def close(self) -> None:
        pass


def _key_text(stream: DataFrame, name: str) -> Column:
    """A text that tells the values of a column apart as grouping does: exact for times, the same for both zeros."""
    kind, column = stream.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        column = F.unix_micros(column)
    elif isinstance(kind, T.BinaryType):
        column = F.hex(column)
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        column = column + F.lit(0.0)
    return column.cast("string")


def in_lots(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], state: str, step: LotStep, carried: Sequence[str], outputs: str, lots: int = LOTS) -> DataFrame:
    """As ``stateful``, for steps that take many keys at once: a call for each of ``lots`` and micro-batch, not for each key.

    ``keys`` and the columns ``carried`` of the rows that outputs come from pass on beside ``outputs``. Null keys are
    keys; null in an order column comes last. Keys are dealt by hash, so that a lot holds as many as the keys make it.
    """
    passed = list(dict.fromkeys([*keys, *carried]))
    whole = [c for c in dict.fromkeys([*passed, *order_by]) if isinstance(stream.schema[c].dataType, T.IntegralType)]
    flags = {c: k for k, c in enumerate(whole)}  # pandas has no null whole numbers
    nulls = sum((F.col(c).isNull().cast("bigint") * (1 << k) for c, k in flags.items()), F.lit(0).cast("bigint"))
    rows = stream.withColumns({"_key": F.to_json(F.array(*(_key_text(stream, k) for k in keys))), "_nulls": nulls})
    rows = rows.withColumns({"_lot": F.pmod(F.xxhash64("_key"), F.lit(lots)), **{c: F.coalesce(c, F.lit(0).cast(stream.schema[c].dataType)) for c in whole}})
    made = T.StructType.fromDDL(outputs)
    schema = T.StructType([*(stream.schema[c] for c in passed), *made, T.StructField("_nulls", T.LongType())])
    processor = _Lots(rows.columns, list(order_by), flags, T.StructType.fromDDL(state), step, [*passed, "_nulls"], schema.names)
    found = rows.groupBy("_lot").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
    back = lambda c: F.when(F.col("_nulls").bitwiseAND(F.lit(1 << flags[c]).cast("bigint")) == 0, F.col(c)).alias(c) if c in flags else F.col(c)
    return found.select(*(back(c) for c in passed), *made.names)


def stream_count_window(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], size: int, value: str) -> DataFrame:
    """``keys``, ``window``, ``total`` of every ``size`` values of a key; the open window waits in the state."""

    def step(before: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        n, rest = before["n"].astype("float64").fillna(0).astype("int64"), before["total"].astype("float64").fillna(0.0)
        own = rows["_key"]
        place = own.groupby(own).cumcount() + n.reindex(own).to_numpy()
        first = ~own.duplicated()
        number = (first | (place % size == 0)).cumsum()  # of the window
        waiting = pd.Series(rest.reindex(own).to_numpy(), index=rows.index).where(first & (place % size != 0), 0.0)
        sums = rows[value].fillna(0.0).groupby(number).cumsum() + waiting.groupby(number).cumsum()
        last = ~own.duplicated(keep="last")
        n, rest = (place[last] + 1).to_numpy(), sums[last].to_numpy()
        done = place % size == size - 1
        out = pd.DataFrame({"window": (place[done] // size).astype("int32"), "total": sums[done]})
        return pd.DataFrame({"n": n, "total": pd.Series(rest).where(n % size != 0, 0.0)}), out

    return in_lots(stream, keys, order_by, "n bigint, total double", step, [], "window int, total double")


def stream_ema(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, weight: float) -> DataFrame:
    """``keys``, ``order_by`` and ``value``: the exponential moving average at each row."""

    def step(before: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        own, numbers = rows["_key"], rows[value].fillna(0.0)
        old = before["value"].astype("float64").reindex(own).set_axis(rows.index)
        numbers = numbers.where(own.duplicated() | old.isna(), weight * numbers + (1 - weight) * old)
        found = numbers.groupby(own).ewm(alpha=weight, adjust=False).mean().droplevel(0)
        return pd.DataFrame({"value": found[~own.duplicated(keep="last")].to_numpy()}), pd.DataFrame({"_made": found})

    made = in_lots(stream, keys, order_by, "value double", step, order_by, "_made double")
    return made.withColumnRenamed("_made", "value")


def stream_running(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str) -> DataFrame:
    """``keys``, ``order_by``, ``n`` and ``total``: count and sum of a key's values up to each row."""

    def step(before: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        own = rows["_key"]
        n, total = before["n"].astype("float64").fillna(0).astype("int64"), before["total"].astype("float64").fillna(0.0)
        out = pd.DataFrame({"n": own.groupby(own).cumcount() + 1 + n.reindex(own).to_numpy(), "total": rows[value].fillna(0.0).groupby(own).cumsum() + total.reindex(own).to_numpy()})
        return out[~own.duplicated(keep="last")].reset_index(drop=True), out

    return in_lots(stream, keys, order_by, "n bigint, total double", step, order_by, "n bigint, total double")


def stream_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, take: str, value: str) -> DataFrame:
    """``keys``, ``by``, ``value`` of each left row, and ``take``, the key's latest right value (null too) at that time or before; without one there is no row.

    Both streams have the columns ``by``, and a double ``value`` or ``take``. Right rows come first where times tie. Null
    keys and times meet nothing.
    """
    each = [F.col(c).isNotNull() for c in (*keys, by)]
    ours = left.where(reduce(and_, each)).select(*keys, by, F.lit(1).alias("side"), F.col(value).cast("double").alias("number"))
    theirs = right.where(reduce(and_, each)).select(*keys, by, F.lit(0).alias("side"), F.col(take).cast("double").alias("number"))

    def step(before: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        own, numbers = rows["_key"], rows["number"].astype("float64")
        latest = pd.Series(rows.index, index=rows.index).where(rows["side"] == 0).groupby(own).ffill()
        old, seen = (before[c].astype("float64").reindex(own).set_axis(rows.index) for c in ("value", "seen"))
        met = numbers.reindex(latest).set_axis(rows.index).where(latest.notna(), old)
        seen = latest.notna() | (seen == 1)
        last = ~own.duplicated(keep="last")
        after = pd.DataFrame({"value": met[last].astype(object).where(met[last].notna(), None), "seen": seen[last].astype("int32")}).reset_index(drop=True)
        return after, pd.DataFrame({value: numbers, take: met})[(rows["side"] == 1) & seen]

    return in_lots(ours.unionByName(theirs), keys, [by, "side"], "value double, seen int", step, [by], f"{value} double, {take} double")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now, a micro-batch after the other, and return the rows that it wrote.

    Rows and checkpoint are in the shared folder, so that another executor can go on where one was lost.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)
    out = fresh_path(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``run_available``, for a stream that counts on: of each of ``keys`` (the rows' own) the last row that it gave.

    So windows that the watermark has not passed are there too, as they stand at the end of input.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)
    out = fresh_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*(F.col("last")[c].alias(c) if c in rest else c for c in stream.columns))


def as_stream(spark: SparkSession, df: DataFrame, by: str, keys: Sequence[str] = (), slices: int = 3, files: int | None = None) -> DataFrame:
    """The rows of ``df`` as a stream in ascending ``by`` (a whole number; null first): ``slices`` of them, one written after the other.

    A slice is written by ``files`` tasks (as many as there are shuffle partitions by default), each with the rows of its
    own ``keys``, and a micro-batch takes so many files, oldest first. So the rows of a key come in order of slices,
    whichever files share a micro-batch.
    """
    path = fresh_path(spark, "source")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = df.agg(F.min(by), F.max(by)).first()
    low = low or 0
    step = max(1, -(-((high or 0) - low + 1) // slices))
    own = F.coalesce(F.floor((F.col(by) - low) / step), F.lit(0))
    for k in range(slices):
        part = df.where(own == k)
        (part.repartition(files, *keys) if keys else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows by event-time window and keys; rows more than ``late`` behind are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
