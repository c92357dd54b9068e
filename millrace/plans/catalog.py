"""Queries over the test tables, by name."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import joins, merges, ordering, stateless, windows
from ..sources import generators as made
from ..sources.files import fresh_path, log_lines, sentences_of, table, words_of
from ..sources.sinks import console, for_each, format_tuple, metrics
from . import apps
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
E = ["ts", "event_id"]
U = ["user_id"]


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__.rstrip("_")] = make
    return make


def events(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.where(F.col("event_type") == kind) if kind else rows


# Sources and sinks


@query
def src_beacon(spark, sf):
    return made.beacon(spark, 5000, n=F.col("id"), square=F.col("id") * F.col("id"))


@query
def src_memorizing(spark, sf):
    return made.keyed_values(spark, 500, 10, 8)


@query
def src_trades(spark, sf):
    return made.trades(spark, 5000)


@query
def src_quotes(spark, sf):
    return made.quotes(spark, 5000)


@query
def src_sentences(spark, sf):
    return made.sentences(spark, 2000)


@query
def src_logs(spark, sf):
    return apps.failed_logins(made.failed_logins(spark, 3000))


@query
def src_log_file(spark, sf):
    """Lines of syslog files that are made from events; some are of another month, some are failed logins."""
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    failed = F.when(n % 5 == 0, F.lit("authentication failure")).otherwise(F.col("event_type"))
    line = F.concat_ws(" ", F.when(n % 3 == 0, "Sep").otherwise("Aug"), text(n % 28 + 1), F.lit("10:00:00"), F.concat(F.lit("host"), text(F.col("user_id") % 7)), F.concat(F.when(n % 2 == 0, "sshd").otherwise("cron"), F.lit(":")), failed, text(n))
    path = fresh_path(spark, "logs")
    events(spark, sf).select(line.alias("value")).write.text(path)
    return log_lines(spark, path).select("host", "srvc", F.array_join("msg", " ").alias("msg"))


@query
def src_sentences_file(spark, sf):
    """Sentences of the words of a word file; how often each number of words and each partition occurs."""
    path = fresh_path(spark, "words")
    events(spark, sf).select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("value")).write.text(path)
    made_ = sentences_of(words_of(spark, path), 3, 9, 40)
    words = F.split("sentence", " ")
    known = F.forall(words, lambda w: w.rlike("^w[0-9]+$"))
    return made_.select(F.size(words).alias("words"), "partition_index", known.alias("known")).groupBy("words", "partition_index", "known").agg(F.count("*").alias("n"))


@query
def src_rated(spark, sf):
    """A source of 100 rows a second for two seconds, a pause of one, then twice the rate: rows by tenth of a second."""
    rows = made.rated(spark, [(2, 100), (1, 0), (2, 200)], key1=(F.col("id") % 10).cast("int"))
    return rows.groupBy(F.floor(F.col("at") / 100).cast("long").alias("tenth")).agg(F.count("*").alias("n"), F.sum("key1").alias("keys"))


@query
def sink_metrics(spark, sf):
    """Metrics of the events as they pass to a sink."""
    own = {"rows": F.count("*"), "least": F.min("value"), "most": F.max("value"), "users": F.max("user_id")}
    return metrics(events(spark, sf), f"events-{uuid.uuid4().hex}", **own)


@query
def sink_foreach(spark, sf):
    return for_each(events(spark, sf), lambda df: df.write.format("noop").mode("overwrite").save())


@query
def sink_console(spark, sf):
    """Every tuple as it is printed; each task prints to a null device here."""
    rows = events(spark, sf).select("event_id", "user_id", "event_type")
    shown = console(rows, out=os.devnull)
    return shown.select("event_id", format_tuple(rows).alias("tuple"))


# One row at a time


@query
def map_(spark, sf):
    return stateless.map_rows(events(spark, sf), event_id=F.col("event_id"), v2=F.col("value") * 2, kind=F.upper("event_type"))


@query
def filter_(spark, sf):
    return stateless.filter_rows(events(spark, sf), (F.col("event_type") == "purchase") & (F.col("value") > 10))


@query
def flat_map(spark, sf):
    pair = F.array(F.struct(F.lit("value").alias("name"), F.col("value").alias("number")), F.struct(F.lit("user").alias("name"), F.col("user_id").cast("double").alias("number")))
    return stateless.flat_map(events(spark, sf), pair, ["event_id"])


@query
def map_batches(spark, sf):
    return stateless.map_batches(events(spark, sf).select("event_id", "value"), lambda b: b.assign(value=b["value"] * 2), "event_id bigint, value double")


@query
def duplicate(spark, sf):
    return stateless.duplicate(events(spark, sf), 4)


@query
def passthrough(spark, sf):
    return stateless.passthrough(events(spark, sf), U)


@query
def mod_filter(spark, sf):
    return stateless.mod_filter(events(spark, sf), 4, E)


@query
def split_words(spark, sf):
    return stateless.split_words(table(spark, sf, "documents"), "text", ["doc_id"])


@query
def cvwap(spark, sf):
    return stateless.cvwap(apps.vwap(trades(spark, sf), ["timestamp", "event_id"]).select("tickersymbol", "svwap", "svolume", "timestamp")).withColumn("cvwap", F.round("cvwap", 6))


@query
def multiply(spark, sf):
    return stateless.multiply(made.keyed_values(spark, 500, 10, 8), 4)


@query
def typed_fields(spark, sf):
    rows = events(spark, sf)
    return rows.select("event_id", fn.get("value", "int").alias("whole"), fn.get_or_default("value", "double", 0.0).alias("value"), fn.get_or_fail("user_id", "int").alias("user"), fn.contains("event_type").alias("has_type"))


# Windows and running aggregates


@query
def count_window(spark, sf):
    aggs = {"n": F.count("*"), "first_ts": F.min("ts"), "last_ts": F.max("ts"), "total": F.round(F.sum("value"), 4)}
    return windows.count_window(events(spark, sf), U, E, 5, aggs)


@query
def exact_batches(spark, sf):
    return windows.count_window(events(spark, sf), U, E, 5, {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}, partial=True)


@query
def fold_window(spark, sf):
    """A reducer that sums from 2, as an arbitrary fold."""
    return windows.fold_window(events(spark, sf), U, E, 3, F.lit(2.0), lambda acc, r: acc + r["value"]).withColumn("value", F.round("value", 4))


@query
def minmax_window(spark, sf):
    aggs = {"last": F.max("event_id"), "first": F.min("event_id"), "kind": F.max_by("event_type", F.struct(*E))}
    return windows.count_window(events(spark, sf), U, E, 5, aggs)


@query
def sliding_count_window(spark, sf):
    found = windows.sliding_count_window(events(spark, sf), U, E, 5, {"total": F.sum("value")}, 2)
    return found.select("event_id", "user_id", F.round("total", 4).alias("total"))


@query
def sma(spark, sf):
    return windows.moving(events(spark, sf), U, E, 10, {"mean": F.avg("value")}).select("event_id", "user_id", F.round("mean", 6).alias("mean"))


@query
def ema(spark, sf):
    return windows.ema(events(spark, sf), [], E, "value", 0.3).select("event_id", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query
def ema_keyed(spark, sf):
    return windows.ema(events(spark, sf), U, E, "value", 0.3).select("event_id", "user_id", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query
def running_count(spark, sf):
    return windows.running(events(spark, sf), U, E, {"n": ("count", "event_id")}).select("event_id", "user_id", "n")


@query
def running_sum(spark, sf):
    return windows.running(events(spark, sf), U, E, {"total": ("sum", "value")}).select("event_id", "user_id", F.round("total", 4).alias("total"))


@query
def keyed_last(spark, sf):
    return windows.keyed_last(events(spark, sf), U, E)


@query
def latest_per_key(spark, sf):
    return windows.keyed_last(events(spark, sf), ["event_type"], E)


@query
def max_monotone(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max("value").alias("most"))


@query
def global_count(spark, sf):
    return events(spark, sf).agg(F.count("*").alias("n"))


@query
def latency_summary(spark, sf):
    return fn.summaries(events(spark, sf), ["event_type"], "value", 4)


# Several inputs


@query
def interleave(spark, sf):
    return merges.interleave(events(spark, sf, "view"), events(spark, sf, "click"))


@query
def interleave_any(spark, sf):
    return merges.interleave(events(spark, sf, "view").select("event_id", "user_id"), events(spark, sf, "click").select("user_id", "event_id"))


@query
def merge_sorted(spark, sf):
    return merges.merge_sorted(events(spark, sf, "view"), events(spark, sf, "click"), "ts", ["event_id"]).select("event_id", "side", "pos")


def _barrier(spark: SparkSession, sf: str, keys: list[str], policy: str) -> DataFrame:
    views, clicks = (events(spark, sf, k).select("user_id", F.col("event_id").alias(f"{k}_id"), "ts", "value") for k in ("view", "click"))
    return merges.barrier([views, clicks], [["ts", "view_id"], ["ts", "click_id"]], keys, policy)


@query
def barrier_keep(spark, sf):
    return _barrier(spark, sf, U, merges.KEEP)


@query
def barrier_overwrite(spark, sf):
    return _barrier(spark, sf, U, merges.OVERWRITE)


@query
def barrier_global(spark, sf):
    return _barrier(spark, sf, [], merges.KEEP)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "purchase").select(F.col("user_id").alias("tickersymbol"), F.col("value").alias("myvwap"), F.lit(1.0).alias("volume"), F.col("ts").alias("timestamp"), "event_id")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Prices by 100, so that gains stay within what an exponential can hold."""
    return events(spark, sf, "view").select(F.col("user_id").alias("tickersymbol"), (F.col("value") / 100).alias("askptickersymbolprice"), F.lit(1).alias("asksize"), F.col("ts").alias("timestamp"))


@query
def asof_join(spark, sf):
    right = events(spark, sf, "purchase").select("user_id", "ts", F.col("value").alias("price"), F.col("event_id").alias("purchase_id"))
    return joins.asof_join(events(spark, sf, "view"), right, U, "ts", ["price", "purchase_id"], order=["purchase_id"]).select("event_id", "user_id", "value", "price", "purchase_id")


@query
def bargain_index(spark, sf):
    values = events(spark, sf, "purchase").select(F.col("user_id").alias("tickersymbol"), F.col("value").alias("cvwap"), F.col("ts").alias("timestamp"))
    return apps.bargain_index(values, quotes(spark, sf)).withColumn("bargainindex", F.round(F.log("bargainindex"), 6))


# Applications


@query
def bargain_discovery(spark, sf):
    found = apps.bargain_discovery(trades(spark, sf).withColumn("volume", F.lit(100.0)), quotes(spark, sf), ["timestamp", "event_id"])
    return found.withColumn("bargainindex", F.round(F.log("bargainindex"), 6))


@query
def auth_log_alerts(spark, sf):
    error = events(spark, sf, "error")
    token = [F.lit("sshd:"), F.lit("authentication"), F.lit("failure;"), *(F.lit("x") for _ in range(9)), F.col("user_id").cast("string"), F.lit("x"), F.col("event_type")]
    logs = error.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts"), F.lit("node1").alias("host"), F.lit("sshd[1]").alias("srvc"), F.array(*token).alias("msg"), "event_id")
    return apps.login_alerts(apps.failed_logins(logs), ["ts", "event_id"], 3, 10 * 86_400)


@query
def auth_log_alerts_made(spark, sf):
    return apps.login_alerts(apps.failed_logins(made.failed_logins(spark, 3000)), ["ts", "seq"], 5, 90)


@query
def word_count(spark, sf):
    return apps.word_count(stateless.passthrough(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]), "text")


@query
def word_count2(spark, sf):
    return apps.word_count(made.sentences(spark, 2000), "sentence")


@query
def keyed_sum_x100(spark, sf):
    found = apps.keyed_sum([events(spark, sf, "purchase"), events(spark, sf, "view")], "user_id", "value", E)
    return found.withColumn("mult", F.round("mult", 3))


@query
def keyed_sum_fanout(spark, sf):
    """The same sums through four branches; a user's row says whether all agree."""
    sums = apps.keyed_sum([events(spark, sf, "purchase"), events(spark, sf, "view")], "user_id", "value", E)
    branches = [stateless.map_rows(sums, user_id=F.col("user_id"), mult=F.round("mult", 3), branch=F.lit(k)) for k in range(4)]
    return merges.interleave(*branches).groupBy("user_id").agg(F.count("*").alias("branches"), F.min("mult").alias("least"), F.max("mult").alias("most"))


def _load(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a load for multipliers."""
    key, value = F.col("user_id").cast("int"), (F.col("event_id") % 3).cast("int")
    return events(spark, sf).select(F.col("event_id").alias("seq"), key.alias("key1"), key.alias("key2"), value.alias("val1"), value.alias("val2"))


@query
def chain_single_region(spark, sf):
    return apps.chain(_load(spark, sf), (["key1"], 3), ([], 2))


@query
def chain_multi_region(spark, sf):
    return apps.chain(_load(spark, sf), (["key1", "key2"], 2), (["key1"], 3))


@query
def tree(spark, sf):
    one, two = apps.tree(_load(spark, sf), 2)
    return merges.interleave(one.withColumn("branch", F.lit(1)), two.withColumn("branch", F.lit(2)))


@query
def reverse_tree(spark, sf):
    rows = _load(spark, sf)
    return apps.reverse_tree(rows, rows.withColumn("val1", F.col("val1") + 1), 2)


@query
def varying_selectivity(spark, sf):
    return apps.varying_selectivity(_load(spark, sf), ["seq"], 2)


@query
def dynamic_rate(spark, sf):
    """The chain of a source whose rate doubles."""
    n = F.col("id")
    key, value = (n % 100).cast("int"), (n % 5).cast("int")
    rows = made.rated(spark, [(2, 200), (1, 400), (1, 200)], seq=n, key1=key, key2=key, val1=value, val2=value)
    return apps.chain(rows.drop("at"), (["key1"], 2))


@query
def prefix_key_chain(spark, sf):
    return apps.prefix_key_sums(events(spark, sf), ["user_id", "event_type"], 1, "value").withColumn("sum", F.round("sum", 4))


@query
def numbered(spark, sf):
    return ordering.numbered(events(spark, sf), ["event_type"], E).select("event_id", "event_type", "pos")


# Streams


def _stream(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    from ..streaming import as_stream

    return as_stream(spark, events(spark, sf, kind), "event_id", U)


def _streamed(df: DataFrame) -> DataFrame:
    from ..streaming import run_available

    return run_available(df)


@query
def stream_count_window(spark, sf):
    from ..streaming import stream_count_window as made_

    return _streamed(made_(_stream(spark, sf), U, E, 5, "value")).withColumn("total", F.round("total", 4))


@query
def stream_ema(spark, sf):
    from ..streaming import stream_ema as made_

    return _streamed(made_(_stream(spark, sf), U, E, "value", 0.3)).select("event_id", "user_id", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query
def stream_running(spark, sf):
    from ..streaming import stream_running as made_

    return _streamed(made_(_stream(spark, sf), U, E, "value")).select("event_id", "user_id", "n", F.round("total", 4).alias("total"))


@query
def stream_asof(spark, sf):
    from ..streaming import stream_asof as made_

    rows = _stream(spark, sf)
    ours, theirs = (rows.where(F.col("event_type") == k) for k in ("view", "purchase"))
    return _streamed(made_(ours, theirs.withColumnRenamed("value", "price"), U, "ts", "price", "value"))


@query
def stream_windowed_counts(spark, sf):
    """Every window of the table, those that the watermark has not passed too. No row is more than the table's days late."""
    from ..streaming import run_latest, windowed_counts

    rows = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    found = run_latest(windowed_counts(rows, "ts", "1 day", "31 days", ["event_type"]), ["start", "event_type"])
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
