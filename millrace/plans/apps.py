"""Whole applications, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import asof_join
from ..operators.merges import interleave
from ..operators.stateless import cvwap, duplicate, filter_rows, map_rows, mod_filter, multiply, split_words
from ..operators.windows import count_window, running, sliding_count_window
from ..sources.files import cut
from .flow import Flow


def vwap(trades: DataFrame, order: Sequence[str], size: int = 5, slide: int = 1) -> DataFrame:
    """``tickersymbol``, ``svwap``, ``svolume`` (sums of the last ``size`` trades; a missing value is 0) and ``timestamp``."""
    sums = {"svwap": F.sum(F.coalesce("myvwap", F.lit(0.0))), "svolume": F.sum(F.coalesce("volume", F.lit(0.0)))}
    return sliding_count_window(trades, ["tickersymbol"], order, size, sums, slide).select("tickersymbol", "svwap", "svolume", "timestamp")


def bargain_index(values: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes whose price (times 100) is below the latest ``cvwap`` of their ticker: ticker, time and ``bargainindex``.

    A value counts from its own time on. Quotes before the first value give nothing.
    """
    met = asof_join(quotes, values, ["tickersymbol"], "timestamp", ["cvwap"], order=["cvwap"])
    gain = F.col("cvwap") - F.col("askptickersymbolprice") * 100
    return met.where(gain > 0).withColumn("bargainindex", F.exp(gain) * F.col("asksize")).select("tickersymbol", "timestamp", "bargainindex")


def bargain_discovery(trades: DataFrame, quotes: DataFrame, order: Sequence[str], size: int = 5, slide: int = 1) -> DataFrame:
    flow = Flow()
    flow.add("trades", lambda: trades, inputs=0).add("quotes", lambda: quotes, inputs=0)
    flow.add("vwap", lambda t: vwap(t, order, size, slide)).add("cvwap", cvwap).add("bargains", bargain_index, inputs=2)
    flow.connect("trades", "vwap").connect("vwap", "cvwap").connect("cvwap", "bargains").connect("quotes", "bargains", to_port=1)
    return flow.run()["bargains"][0]


def failed_logins(logs: DataFrame) -> DataFrame:
    """Failures of sshd's authentication, parsed: ``ts``, ``uid``, ``euid``, ``tty``, ``rhost``, ``user`` and further columns."""
    token = lambda i: F.get("msg", F.lit(i))
    failed = F.col("srvc").contains("sshd") & (F.size("msg") > 2) & (token(1) == "authentication") & (token(2) == "failure;")
    rest = [c for c in logs.columns if c not in ("ts", "host", "srvc", "msg")]
    return map_rows(filter_rows(logs, failed), ts=F.col("ts"), uid=token(5), euid=token(7), tty=token(9), rhost=token(12), user=token(14), **{c: F.col(c) for c in rest})


def login_alerts(failures: DataFrame, order: Sequence[str], size: int = 5, within_s: int = 3600) -> DataFrame:
    """Hosts with ``size`` failures in a row in less than ``within_s`` seconds: ``rhost``, ``last`` (ms), ``diff`` (whole s)."""
    bounds = {"last": F.max("ts"), "first": F.min("ts")}
    found = count_window(failures, ["rhost"], order, size, bounds).where(F.col("first") + within_s * 1000 > F.col("last"))
    return found.select("rhost", "last", F.floor((F.col("last") - F.col("first")) / 1000).cast("long").alias("diff"))


def word_count(sentences: DataFrame, sentence: str) -> DataFrame:
    return split_words(sentences, sentence).groupBy("word").agg(F.count("*").alias("count"))


def keyed_sum(inputs: Sequence[DataFrame], key: str, value: str, order: Sequence[str], factor: int = 100) -> DataFrame:
    """A running sum of the united inputs by key, times ``factor``: ``key`` and the largest, ``mult``."""
    sums = running(interleave(*inputs), [key], order, {"sum": ("sum", value)})
    return map_rows(sums, **{key: F.col(key), "mult": F.col("sum") * factor}).groupBy(key).agg(F.max("mult").alias("mult"))


def chain(rows: DataFrame, *steps: tuple[Sequence[str], int]) -> DataFrame:
    """Multipliers one after another, each dealt by its keys if there are any."""
    for keys, times in steps:
        rows = multiply(rows.repartition(*keys) if keys else rows, times)
    return rows


def tree(rows: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """A multiplier by ``key1`` whose output goes to two by (``key1``, ``key2``); the data dealt by ``key1`` serves these too."""
    trunk = chain(rows, (["key1"], times))
    return multiply(trunk, times), multiply(trunk, 2 * times)


def reverse_tree(left: DataFrame, right: DataFrame, times: int) -> DataFrame:
    """Two multipliers by (``key1``, ``key2``) whose outputs meet in one by ``key1``."""
    both = interleave(*(chain(rows, (["key1", "key2"], times)) for rows in (left, right)))
    return chain(both, (["key1"], times))


def varying_selectivity(rows: DataFrame, order: Sequence[str], times: int, first: int = 4, second: int = 2) -> DataFrame:
    """Each row four times, multiplied, every 4th kept, multiplied, every 2nd kept, multiplied. What is kept first is written, as it is read twice."""
    some = cut(multiply(mod_filter(multiply(duplicate(rows, first), times), first, order), times))
    return multiply(mod_filter(some, second, order), times)


def prefix_key_sums(rows: DataFrame, keys: Sequence[str], prefix: int, value: str) -> DataFrame:
    """Sums by all ``keys`` of rows dealt by the first ``prefix`` of them, which serves the grouping as well."""
    return rows.repartition(*keys[:prefix]).groupBy(*keys).agg(F.sum(value).alias("sum"))
