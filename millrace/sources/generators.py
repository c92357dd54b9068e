"""Made-up inputs: the same rows on every call, a partition at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Constants of the linear congruence that scatters row numbers.
_STEP, _ADD, _MOD = 48_271, 12_345, 2_147_483_647


def scattered(n: Column, most: int, turn: int = 0) -> Column:
    """A number from 0 to ``most - 1`` that follows from ``n`` without a visible pattern."""
    return F.pmod((n + turn) % F.lit(_MOD) * F.lit(_STEP) + F.lit(_ADD), F.lit(_MOD)) % F.lit(most)


def beacon(spark: SparkSession, rows: int, partitions: int | None = None, **outputs: Column) -> DataFrame:
    """``rows`` rows of the named expressions over ``id`` (0, 1, ...)."""
    return spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism).select(*(c.alias(n) for n, c in outputs.items()))


def beacon_stream(spark: SparkSession, rows_per_second: int, ramp_up: str = "0s", **outputs: Column) -> DataFrame:
    """An endless stream of the named expressions over ``value`` (0, 1, ...), ``rows_per_second`` of them once ``ramp_up`` is over."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("rampUpTime", ramp_up).load()
    return rate.select(*(c.alias(n) for n, c in outputs.items()))


def keyed_values(spark: SparkSession, key_range: int, value_range: int, per_key: int) -> DataFrame:
    """``seq``, ``key1`` = ``key2``, ``val1`` = ``val2``: ``per_key`` rows of every key, round robin; values count up within ``value_range``."""
    n = F.col("id")
    key, value = (n % key_range).cast("int"), (n % value_range).cast("int")
    return beacon(spark, key_range * per_key, seq=n, key1=key, key2=key, val1=value, val2=value)


def keyed_stream(spark: SparkSession, key_range: int, value_range: int, rows_per_second: int, ramp_up: str = "0s") -> DataFrame:
    """As ``keyed_values``, endless and at a rate."""
    n = F.col("value")
    key, value = (n % key_range).cast("int"), (n % value_range).cast("int")
    return beacon_stream(spark, rows_per_second, ramp_up, seq=n, key1=key, key2=key, val1=value, val2=value)


def rated(spark: SparkSession, phases: Sequence[tuple[float, int]], partitions: int | None = None, **outputs: Column) -> DataFrame:
    """Rows of a source whose rate changes: the named expressions over ``id`` (0, 1, ...) and ``at``, the millisecond from the start in which a row comes.

    ``phases`` has the seconds that each rate lasts and the rows a second; a rate of 0 is a pause.
    """
    begins, ends, rows, start = [], [], 0, 0.0
    for seconds, rate in phases:
        begins.append((start, rows, rate))
        start, rows = start + seconds, rows + round(seconds * rate)
        ends.append(rows)
    at = F.lit(None).cast("long")
    for (began, before, rate), end in reversed(list(zip(begins, ends, strict=True))):
        if rate:
            at = F.when(F.col("id") < end, F.floor(began * 1000 + (F.col("id") - before) * 1000 / rate)).otherwise(at)
    return spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism).select(at.cast("long").alias("at"), *(c.alias(n) for n, c in outputs.items()))


def run_rated(spark: SparkSession, phases: Sequence[tuple[float, int]], start: Callable[[DataFrame], StreamingQuery], **outputs: Column) -> None:
    """Run a stream whose rate changes: for each phase ``start`` begins a query on a source of that rate, which is stopped when the phase is over.

    ``value`` counts from 0 in each phase.
    """
    for seconds, rate in phases:
        if not rate:
            time.sleep(seconds)
            continue
        query = start(beacon_stream(spark, rate, **outputs))
        query.awaitTermination(seconds)
        query.stop()


def ticker(n: Column, tickers: int) -> Column:
    """One of ``tickers`` names of three capital letters, by scattered number."""
    k = scattered(n, tickers)
    letter = lambda x: F.chr((x % 26 + 65).cast("long"))
    return F.concat(letter(F.floor(k / 676)), letter(F.floor(k / 26)), letter(k))


def trades(spark: SparkSession, rows: int, tickers: int = 100, low: int = 10, high: int = 200, per_tick: int = 10) -> DataFrame:
    """``tickersymbol``, ``myvwap`` (a whole price), ``volume`` 1, ``timestamp`` (rises after ``per_tick`` rows), ``seq``."""
    n = F.col("id")
    price = (scattered(n, high - low, 77) + low).cast("double")
    return beacon(spark, rows, tickersymbol=ticker(n, tickers), myvwap=price, volume=F.lit(1.0), timestamp=F.floor(n / per_tick).cast("long"), seq=n)


def quotes(spark: SparkSession, rows: int, tickers: int = 100, low: int = 10, high: int = 200, per_tick: int = 10) -> DataFrame:
    """``tickersymbol``, ``askptickersymbolprice``, ``asksize`` 1, ``timestamp``, ``seq``; see ``trades``."""
    n = F.col("id")
    price = (scattered(n, high - low, 991) + low).cast("double")
    return beacon(spark, rows, tickersymbol=ticker(n, tickers), askptickersymbolprice=price, asksize=F.lit(1), timestamp=F.floor(n / per_tick).cast("long"), seq=n)


def sentences(spark: SparkSession, rows: int, words: int = 8, vocabulary: int = 500, partitions: int = 16) -> DataFrame:
    """``sentence`` (``words`` made-up words with single blanks between) and ``partition_index`` (0, 1, ..., in turn)."""
    word = lambda j: F.concat(F.lit("w"), scattered(F.col("id") * words + j, vocabulary).cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word), " ")
    return beacon(spark, rows, sentence=text, partition_index=(F.col("id") % partitions).cast("int"))


def failed_logins(spark: SparkSession, rows: int, users: int = 20, hosts: int = 50, per_second: int = 3) -> DataFrame:
    """Log lines of failed logins: ``ts`` (ms), ``host``, ``srvc``, ``msg`` of 15 tokens, ``seq``."""
    n = F.col("id")
    number = lambda most, turn: scattered(n, most, turn).cast("string")
    tokens = [F.lit("pam_unix(sshd:auth):"), F.lit("authentication"), F.lit("failure;"), F.lit("logname="), F.lit("x"), F.concat(F.lit("uid="), number(5, 1)), F.lit("x"), F.concat(F.lit("euid="), number(5, 2)), F.lit("x"), F.lit("tty=ssh"), F.lit("x"), F.lit("ruser="), F.concat(F.lit("rhost=host"), number(hosts, 3)), F.lit("x"), F.concat(F.lit("user=user"), number(users, 4))]
    return beacon(spark, rows, ts=(F.floor(n / per_second) * 1000).cast("long"), host=F.lit("node1"), srvc=F.lit("sshd[1]"), msg=F.array(*tokens), seq=n)
