"""Inputs from files, and where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered

_own: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the lines of text files."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def sentences_of(words: DataFrame, low: int, high: int, per_length: int, word: str = "word") -> DataFrame:
    """``sentence`` and ``partition_index``: for each length from ``low`` to ``high`` words ``per_length`` sentences of the words in turn, from the first one again after the last.

    Words are taken in the order of a hash, equal ones and empty ones once; the longer sentences go on where the shorter ones ended.
    """
    listed = numbered(words.where(F.length(word) > 0).select(F.col(word).alias("word")).distinct().withColumn("hash", F.xxhash64("word")), [], ["hash", "word"], "at")
    lengths = list(range(low, high + 1))
    before = [per_length * sum(lengths[:k]) for k in range(len(lengths))]
    rows = words.sparkSession.range(per_length * len(lengths)).withColumn("k", F.floor(F.col("id") / per_length).cast("int"))
    length = F.col("k") + low
    first = F.get(F.lit(before), F.col("k")) + (F.col("id") - F.col("k") * per_length) * length
    each = rows.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), length - 1), lambda j: first + j)).alias("j", "number"))
    total = listed.agg(F.count("*").alias("total"))  # one row
    met = each.join(F.broadcast(total), F.lit(True)).where("total > 0").withColumn("at", F.col("number") % F.col("total") + 1).join(listed.select("at", "word"), "at")
    made = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "word"))), lambda x: x["word"]), " ").alias("sentence"))
    return made.select("sentence", (F.col("id") % 16).cast("int").alias("partition_index"))


def log_lines(spark: SparkSession, path: str, month: str = "Aug") -> DataFrame:
    """``host``, ``srvc``, ``msg`` of the lines of syslog files that begin with ``month`` and aren't failed logins at sshd.

    The three words of the time are left out; the rest of the words after host and service is the message.
    """
    lines = spark.read.text(path).where(F.col("value").startswith(month))
    lines = lines.where(~(F.col("value").contains("sshd") & F.col("value").contains("authentication failure")))
    part = F.split(F.regexp_replace("value", r"^\s+", ""), r"\s+")
    return lines.select(part.alias("p")).select(F.get("p", F.lit(3)).alias("host"), F.get("p", F.lit(4)).alias("srvc"), F.slice("p", F.lit(6), F.greatest(F.size("p") - 5, F.lit(0))).alias("msg"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a folder of this machine only where none is named and all executors are on it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return _own[0]


def fresh_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/millrace-{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again. The files survive the loss of any executor; they go with ``release`` or when the driver's JVM ends."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._cut_path = path
    return again


def release(df: DataFrame) -> None:
    """Delete the files behind what ``cut`` returned, when nothing will read them again."""
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.__dict__.pop("_cut_path"))
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
