"""Substring deduplication by hashing units of text.

Units are paragraphs, lines, or lines cut further at the ends of sentences. Their words, lower-cased, without
punctuation and spacing, give a digest; of equal digests anywhere in the corpus
the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .words import mix, longs, pieces, split_bytes, texts

#: Digests with more units than this are met by broadcast (one of them for as many units of the corpus at most), so that no task has all units of one.
HOT = 20_000


def unit_ends(buf: np.ndarray, unit: str) -> np.ndarray:
    """True for bytes that end a unit; ends of documents apart."""
    newline = buf == 0x0A
    after = np.zeros(len(buf), np.uint8)
    after[:-1] = buf[1:]
    if unit == "paragraph":
        return newline & (after != 0x0A) & np.concatenate([[False], newline[:-1]])
    if unit == "line":
        return newline
    if unit == "sentence":
        return newline | (np.isin(buf, [0x21, 0x2E, 0x3F]) & np.isin(after, [0x20, 0x09, 0x0D]))
    raise ValueError(f"unknown unit {unit!r}")


def find_units(column: pa.Array, unit: str, least: int) -> dict[str, np.ndarray]:
    """Of each unit of at least ``least`` words: document, number, span in code points, words, digest in two parts, and whether it repeats an earlier one of the document."""
    buf, offsets = texts(column)
    words = split_bytes(buf, offsets, "alnum")
    cut = unit_ends(buf, unit)
    inner = offsets[1:-1] - 1
    cut[inner[inner >= 0]] = True
    upto = np.concatenate([[0], np.cumsum(cut)])
    of = upto[words.start]  # the unit of each word, over all documents
    if not len(of):
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("doc", "no", "start", "end", "n", "d1", "d2"), none) | {"again": np.zeros(0, bool)}
    at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (words.doc[1:] != words.doc[:-1])]))
    n = np.diff(np.append(at, len(of)))
    place = (np.arange(len(of)) - np.repeat(at, n)).astype(np.uint64)
    digest = [np.add.reduceat(mix(words.hash ^ mix(place + np.uint64(seed))), at) + n.astype(np.uint64) for seed in (1, 1 << 40)]
    unit_of, doc = of[at], words.doc[at]
    ends = np.append(np.flatnonzero(cut) + 1, len(buf))
    first = np.maximum(np.concatenate([[0], ends])[unit_of], offsets[doc])
    last = np.minimum(ends[unit_of], offsets[doc + 1])
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    base = points[offsets[doc]]
    long_ = n >= least
    code = digest[0][long_]
    order = np.lexsort((np.arange(len(code)), code, doc[long_]))
    again = np.zeros(len(code), bool)
    same = (code[order][1:] == code[order][:-1]) & (doc[long_][order][1:] == doc[long_][order][:-1])
    again[order[1:][same]] = True
    no = unit_of - upto[offsets[:-1]][doc]
    out = {"doc": doc, "no": no, "start": points[first] - base, "end": points[last] - base, "n": n, "d1": digest[0], "d2": digest[1] >> np.uint64(33)}
    return {k: v[long_] for k, v in out.items()} | {"again": again}


def units(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "sentence", least: int = 1) -> DataFrame:
    """Rows ``id``, ``no``, ``start``, ``end``, ``n_words``, ``d1``, ``d2``, ``again`` of all units of at least ``least`` words."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            u = find_units(batch.column(1), unit, least)
            columns = {"id": batch.column(0).take(pa.array(u["doc"]))}
            columns |= {k: pa.array(u[f].astype(np.int32)) for k, f in (("no", "no"), ("start", "start"), ("end", "end"), ("n_words", "n"))}
            yield pa.RecordBatch.from_pydict(columns | {"d1": pa.array(longs(u["d1"].astype(np.uint64))), "d2": pa.array(u["d2"].astype(np.int32)), "again": pa.array(u["again"])})

    return rows.mapInArrow(run, f"id {kind}, no int, start int, end int, n_words int, d1 bigint, d2 int, again boolean")


def repeated_units(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "sentence", least: int = 1) -> DataFrame:
    """The units to remove: ``id``, ``unit_no`` (from 0, by the text's own units), ``start`` and ``end`` (code points in the
    original text), ``n_words``, ``kept_in`` (the smallest id with that unit, whose first one stays).

    Units end with white space behind ``.``, ``!`` or ``?`` and with lines (``sentence``), with lines, or with blank
    lines (``paragraph``). Those of fewer than ``least`` words always stay. Null and empty texts have none; rows with a
    null id are left out; rows that repeat an id count as the same text, and stay or go together.
    """
    found = cut(units(docs, id, text, unit, least))  # texts are read once
    firsts = found.groupBy("d1", "d2").agg(F.min("id").alias("kept_in"), F.max("id").alias("last"), F.max("again").alias("within"), F.count("*").alias("n"))
    firsts = firsts.where((F.col("kept_in") != F.col("last")) | F.col("within"))
    hot = firsts.where(F.col("n") > HOT).select("d1", "d2", F.col("kept_in").alias("hot"))
    rest = firsts.where(F.col("n") <= HOT).select(F.col("d1").alias("key"), "d2", "kept_in")
    met = found.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("d1")).otherwise(F.xxhash64("id", "no")))
    gone = met.join(rest, ["key", "d2"], "left").withColumn("kept_in", F.coalesce("hot", "kept_in")).where((F.col("id") != F.col("kept_in")) | (F.col("again") & F.col("kept_in").isNotNull()))
    return gone.select(F.col("id").alias(id), F.col("no").cast("long").alias("unit_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_words").cast("long").alias("n_words"), "kept_in")


def without_repeats(docs: DataFrame, gone: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less the spans of ``gone`` (id, start, end); all rows stay, if with an empty text."""
    spans = gone.groupBy(id).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"]))
    stops = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("b"), stops.alias("e")), lambda x: F.substring(F.col(text), (x["b"] + 1).cast("int"), F.greatest(x["e"] - x["b"], F.lit(0)).cast("int"))), "")
    return docs.join(spans, id, "left").withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
