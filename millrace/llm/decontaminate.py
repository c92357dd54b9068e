"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of ``width`` consecutive words of the benchmark
items; an item of fewer words is one window of its own length. For each length
there is a table that says, for the pair of words under a cursor, how many
words the cursor may skip; where it may skip none, the pair is the end of some
window, and a bucket keyed by the suffix selects the windows to compare word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut
from .words import Words, gram_hash, mix, pieces, split

#: Benchmark words that one pass carries to the executors (about 150 bytes each); a larger benchmark takes several passes.
PASS_WORDS = 400_000
#: A cursor's share of a text, in words.
_STRETCH = 384
#: Words of an item that go to a pass together, at most.
_ITEM_WORDS = 20_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    ]
)


@dataclass
class Patterns:
    """All windows of one length, with their shift table."""

    length: int
    words: np.ndarray  # one row of word hashes for each different window
    whole: np.ndarray  # their hashes, ascending
    items: list[list[str]]  # the items each one comes from
    block: int
    bits: int
    shift: np.ndarray

    @classmethod
    def build(cls, length: int, windows: np.ndarray, item: list[str]) -> Patterns:
        whole = gram_hash(windows.reshape(-1), np.arange(len(windows)) * length, length)
        order = np.argsort(whole, kind="stable")
        windows, whole = windows[order], whole[order]
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        names, code = np.unique(np.array(item, object).astype(str), return_inverse=True)
        pairs = np.unique(np.stack([np.cumsum(new) - 1, code[order]], 1), axis=0)  # window and item, by name within a window
        items = [names[own].tolist() for own in np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1)]
        windows, whole = windows[new], whole[new]
        block = min(2, length)
        bits = max(12, int(np.ceil(np.log2(8 * windows.size + 1))))
        shift = np.full(1 << bits, length - block + 1, np.int8)
        for end in range(block - 1, length):  # later blocks allow smaller shifts
            code = cls.code([windows[:, end - j] for j in range(block)], bits)
            shift[code] = np.minimum(shift[code], length - 1 - end)
        return cls(length, windows, whole, items, block, bits, shift)

    @staticmethod
    def code(word: list[np.ndarray], bits: int) -> np.ndarray:
        x = word[0]
        for w in word[1:]:
            x = x * np.uint64(0xA24BAED4963EE407) + w
        return (mix(x) >> np.uint64(64 - bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Last word and window number of each occurrence."""
        counts = words.counts()
        ends = np.maximum(counts - (self.length - 1), 0)  # positions where a window may end
        n = -(-ends // _STRETCH)
        of = np.repeat(np.arange(words.n_docs), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = words.first[:-1][of] + self.length - 1 + k * _STRETCH
        stop = np.minimum(at + _STRETCH, words.first[1:][of])
        found = []
        while len(at):
            move = self.shift[self.code([words.hash[at - j] for j in range(self.block)], self.bits)]
            if len(hit := at[move == 0]):
                found.append(hit)
            at = at + np.maximum(move, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.concatenate(found)
        first = last - self.length + 1
        code = gram_hash(words.hash, first, self.length)
        which = np.minimum(np.searchsorted(self.whole, code), len(self.whole) - 1)
        near = self.whole[which] == code
        last, first, which = last[near], first[near], which[near]
        same = (words.hash[first[:, None] + np.arange(self.length)] == self.words[which]).all(axis=1)
        return last[same], which[same]


def patterns(items: list[tuple[str, str | None]], width: int) -> list[Patterns]:
    """Windows of (item_id, text) pairs by length."""
    words = split(pa.array([t for _, t in items], pa.string()), "alnum")
    windows: dict[int, list[np.ndarray]] = {}
    source: dict[int, list[str]] = {}
    for k, (item, _) in enumerate(items):
        own = words.hash[words.first[k] : words.first[k + 1]]
        length = min(width, len(own))
        if length:
            rows = np.lib.stride_tricks.sliding_window_view(own, length)
            windows.setdefault(length, []).append(rows)
            source.setdefault(length, []).extend([item] * len(rows))
    return [Patterns.build(n, np.ascontiguousarray(np.concatenate(w)), source[n]) for n, w in sorted(windows.items())]


def search_batch(batch: pa.RecordBatch, text: str, tables: list[Patterns], schema: pa.Schema, found: str | None) -> pa.RecordBatch:
    """The rows of ``batch`` with the result of one pass, joined to that of the passes before it."""
    words = split(batch.column(batch.schema.get_field_index(text)), "alnum")
    mark = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for table in tables:
        last, which = table.search(words)
        np.add.at(mark, last - table.length + 1, 1)
        np.add.at(mark, last + 1, -1)
        for pair in np.unique(np.stack([words.doc[last], which], 1), axis=0):
            items.setdefault(int(pair[0]), set()).update(table.items[pair[1]])
    hit = np.cumsum(mark)[:-1] > 0
    if found:
        for k, before in enumerate(batch.column(batch.schema.get_field_index(found)).to_pylist()):
            if before["items"]:
                items.setdefault(k, set()).update(before["items"])
                for x in before["hits"]:
                    hit[words.first[k] + x["first"] : words.first[k] + x["last"] + 1] = True
    n_hit = np.bincount(words.doc[hit], minlength=words.n_docs)
    result = []
    for k in range(words.n_docs):
        spans = []
        if n_hit[k]:
            own = np.concatenate([[0], hit[words.first[k] : words.first[k + 1]].astype(np.int8), [0]])
            edge = np.diff(own)
            spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        result.append({"n_words": int(words.first[k + 1] - words.first[k]), "n_hit": int(n_hit[k]), "items": sorted(items.get(k, ())), "hits": spans})
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != found}
    name = next(n for n in schema.names if n not in columns)
    columns[name] = pa.array(result, type=schema.field(name).type)
    return pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, keep: list[str] | None = None, out: str = "search", pass_words: int = PASS_WORDS) -> DataFrame:
    """Find benchmark windows in every document.

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. The result has the columns
    ``keep`` of ``docs`` (all by default) and a struct ``out``: ``n_words``, ``n_hit`` (words inside any occurrence),
    ``items`` (those that occur, sorted as strings) and ``hits`` (runs of hit words, counted from 0, joined where they touch).

    A null or empty text has no words and no hits; a null or empty item occurs nowhere, an item with a null id is left
    out; repeated rows are kept, each with its own result, and repeated items count once. An empty benchmark hits
    nothing. Other columns pass unchanged, whatever their names (but not ``out``, which must be free).

    The benchmark is read in passes of about ``pass_words`` words, each pass held by the executors at once; more than
    one pass writes the documents' intermediate results to the shared folder in between. A long item is cut into
    stretches that overlap by a window less a word, so that all of its windows are there and any pass is small.
    """
    keep = list(docs.columns if keep is None else keep)
    if out in keep:
        raise ValueError(f"docs has a column {out!r} already")
    spark = docs.sparkSession
    step = min(_ITEM_WORDS, max(width, pass_words // 4))
    words = F.regexp_extract_all(item_text, F.lit(_WORD), F.lit(0))
    items = benchmark.select(F.col(item).cast("string").alias("i"), words.alias("w")).where("i is not null and size(w) > 0")
    items = items.select("i", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)), F.lit(step))).alias("at"))
    items = items.select("i", F.array_join(F.slice("w", F.col("at") + 1, F.lit(step + width - 1)), " ").alias("t"), F.least(F.size("w") - F.col("at"), F.lit(step + width - 1)).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    passes = max(1, int(np.ceil(total / pass_words)))
    frame, wanted = docs.select(*dict.fromkeys([*keep, text])), list(dict.fromkeys([*keep, text]))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        tables = spark.sparkContext.broadcast(patterns([(r.i, r.t) for r in part.collect()], width))
        last = k == passes - 1
        columns = keep if last else wanted
        frame = _search(frame, text, tables, columns, out, out if k else None)
        if not last:
            frame = cut(frame)
    return frame


def _search(frame: DataFrame, text: str, tables, columns: list[str], out: str, found: str | None) -> DataFrame:
    schema = T.StructType([*(frame.schema[c] for c in columns), T.StructField(out, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in pieces(batches, text):
            yield search_batch(batch, text, tables.value, arrow, found)

    return frame.mapInArrow(run, schema)


def is_contaminated(search: str = "search", share: int = 20):
    """At least one word in ``share`` is hit."""
    s = F.col(search)
    return (s["n_hit"] > 0) & (share * s["n_hit"] >= s["n_words"])
