"""Stupid-backoff language-model scores of documents, from n-gram counts of a corpus.

Documents are dealt to chunks of bounded text. Each chunk sends its different
n-grams with their counts to the count tables, which are partitioned by n-gram
hash; every table adds up what it gets and answers each chunk with the corpus'
counts of just the n-grams that it sent. A chunk joins the answers to the
n-grams of its documents, word by word, and sums the scores per document.

So this is a join of count tables with exploded n-grams, of which a chunk names each only once. The rows that one
chunk and one table have for each other travel as one, in sorted lists: n-grams one by one would fill several times
the disk. There are as many tables as the text has ``CHUNK_BYTES``, so that any of them fits into a task; a row holds
at least one n-gram, so rows are never more than n-grams one by one would be. N-grams are told apart by their hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import gram_hash, mix, pieces, split

#: Bytes of text behind a chunk of documents and behind a count table.
CHUNK_BYTES = 8 << 20
#: Bits of a hash beyond those that tell the corpus' bytes apart, up to 64 in all: one n-gram in some 2 ** SPARE_BITS
#: shares its hash, however large the corpus is.
SPARE_BITS = 26

_ZSTD = pa.Codec("zstd", 3)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first: the upper ones are mostly 0 and compress to little."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def pack(x: np.ndarray) -> bytes:
    """Ascending uint64: the first, then differences of as few bytes as make the whole shortest; the upper bits of longer ones follow."""
    step = np.diff(x)
    bits = np.sort(np.ceil(np.log2(step.astype(float) + 1)))
    longer = [len(step) - int(np.searchsorted(bits, 8 * w, "right")) for w in range(1, 9)]
    width = 1 + int(np.argmin([len(step) * (w + (n > 0) / 8) + (9 - w) * n / 2 for w, n in zip(range(1, 9), longer, strict=True)]))
    above = step >> np.uint64(8 * width) if width < 8 else np.zeros(len(step), np.uint64)
    long_ = above > 0
    extra = _ZSTD.compress(np.packbits(long_).tobytes() + _planes(above[long_]), asbytes=True) if long_.any() else b""
    head = np.array([width, len(step), int(long_.sum()), len(extra)], np.uint32).tobytes() + x[:1].tobytes()
    return head + extra + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(b: bytes) -> np.ndarray:
    width, n, more, extra = (int(k) for k in np.frombuffer(b, np.uint32, 4))
    whole = np.zeros((n + 1, 8), np.uint8)
    whole[1:, :width] = np.frombuffer(b, np.uint8, n * width, 24 + extra).reshape(n, width)
    out = whole.view(np.uint64).ravel()
    if more:
        mask = -(-n // 8)
        rest = np.frombuffer(_ZSTD.decompress(b[24 : 24 + extra], mask + 8 * more, asbytes=True), np.uint8)
        upper = np.ascontiguousarray(rest[mask:].reshape(8, more).T).view(np.uint64).ravel()
        out[1 + np.flatnonzero(np.unpackbits(rest[:mask])[:n])] += upper << np.uint64(8 * width)
    out[0] = np.frombuffer(b, np.uint64, 1, 16)[0]
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts in the least integer type that holds them, after its width and their number."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return np.array([kind.itemsize, len(x)], np.uint32).tobytes() + _ZSTD.compress(_planes(x.astype(kind)), asbytes=True)


def unpack_counts(b: bytes) -> np.ndarray:
    width, n = (int(k) for k in np.frombuffer(b, np.uint32, 2))
    planes = np.frombuffer(_ZSTD.decompress(b[8:], width * n, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


class _Grams:
    """The words of a chunk's documents, and for each order the hash of the n-gram that ends at each word."""

    def __init__(self, texts: pa.ChunkedArray, order: int, bits: int) -> None:
        hashes, counts = [], []
        for batch in pieces(pa.table({"text": texts}).to_batches(), "text"):
            words = split(batch.column(0), "alnum")
            hashes.append(words.hash)
            counts.append(words.counts())
        word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(word)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        down = np.uint64(64 - bits)
        #: Of order n, whether it fits behind each word, and its hash there. The empty n-gram is 0.
        self.by_order = [(np.flatnonzero(self.place >= n - 1), n) for n in range(1, order + 1)]
        self.hash = [mix(gram_hash(word, at - (n - 1), n)) >> down for at, n in self.by_order]

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.sort(np.concatenate([*self.hash, np.zeros(0, np.uint64)]))
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        key, count = every[at], np.diff(np.append(at, len(every)))
        if len(key) and key[0] == 0:
            key, count = key[1:], count[1:]
        return np.concatenate([np.zeros(1, np.uint64), key]), np.concatenate([[len(self.doc)], count])


def backoff_scores(docs: DataFrame, text: str = "text", keep: list[str] | None = None, order: int = 3, factor: float = 0.4, min_count: int = 2, prefix: str = "lm_") -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and, with ``prefix``: ``words``, ``score``, ``backed_off``.

    A word's score is ``c(n-gram) / c(its first n-1 words)`` for the longest n-gram that ends with it, has at most
    ``order`` words and occurs ``min_count`` times in all documents together, times ``factor`` for each word less than
    there could be; a single word's is its share of all words. ``score`` is the sum of natural logarithms, null for a
    document without words; ``backed_off`` is how many words' scores have a factor.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; n-grams don't cross documents. Null
    texts have no words. Repeated rows count and are scored each. Other columns pass unchanged, but must not have the
    names of the new ones.
    """
    keep = list(docs.columns if keep is None else keep)
    names = [f"{prefix}{n}" for n in ("words", "score", "backed_off")]
    if clash := set(names) & set(keep):
        raise ValueError(f"docs has columns {sorted(clash)} already; choose another prefix")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 1
    parts = math.ceil(size / CHUNK_BYTES)
    bits = min(64, max(32, size.bit_length() + SPARE_BITS))
    wanted = list(dict.fromkeys([*keep, text]))
    rows = docs.select(*wanted, F.pmod(F.xxhash64(*keep, text), F.lit(parts)).cast("int").alias("_chunk"))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        gram, count = _Grams(table.column(text), order, bits).unique()
        part = ((gram >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        to = np.append(at[1:], len(part))
        return pa.table(
            {
                "part": pa.array(part[at], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(at), pa.int32()),
                "grams": pa.array([pack(gram[i:j]) for i, j in zip(at, to, strict=True)], pa.binary()),
                "counts": pa.array([pack_counts(count[i:j]) for i, j in zip(at, to, strict=True)], pa.binary()),
            }
        )

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        gram = [unpack(b) for b in table.column("grams").to_pylist()]
        count = [unpack_counts(b) for b in table.column("counts").to_pylist()]
        every = np.concatenate(gram)
        order_ = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(every[order_]) != 0]))
        total = np.add.reduceat(np.concatenate(count)[order_], at)
        back = np.empty(len(every), np.int64)
        back[order_] = np.repeat(total, np.diff(np.append(at, len(every))))
        edge = np.cumsum([0, *map(len, gram)])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([pack_counts(back[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = _Grams(left.column(text), order, bits)
        key, _ = grams.unique()
        answers = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist(), strict=True))
        total = np.concatenate([unpack_counts(b) for _, b in answers])
        log = np.log(np.maximum(total, 1))
        n_words = len(grams.doc)
        score, backed = np.zeros(n_words), np.zeros(n_words, bool)
        before = np.full(n_words, log[0])  # of the context: for single words, of all words
        for (at, n), hash_ in zip(grams.by_order, grams.hash, strict=True):
            which = np.searchsorted(key, hash_)
            some = (total[which] >= min_count) if n > 1 else np.ones(len(at), bool)
            score[at] += np.where(some, 0.0, math.log(factor))  # a step back from here
            score[at[some]] = log[which[some]] - before[at[some]]
            backed[at] = ~some
            before = np.zeros(n_words)
            after = at[at + 1 < n_words] + 1
            before[after] = log[which[: len(after)]]
        summed = np.bincount(grams.doc, score, len(grams.counts))
        back = np.bincount(grams.doc, backed, len(grams.counts)).astype(np.int64)
        columns = {c: left.column(c) for c in keep}
        columns[names[0]] = pa.array(grams.counts, pa.int64())
        columns[names[1]] = pa.array(np.where(grams.counts > 0, summed, np.nan), from_pandas=True)
        return pa.table(columns | {names[2]: pa.array(back)})

    sent = rows.groupBy("_chunk").applyInArrow(send, "part int, chunk int, grams binary, counts binary")
    answered = sent.groupBy("part").applyInArrow(add_up, "chunk int, part int, totals binary")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.LongType())])
    return rows.groupBy("_chunk").cogroup(answered.groupBy("chunk")).applyInArrow(join, schema)
