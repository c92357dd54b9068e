"""Words of Arrow text batches as flat numpy arrays, without a Python step per word.

A batch's texts lie in one UTF-8 buffer. Words are found by byte class (every
separator used here is ASCII, so multi-byte characters never split), and each
word gets a 64-bit hash from a polynomial prefix sum over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text is handled alone and whole.
PIECE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def byte_class(kind: str) -> np.ndarray:
    """True for bytes that belong to words.

    ``space``: all but ASCII blank and 0x09-0x0D. ``alnum``: ASCII letters and digits and all non-ASCII.
    """
    table = np.ones(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":
        table[:0x80] = False
        for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(first) : ord(last) + 1] = True
    else:
        raise ValueError(f"unknown word class {kind!r}")
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    if len(_powers.get(name, ())) < n:
        grown = np.full(max(n, min(1 << n.bit_length(), PIECE_BYTES * 2)), base, np.uint64)
        grown[0] = 1
        kept = np.multiply.accumulate(grown)
        if n > PIECE_BYTES * 2:
            return kept  # of one very long text; not held on to
        _powers[name] = kept
    return _powers[name][:n]


@dataclass
class Words:
    """``doc``, ``start``, ``end`` and ``hash`` of each word; ``first`` has each document's first word, plus the end."""

    n_docs: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, from 0; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def split(column: pa.Array, kind: str = "space", lower: bool = True) -> Words:
    """The words of each text of a string column."""
    buf, offsets = texts(column)
    return split_bytes(buf, offsets, kind, lower)


def split_bytes(buf: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = True) -> Words:
    """The words of each of the spans that ``offsets`` cuts ``buf`` into."""
    n_docs = len(offsets) - 1
    inside = byte_class(kind)[buf]
    first = np.zeros(len(buf) + 1, bool)  # where a document begins
    first[offsets] = True
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    code = (_LOWER[buf] if lower else buf).astype(np.uint64)
    code += np.uint64(1)
    code *= _power("up", _BASE, len(buf))
    np.cumsum(code, out=code)
    upto = np.concatenate([np.zeros(1, np.uint64), code])
    word = mix((upto[end] - upto[start]) * _power("down", _INVERSE, len(buf))[start]) if len(start) else np.zeros(0, np.uint64)
    of = np.searchsorted(start, offsets)
    return Words(n_docs, np.repeat(np.arange(n_docs), np.diff(of)), start, end, word, of)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``n`` words inside a document."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[: len(words) - n + 1] == words.doc[n - 1 :])
    return at, gram_hash(words.hash, at, n)


def gram_hash(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position ``at``."""
    total = np.full(len(at), n, np.uint64)
    for j in range(n):
        total = mix(total * np.uint64(0xA24BAED4963EE407) + word[at + j])
    return total


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def longs(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
