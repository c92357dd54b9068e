"""Toxic passages as maximum-scoring segments of token log-odds.

Every word has a score: how much likelier it is in documents labelled toxic,
with Dirichlet priors that hand the estimate of a word's beginning down to the
word. A linear scan finds all maximal segments of each document's scores.
Scores of chance segments follow an extreme-value law whose parameters come
from clean documents; what a document's segments have beyond chance is its
statistic, and a logistic curve turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, _INVERSE, _power, longs, mix, pieces, split_bytes, texts

#: Labelled documents that word scores are learned from, and that segment statistics are calibrated on, at most.
FIT_DOCS, CALIBRATE_DOCS = 24_000, 8_000
#: A word or beginning counts if so many labelled documents hold it.
MIN_DOCS = 3
#: Words and beginnings that the model has at most: 36 bytes of each go to the driver and 16 to every executor.
MODEL_TERMS = 1_000_000
#: Bytes of the beginnings that pass their estimate on.
STEMS = (4, 6, 8)
#: Weight of a prior in documents; standard errors taken off a positive score; what each word costs a segment.
PRIOR, CAUTION, DRIFT = 3.0, 1.0, 0.1


def features(column: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """Words of each text, and for each the hash of its beginnings and, last, of itself."""
    buf, offsets = texts(column)
    words = split_bytes(buf, offsets, "alnum")
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    code = low.astype(np.uint64)
    code += np.uint64(1)
    code *= _power("up", np.uint64(0x9E3779B97F4A7C15), len(buf))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code, dtype=np.uint64)])
    down = _power("down", _INVERSE, len(buf))
    found = []
    for k in STEMS:
        end = np.minimum(words.start + k, words.end)
        found.append(mix((upto[end] - upto[words.start]) * down[words.start]) ^ np.uint64(k) if len(words) else words.hash)
    return words, [*found, words.hash]


def segments(score: np.ndarray, cost: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of ``score - cost``, by a linear scan.

    Words without a positive score only lower the running total, so the scan steps over the others alone.
    """
    at = np.flatnonzero(score > cost)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(score - cost)])
    kept: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, nearest earlier one with less before it
    for first, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        last, j = first, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= before:
                j = kept[j][4]  # those between have no less before them, and are passed over for good
            if j < 0 or kept[j][1] >= after:
                kept.append((before, after, first, last, j))
                break
            before, _, first, _, above = kept[j]  # joined with the segments from j on
            del kept[j:]
            j = above
    return [(after - before, first, last) for before, after, first, last, _ in kept]


@dataclass
class Found:
    """All segments of a batch's documents, one after the other; ``to`` has where each document's end, after a 0."""

    score: np.ndarray
    first: np.ndarray
    last: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, words: Words, scores: np.ndarray) -> Found:
        each = [segments(scores[a:b], DRIFT) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        flat = np.array([x for own in each for x in own], float).reshape(-1, 3)
        return cls(flat[:, 0], flat[:, 1].astype(np.int32), flat[:, 2].astype(np.int32), np.cumsum([0, *map(len, each)]))

    def per_doc(self, values: np.ndarray, join: np.ufunc, none: float) -> np.ndarray:
        """``values`` of the segments joined by document, ``none`` for one without segments."""
        some = np.diff(self.to) > 0
        out = np.full(len(some), none)
        if some.any():
            out[some] = join.reduceat(values, self.to[:-1][some])
        return out


@dataclass
class Model:
    """``keys`` (ascending hashes of all levels) and ``scores``, the extreme-value law, and the curve."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    ln_k: float = 0.0
    slope: float = 0.0
    offset: float = -20.0

    def word_scores(self, levels: list[np.ndarray]) -> np.ndarray:
        found = np.zeros(len(levels[-1]))
        open_ = np.ones(len(found), bool)
        if len(self.keys):
            for level in reversed(levels):
                where = np.flatnonzero(open_)
                at = np.minimum(np.searchsorted(self.keys, level[where]), len(self.keys) - 1)
                known = self.keys[at] == level[where]
                found[where[known]] = self.scores[at[known]]
                open_[where[known]] = False
        return found

    def excess(self, n_words: np.ndarray, found: Found) -> np.ndarray:
        """What each segment's normalised score has beyond that expected of the best one by chance; -ln of its expected count."""
        return self.rate * found.score - self.ln_k - np.log(np.maximum(np.repeat(n_words, np.diff(found.to)), 1))

    def evidence(self, n_words: np.ndarray, found: Found) -> np.ndarray:
        """Joint statistic of each document's segments: what all those beyond chance have in excess, on a root scale."""
        excess = self.excess(n_words, found)
        most = np.tanh(found.per_doc(excess, np.maximum, np.nan) / 4)
        return np.sqrt(found.per_doc(np.maximum(excess, 0), np.add, 0.0)) + np.where(np.isnan(most), -1.0, most)

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * statistic + self.offset)))


def _labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, part: Column, bound: int) -> DataFrame:
    """Texts and labels of at most ``bound`` labelled ids, those of the smallest hashes. Of rows that repeat an id one counts."""
    own = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & part).groupBy(id).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = own.orderBy(F.xxhash64(F.col(id).cast("string")), id).limit(bound)
    return docs.select(id, F.col(text).alias("text")).join(F.broadcast(chosen), id).groupBy(id).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", use: Column | None = None) -> Model:
    """Learn from documents whose id is among ``labels`` and meets ``use``.

    Four fifths of the ids (by hash) teach word scores, the others the calibration; at most ``FIT_DOCS`` and
    ``CALIBRATE_DOCS`` of them, and at most ``MODEL_TERMS`` words and beginnings of words, those in the most documents. Of
    repeated labels of an id the largest counts, of repeated documents the one of the smallest text. Without labels of both kinds the model
    gives every document a score next to 0.
    """
    use = F.lit(True) if use is None else use
    turn = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit(5)), F.lit(5))
    counted = _counts(_labelled(docs, labels, id, text, label, use & (turn != 0), FIT_DOCS))
    most = counted.orderBy(F.col("level") >= 0, -(F.col("toxic") + F.col("clean")), "level", "key").limit(MODEL_TERMS)
    found = most.toArrow()
    rows = {c: found.column(c).to_numpy() for c in found.column_names}
    del found
    total = rows["level"] < 0
    n1, n0 = int(rows["toxic"][total].sum()), int(rows["clean"][total].sum())
    if not n1 or not n0:
        return Model()
    model = _word_model(rows, n1, n0)
    del rows
    _calibrate(model, _labelled(docs, labels, id, text, label, use & (turn == 0), CALIBRATE_DOCS))
    return model


def _counts(texts_: DataFrame) -> DataFrame:
    """For each word and beginning the number of toxic and clean documents with it, and its parent; level -1 has all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, levels = features(batch.column(0))
            toxic = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float)) > 0
            out = [(np.array([0], np.uint64), np.array([0], np.uint64), np.array([-1]), np.array([toxic.sum()]), np.array([(~toxic).sum()]))]
            for k, level in enumerate(levels):
                parent = levels[k - 1] if k else np.zeros(len(level), np.uint64)
                order = np.lexsort((words.doc, level))
                key, doc = level[order], words.doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                order, key, doc = order[new], key[new], doc[new]
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                if len(at):
                    out.append((key[at], parent[order[at]], np.full(len(at), k), np.add.reduceat(toxic[doc].astype(int), at), np.add.reduceat((~toxic[doc]).astype(int), at)))
            key, parent, level, one, zero = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"key": longs(key), "parent": longs(parent), "level": pa.array(level, pa.int32()), "toxic": pa.array(one, pa.int64()), "clean": pa.array(zero, pa.int64())})

    counted = texts_.mapInArrow(run, "key bigint, parent bigint, level int, toxic bigint, clean bigint")
    summed = counted.groupBy("level", "key").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return summed.where((F.col("level") < 0) | (F.col("toxic") + F.col("clean") >= MIN_DOCS))


def _word_model(rows: dict[str, np.ndarray], n1: int, n0: int) -> Model:
    base = n1 / (n1 + n0)
    keys: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    above_key, above = np.zeros(1, np.uint64), np.array([base])
    for k in range(len(STEMS) + 1):
        own = np.flatnonzero(rows["level"] == k)
        own = own[np.argsort(rows["key"][own].view(np.uint64))]
        key, parent = (rows[c][own].view(np.uint64) for c in ("key", "parent"))
        at = np.minimum(np.searchsorted(above_key, parent), len(above_key) - 1)
        prior = np.clip(np.where(above_key[at] == parent, above[at], base), 0.02, 0.98) if len(own) else np.zeros(0)
        one, zero = rows["toxic"][own] + PRIOR * prior, rows["clean"][own] + PRIOR * (1 - prior)
        share = one / (one + zero)
        odds = np.log(one / zero) - np.log(base / (1 - base))
        error = np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))
        keys.append(key)
        scores.append(np.where(odds > 0, np.maximum(odds - CAUTION * error, 0), np.minimum(odds + CAUTION * error, 0)))
        if len(own):
            above_key, above = key, share
    key, score = np.concatenate(keys), np.concatenate(scores)
    key, first = np.unique(key, return_index=True)
    return Model(key, score[first])


def _calibrate(model: Model, texts_: DataFrame) -> None:
    """Set the extreme-value law from clean documents' words and best segments, and the curve from all."""
    edges = np.linspace(-4, 12, 321)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, levels = features(batch.column(0))
            score, clean = model.word_scores(levels), np.array(batch.column(1).to_pylist()) == 0
            best = Found.of(words, score)
            histogram = np.bincount(np.digitize(score[clean[words.doc]], edges), minlength=len(edges) + 1)
            rows = [{"toxic": int(not c), "n": int(n), "best": None if np.isnan(b) else float(b)} for c, n, b in zip(clean, words.counts(), best.per_doc(best.score, np.maximum, np.nan), strict=True)]
            rows.append({"toxic": -1, "n": 0, "best": None, "histogram": histogram.tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("histogram", pa.list_(pa.int64()))]))

    table = texts_.mapInArrow(measure, "toxic int, n bigint, best double, histogram array<bigint>").toArrow()
    toxic, n, best = (table.column(c).to_numpy() for c in ("toxic", "n", "best"))
    histogram = sum((np.array(h.as_py()) for h, t in zip(table.column("histogram"), toxic, strict=True) if t < 0), np.zeros(len(edges) + 1, np.int64))
    if len(set(toxic[toxic >= 0])) < 2:
        model.slope, model.offset = 1.0, -4.0
        return
    middle = np.concatenate([[edges[0]], (edges[1:] + edges[:-1]) / 2, [edges[-1]]]) - DRIFT
    model.rate = _rate(middle, histogram)
    chance = (toxic == 0) & ~np.isnan(best)
    model.ln_k = float(np.mean(model.rate * best[chance] - np.log(np.maximum(n[chance], 1))) - np.euler_gamma) if chance.any() else 0.0

    def statistic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, levels = features(batch.column(0))
            x = model.evidence(words.counts(), Found.of(words, model.word_scores(levels)))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "x": pa.array(x)})

    table = texts_.mapInArrow(statistic, "toxic int, x double").toArrow()
    model.slope, model.offset = _curve(table.column("x").to_numpy(), table.column("toxic").to_numpy() > 0)


def _rate(score: np.ndarray, count: np.ndarray) -> float:
    """The positive root of sum p exp(rate score) = 1; words cost more than they bring on average."""
    p = count / max(count.sum(), 1)
    if not (p[score > 0].sum() > 0 and (p * score).sum() < 0):
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(np.minimum(middle * score, 500))).sum() < 1 else (low, middle)
    return float(np.clip(low, 0.05, 10))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, with a weak pull to 0."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(max(w[0], 1e-3)), float(w[1])


PASSAGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "toxicity", expected: float = 0.01) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and a struct ``out``: ``score`` (0 to 1) and ``passages``.

    Passages are the segments (word numbers from 0, score) of which fewer than ``expected`` would come by chance in a
    text of that length. A null or empty text has none and gets the lowest score. Repeated rows get the same result;
    other columns pass unchanged, whatever their names (but not ``out``, which must be free).
    """
    keep = list(docs.columns if keep is None else keep)
    if out in keep:
        raise ValueError(f"docs has a column {out!r} already")
    frame = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)]))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model = to_arrow_schema(schema), shared.value
        for batch in pieces(batches, text):
            words, levels = features(batch.column(batch.schema.get_field_index(text)))
            found, counts = Found.of(words, model.word_scores(levels)), words.counts()
            excess = model.excess(counts, found)
            shown = excess > -np.log(expected)
            fields = {"first": found.first[shown], "last": found.last[shown], "score": found.score[shown], "expected": np.exp(-excess[shown])}
            ends = np.concatenate([[0], np.cumsum(shown)])[found.to]
            passages = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))
            score_ = pa.array(model.probability(model.evidence(counts, found)))
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in keep}
            columns[out] = pa.StructArray.from_arrays([score_, passages], ["score", "passages"])
            yield pa.RecordBatch.from_arrays([columns[n].cast(arrow.field(n).type) for n in arrow.names], schema=arrow)

    return frame.mapInArrow(run, schema)
