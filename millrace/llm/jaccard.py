"""N-gram Jaccard self-join as a blocked product of the document by n-gram incidence matrix.

The columns (n-gram hashes) are dealt to blocks. Two documents whose sets are
alike enough differ in at most ``d`` columns, a bound that follows from their
sizes; with more than ``d`` blocks they agree wholly on some, and the sizes
say on how many at least. A document is entered under the content of each of
its blocks. Counts of common entries accumulate over the blocks, pairs below
the bound of their sizes are discarded, and only for the rest are the overlaps
themselves accumulated.

Sizes fall into bands. A pair is met in the band of its larger set, to which
sets just below the band are entered too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scoring import pack, pack_counts, unpack, unpack_counts
from .storage import cut
from .words import gram_hash, grams, lists, longs, mix, pieces, split

#: A block with at most so many columns says little; it gets an entry only in documents with more of these than the spare blocks.
_THIN = 1
#: Ratio of sizes within a band.
_BAND = 0.65
#: Entries of up to so many documents are joined with themselves; those of more are searched by rarest columns.
_FEW = 24
_E_BITS = 24
#: Bytes of text behind a chunk of crowded documents.
_CHUNK_BYTES = 8 << 20


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, ascending, as flat values and offsets; a shorter text is one shingle."""
    words = split(column)
    at, code = grams(words, n)
    doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
    count = words.counts()
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        doc = np.concatenate([doc, short])
        code = np.concatenate([code, gram_hash(words.hash, words.first[:-1][short], k)])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])
        doc, code = doc[new], code[new]
    return code, np.searchsorted(doc, np.arange(words.n_docs + 1))


def _map(df: DataFrame, text: str, schema: str, make) -> DataFrame:
    """One call of ``make(batch)`` for each piece; it returns a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_pydict(make(batch))

    return df.mapInArrow(run, schema)


def band(size: int) -> int:
    return int(math.log(size) / -math.log(_BAND) + 1e-9)


def blocks_of(k: int, threshold: float) -> tuple[int, int]:
    """How many blocks the columns of documents in band ``k`` are dealt to, and how many of these are spare.

    Of all blocks, those that a linked pair agrees on are at least one more than the spare ones.
    """
    top = math.ceil(_BAND ** -(k + 1) + 1e-6)
    differ = most_different(2 * top, threshold)
    spare = 2 + math.ceil(0.08 * differ) if differ else 0
    return differ + 1 + spare, spare


def most_different(sizes: int, threshold: float) -> int:
    """The most columns in just one of two sets that reach the threshold, by the sum of their sizes."""
    return math.floor((1 - threshold) / (1 + threshold) * sizes + 1e-9)


def entries(code: np.ndarray, to: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document with a set: its number, the entries of its blocks, and how many of that band count.

    Two linked documents have at least as many entries in common as the larger count of the two, less the columns they
    differ in. The entry of the whole set comes with 0 for a count.
    """
    size = np.diff(to)
    bands = np.array([band(int(s)) if s else -1 for s in size], np.int64)
    some = np.flatnonzero(size)
    docs, found, count = [some], [mix(np.add.reduceat(mix(code), to[:-1][some]) + size[some].astype(np.uint64)) if len(some) else np.zeros(0, np.uint64)], [np.zeros(len(some), np.int64)]
    for own in np.unique(bands[bands >= 0]):
        mine = np.flatnonzero(bands == own)
        for k in (own, own + 1):
            blocks, spare = blocks_of(k, threshold)
            here = mine if k == own else mine[size[mine] >= math.floor(threshold * _BAND**-k - 1e-6)]  # large enough for a partner in the next band
            if not len(here):
                continue
            n = size[here]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            col = code[np.repeat(to[:-1][here], n) + within]
            row = np.repeat(np.arange(len(here)), n)
            block = ((mix(col) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            cell = row * blocks + block
            order = np.argsort(cell, kind="stable")
            cell, col = cell[order], mix(col[order] ^ np.uint64(0x2545F4914F6CDD1D))
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            content = np.add.reduceat(col, at)
            cell = cell[at]
            thick = np.diff(np.append(at, len(col))) > _THIN
            thin = blocks - np.bincount(cell[thick] // blocks, minlength=len(here)) > spare
            none = np.setdiff1d((np.flatnonzero(thin)[:, None] * blocks + np.arange(blocks)).reshape(-1), cell)
            enter = thick | thin[cell // blocks]
            cell, content = np.concatenate([cell[enter], none]), np.concatenate([content[enter], np.zeros(len(none), np.uint64)])
            docs.append(here[cell // blocks])
            own_count = np.where(thin, blocks - spare, np.bincount(cell // blocks, minlength=len(here)))
            count.append(own_count[cell // blocks])
            found.append(mix(content * np.uint64(0xA24BAED4963EE407) + (cell % blocks).astype(np.uint64) * np.uint64(4096) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(found), np.concatenate(count)


def _entries(n: int, threshold: float):
    def make(batch: pa.RecordBatch) -> dict:
        code, to = shingle_sets(batch.column(1), n)
        doc, entry, count = entries(code, to, threshold)
        packed = (np.diff(to)[doc] << _E_BITS) + np.minimum(count, (1 << _E_BITS) - 1)
        return {"id": batch.column(0).take(pa.array(doc)), "packed": pa.array(packed), "entry": pa.array(longs(entry))}

    return make


def _sets(n: int):
    def make(batch: pa.RecordBatch) -> dict:
        code, to = shingle_sets(batch.column(1), n)
        return {"id": batch.column(0), "cols": lists(longs(code), to, pa.int64())}

    return make


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (x, y) whose sets reach the threshold, as edges (a, b)."""
    with_y = pairs.join(sets.select(F.col("id").alias("y"), F.col("cols").alias("cols_y")), "y")
    both = with_y.join(sets.select(F.col("id").alias("x"), F.col("cols").alias("cols_x")), "x")
    sized = both.select("x", "y", (F.size("cols_x") + F.size("cols_y")).alias("sizes"), F.size(F.array_intersect("cols_x", "cols_y")).alias("overlap"))
    return sized.where(100 * F.col("overlap") >= round(threshold * 100) * (F.col("sizes") - F.col("overlap"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Documents linked through word n-gram sets of Jaccard similarity ``threshold`` (in whole hundredths) or more.

    One row for each different ``id``: it, ``n_shingles`` (size of its set) and ``component_id``, the smallest id
    reachable by links, its own included. Words are runs without ASCII white space, A-Z lower-cased. A text of fewer
    than ``n`` words is one shingle; a null text or one without words has an empty set and is linked with nothing.
    Rows with a null id are left out. Of rows that repeat an id, the links of all count as that id's, and
    ``n_shingles`` is the largest. Other columns are not read.

    1. Entries lead to candidates. Sets that are equal meet in an entry of their own, and only the smallest id goes on.
    2. An entry shared by many documents isn't expanded into pairs: all are compared with its smallest member, and
       what that links is one component from then on.
    3. Pairs across components follow: by counts of common entries where these hold few documents, by rarest columns
       for documents of larger ones. No link that matters is lost.
    """
    if threshold < _BAND:
        raise ValueError(f"threshold must be {_BAND} or more, not {threshold}")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entered = _map(rows, "text", f"id {kind}, packed bigint, entry bigint", _entries(n, threshold)).repartition(parts, "entry")
    shared = entered.groupBy("entry").agg(F.min("id").alias("first"), F.count("*").alias("k"), F.max("packed").alias("most"))
    e = F.col("packed") % (1 << _E_BITS)
    hits = cut(entered.join(shared, "entry").where((F.col("k") > 1) | (F.col("most") % (1 << _E_BITS) == 0)).select("entry", "id", "packed", "first"), free=True)
    hits = hits.select("entry", "id", "first", F.shiftright("packed", _E_BITS).alias("size"), e.alias("e"))
    whole = hits.where("e = 0").select("id", "first", "size")
    links = representative_links(rows, hits.where("e > 0"), whole.select("first").distinct(), kind, n, threshold)
    found = components(links.union(whole.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))))
    sizes = whole.groupBy("id").agg(F.max("size").alias("n_shingles"))
    return (
        rows.select("id").distinct()
        .join(sizes, "id", "left")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .select(F.col("id").alias(id), F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def _enough(share: float) -> Column:
    """Whether pair rows (size, e, size2, e2, common) can reach the threshold by their sizes and entries in common."""
    small, large = F.least("size", "size2"), F.greatest("size", "size2")
    differ = F.floor((1 - share) / (1 + share) * (F.col("size") + F.col("size2")) + 1e-9)
    return (100 * small >= round(share * 100) * large) & (F.col("common") >= F.greatest("e", "e2") - differ)


def _chunk_sets(text: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, of many texts."""
    codes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in pieces(pa.table({"text": text}).to_batches(), "text"):
        code, to = shingle_sets(batch.column(0), n)
        codes.append(code)
        sizes.append(np.diff(to))
    return np.concatenate(codes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def rare_first_pairs(docs: DataFrame, kind: str, n: int, threshold: float) -> DataFrame:
    """Pairs (x, y) across components that may reach the threshold, of rows (id, text, c).

    A set's columns are ranked rarest first, so that columns of a single document come before all shared ones. Two
    sets that reach the threshold have their first common column among the first ``size - ceil(threshold * size) + 1``
    of either, and no more columns in common than follow it in the shorter rest. In the smaller one it is even among
    the first ``size - ceil(2 threshold / (1 + threshold) * size) + 1``, as the overlap bound grows with both sizes; only
    these are met from the other side, so that documents which differ by more than the bound share no columns here.

    How many documents have a column is asked for in chunks, as packed lists, and only a set's first columns are
    shuffled one by one, less those of a single document.
    """
    percent = round(threshold * 100)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    parts = math.ceil(size / _CHUNK_BYTES)
    rows = docs.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        col, count = np.unique(mix(_chunk_sets(table.column("text"), n)[0]), return_counts=True)
        part = ((col >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        to = np.append(at[1:], len(part))
        lists_ = [[f(x[i:j]) for i, j in zip(at, to, strict=False)] for f, x in ((pack, col), (pack_counts, count))]
        return pa.table({"part": pa.array(part[at], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(at), pa.int32()), "cols": pa.array(lists_[0], pa.binary()), "counts": pa.array(lists_[1], pa.binary())})

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        col = [unpack(b) for b in table.column("cols").to_pylist()]
        count = np.concatenate([unpack_counts(b) for b in table.column("counts").to_pylist()])
        _, which = np.unique(np.concatenate(col), return_inverse=True)
        total = np.bincount(which, count).astype(np.int64)[which]
        edge = np.cumsum([0, *map(len, col)])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([pack_counts(total[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    def first_columns(left: pa.Table, right: pa.Table) -> pa.Table:
        code, to = _chunk_sets(left.column("text"), n)
        answers = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist(), strict=True))
        total = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(b) for _, b in answers)])
        k = total[np.unique(mix(code), return_inverse=True)[1]]
        own = np.diff(to)
        doc = np.repeat(np.arange(len(own)), own)
        order = np.lexsort((code, k, doc))
        at = np.arange(len(code)) - to[doc] + 1
        first = own - -(-own * percent // 100) + 1
        inner = own - -(-2 * percent * own // (100 + percent)) + 1
        keep = np.flatnonzero((k[order] > 1) & (at <= first[doc]))
        of = pa.array(doc[keep])
        take = lambda c: left.column(c).take(of)
        return pa.table({"col": pa.array(longs(code[order][keep])), "id": take("id"), "c": take("c"), "size": pa.array(own[doc[keep]], pa.int32()), "at": pa.array(at[keep], pa.int32()), "inner": pa.array(at[keep] <= inner[doc[keep]])})

    sent = rows.groupBy("chunk").applyInArrow(send, "part int, chunk int, cols binary, counts binary")
    answered = sent.groupBy("part").applyInArrow(add_up, "chunk int, part int, totals binary")
    near = cut(rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(first_columns, f"col bigint, id {kind}, c {kind}, size int, at int, inner boolean"))
    other = near.where("inner").select("col", *(F.col(c).alias(f"{c}2") for c in ("id", "c", "size", "at")))
    smaller = (F.col("size2") < F.col("size")) | ((F.col("size2") == F.col("size")) & (F.col("id2") < F.col("id")))
    most = 1 + F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    return (
        near.join(other, "col")
        .where(smaller & (F.col("c") != F.col("c2")))
        .where(100 * most >= percent * (F.col("size") + F.col("size2") - most))
        .select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y"))
        .distinct()
    )


def representative_links(rows: DataFrame, hits: DataFrame, reps: DataFrame, kind: str, n: int, threshold: float) -> DataFrame:
    """Links (a, b) between representatives that are enough to connect what is linked."""
    own = hits.select("entry", "id", "size", "e").join(reps.withColumnRenamed("first", "id"), "id", "left_semi")
    differ = F.floor((1 - threshold) / (1 + threshold) * (F.col("size") + F.floor(F.col("size") / threshold + 1e-9)) + 1e-9)
    enough_met = lambda df: df.withColumn("met", F.count("*").over(Window.partitionBy("id", "size", "e"))).where(F.col("met") >= F.col("e") - differ).drop("met")
    own = enough_met(own)
    every = own.groupBy("entry").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("k")).where("first <> last")
    own = cut(own.join(every.drop("last"), "entry"), free=True)
    lead = own.where("id = first").select("entry", F.col("size").alias("size2"), F.col("e").alias("e2"))
    star = own.where("id <> first").join(lead, "entry").groupBy(F.col("first").alias("x"), F.col("id").alias("y"), "size", "e", "size2", "e2").agg(F.count("*").alias("common"))
    star = cut(star.where(_enough(threshold)).select("x", "y").distinct())
    links = cut(verify(star, _sets_of(rows, star, kind, n), threshold))
    label = components(links)
    now = own.join(label, own["id"] == label["node"], "left").select("entry", "id", "size", "e", F.coalesce("component", "id").alias("c"))
    for _ in range(2):  # entries of one component go, then documents that have too few left to be linked across
        several = now.groupBy("entry").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("k")).where("c0 <> c1").select("entry", "k")
        now = cut(enough_met(now.drop("k").join(several, "entry")), free=True)
    crowd = cut(now.where(F.col("k") > _FEW).select("id", "c").distinct())
    crowds = not crowd.isEmpty()
    few = now.where(F.col("k") <= _FEW)
    few = few.join(crowd.select("id", F.lit(True).alias("crowd")), "id", "left").na.fill(False, ["crowd"]) if crowds else few.withColumn("crowd", F.lit(False))
    other = few.select("entry", *(F.col(c).alias(f"{c}2") for c in ("id", "size", "e", "c", "crowd")))
    across = (
        few.join(other, "entry")
        .where((F.col("id") < F.col("id2")) & (F.col("c") != F.col("c2")) & ~(F.col("crowd") & F.col("crowd2")))
        .groupBy(F.col("id").alias("x"), F.col("id2").alias("y"), "size", "e", "size2", "e2")
        .agg(F.count("*").alias("common"))
        .where(_enough(threshold))
        .select("x", "y")
        .distinct()
    )
    if crowds:
        across = across.union(rare_first_pairs(cut(rows.join(crowd, "id")), kind, n, threshold))
    pairs = cut(across.join(star, ["x", "y"], "left_anti"))
    return links.union(verify(pairs, _sets_of(rows, pairs, kind, n), threshold))


def _sets_of(rows: DataFrame, ids: DataFrame, kind: str, n: int) -> DataFrame:
    """Rows (id, cols) of the documents that occur in any column of ``ids``."""
    wanted = ids.select(F.explode(F.array(*ids.columns)).alias("id")).distinct()
    return _map(rows.join(wanted, "id", "left_semi").select("id", "text"), "text", f"id {kind}, cols array<bigint>", _sets(n))
