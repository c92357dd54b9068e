"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each one's weight its count. For each of ``SAMPLES``
positions every term has two gamma(2, 1) variables ``r`` and ``c`` and a uniform
one ``b``, the same in all texts. A term of weight w stands at the level
``t = floor(ln w / r + b)`` and has the rank ``c / exp(r (t + 1 - b))``; the text's
sample is the term and level of the smallest rank. Two texts agree at a position
with a probability of their generalised Jaccard similarity (the sum of smaller
weights by that of larger ones).

A gamma(2, 1) variable is the sum of two exponential ones, and the share of
either in it is uniform and independent of the sum. So all three come from four
exponential variables: ``c = A + B``, ``r = E + G`` with ``E = ln(c / A)``, and
``b = G / r``. At level 0, where all words of count 1 are, the rank is just ``A``:
only repeated words take logarithms.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranges_of
from .storage import cut

SAMPLES = 64
#: Bytes of text behind a partition, and partitions at most; a partition of more text spills.
PART_BYTES, MOST_PARTS = 6 << 20, 20_000
#: Samples whose ranks a row of a repeated word has; with more, the generated method passes 8,000 bytes and the JVM leaves it uncompiled.
_LOT = 3
#: Copies of a row that are made at a time.
_COPIES = 10_000
_WHITE = " \t\n\x0b\f\r"


#: One number for each sample, from which all its draws come.
_SEEDS = [random.Random(number).getrandbits(63) for number in range(256)]


def _drawn(term: Column, seed: Column, which: int) -> Column:
    """One of the whole numbers below 2 ** 63 that belong to a term and a sample; the first, which every term needs, hashes one value only."""
    mixed = term.bitwiseXOR(seed)
    return F.shiftrightunsigned(F.xxhash64(mixed, F.lit(which)) if which else F.xxhash64(mixed), 1)


def single_rank(term: Column, number: int) -> Column:
    """The rank of a term (a long) of count 1 at the sample ``number``: 63 bits, the share of the exponential law below it."""
    return _drawn(term, F.lit(_SEEDS[number]), 0)


def with_ranks(rows: DataFrame) -> DataFrame:
    """Rows of ``_term``, ``_count`` (2 or more) and ``_lot`` with ``_rank0`` to ``_rank2``, the ranks at the samples of that lot; others (``_lot`` below 0) get nulls there."""
    some, term = F.col("_lot") >= 0, F.col("_term")
    uniform = lambda h: (h.cast("double") + 0.5) * F.lit(2.0**-63)
    of = lambda name: {i: F.col(f"_{name}{i}") for i in range(_LOT)}
    each = lambda name, made: {f"_{name}{i}": made(i) for i in range(_LOT)}
    seed, own, a, b, g, r = (of(c) for c in ("seed", "own", "a", "b", "g", "r"))
    rows = rows.withColumns(each("seed", lambda i: F.when(some, F.get(F.lit(_SEEDS), F.col("_lot") * _LOT + i))) | {"_w": F.when(some, F.col("_count").cast("double"))})
    rows = rows.withColumns({k: v for n, c in enumerate(("own", "b", "g")) for k, v in each(c, lambda i, n=n: F.when(some, _drawn(term, seed[i], n))).items()}).drop(*each("seed", str))
    rows = rows.withColumns(each("a", lambda i: -F.log1p(-uniform(own[i]) * F.lit(1 - 2.0**-52))) | each("b", lambda i: -F.log(uniform(b[i]))) | each("g", lambda i: -F.log(uniform(g[i]))))
    rows = rows.withColumns(each("r", lambda i: F.when(b[i] <= (F.col("_w") - 1) * a[i], F.log1p(b[i] / a[i]) + g[i])))  # ln w >= ln(c / a), so the level isn't 0

    def rank(i: int) -> Column:
        level = F.floor((F.log("_w") + g[i]) / r[i])
        lower = (-F.expm1(-(a[i] + b[i]) * F.exp(g[i] - r[i] * (level + 1))) * F.lit(2.0**63 - 1024)).cast("long")
        return F.when(r[i].isNotNull(), lower).otherwise(own[i])

    return rows.withColumns(each("rank", rank)).drop("_w", *(k for c in ("own", "a", "b", "g", "r") for k in each(c, str)))


def words_of(text: Column) -> Column:
    """Runs without ASCII white space; one empty string for a text without any."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE)), r"[ \t-\r]+")


def ranked_terms(rows: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``_term`` of every different word: one row of count 1 (``_lot`` below 0), or a row with ranks for each lot of samples."""
    words = rows.select(*keys, F.explode(words_of(F.col(text))).alias("_word"))
    counted = words.select(*keys, F.xxhash64("_word").alias("_term")).groupBy(*keys, "_term").agg(F.count("*").alias("_count"))
    lots = F.when(F.col("_count") > 1, F.lit(list(range(math.ceil(samples / _LOT))))).otherwise(F.lit([-1]))
    return with_ranks(counted.withColumn("_lot", F.explode(lots)))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES, out: str = "samples") -> DataFrame:
    """``keys`` and ``out``, an array of ``samples`` numbers that stand for the sampled terms and levels, one row for each different key.

    Rows that repeat a key are one bag of words. Null and empty texts and those of white space alone have one term of
    their own, so that they equal each other and nothing else. Null keys are keys. Other columns are not read.

    If ``rows`` is distributed by some of ``keys`` already, nothing is shuffled. A sample is 32 bits of a hash of the
    rank, so samples that differ look alike once in four thousand millions.
    """
    rank = lambda j: F.when(F.col("_lot") < 0, single_rank(F.col("_term"), j)).when(F.col("_lot") == j // _LOT, F.col(f"_rank{j % _LOT}"))
    least = ranked_terms(rows, keys, text, samples).groupBy(*keys).agg(*(F.min(rank(j)).alias(f"_{j}") for j in range(samples)))
    return least.select(*keys, F.array(*(F.hash(F.col(f"_{j}")) for j in range(samples))).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of positions at which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def edited(text: Column, other: Column) -> Column:
    """A text whose later half is replaced by as much of another's beginning, or by all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def with_previous(texts: DataFrame) -> DataFrame:
    """Rows of ``id``, ``k1``, ``k2``, ``n`` with ``p1``, ``p2`` and ``pn`` of the row before, by ``id`` (null first) and ``k2``; before the first comes the last.

    Only these short rows are put in order, range by range; the end of each range is handed on to the next.
    """
    ranges = ranges_of(texts, "id")
    placed = texts.withColumn("_range", F.lit(0) if ranges is None else ranges).withColumn("_own", F.struct("id", "k2", "k1", "n"))
    ends = placed.groupBy("_range").agg(F.max("_own").alias("_end"))  # a row for each range, of which there are few
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    last = F.last("_end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    handed = ends.withColumn("_handed", F.coalesce(F.lag("_end").over(order), last)).drop("_end")
    within = F.lag("_own").over(Window.partitionBy("_range").orderBy("id", "k2", "k1"))
    found = placed.withColumn("_before", within).join(F.broadcast(handed), "_range").withColumn("_before", F.coalesce("_before", "_handed"))
    return found.select(*texts.columns, *(F.col("_before")[c].alias(p) for c, p in (("k1", "p1"), ("k2", "p2"), ("n", "pn"))))


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness to that form and to the next text.

    ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``, a row
    for each row of ``docs``. A null text is empty. Next is the row of the next id, null first, and after the last comes
    the first; different texts of one id follow each other in the order of their hashes, and equal rows do, so that all
    but the last of them are followed by themselves. An empty table gives an empty one; other columns are not read.

    Only ids and hashes are put in order. Texts are dealt by id and hash, and each sends as much of its beginning as the
    one before it needs; then samples, not texts, go to the one before. Equal rows are one row until the end.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.coalesce(F.col("id").cast("string"), F.lit("")), "k2": F.xxhash64("text", F.col("id").isNull())})
    short = rows.select("id", "k1", "k2", F.length("text").alias("n"), F.octet_length("text").cast("long").alias("size"))
    met = cut(short.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.max("size").alias("size"), F.count("*").alias("m")))
    size, most = met.agg(F.sum("size"), F.max("m")).first()
    parts = min(MOST_PARTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / PART_BYTES)))
    placed = cut(with_previous(met.drop("size")))
    whole = rows.select("k1", "k2", "text").repartition(parts, "k1", "k2")
    if (most or 0) > 1:
        whole = rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).repartition(parts, "k1", "k2")
    whole = whole.join(placed, ["k1", "k2"])
    heads = whole.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), F.floor(F.col("pn") / 2).cast("int")).alias("head"))
    both = whole.join(heads, ["k1", "k2"])
    after, again = edited(F.col("text"), F.col("head")), edited(F.col("text"), F.col("text"))
    form = lambda number, made: F.struct(F.lit(number).alias("form"), made.alias("text"))
    forms = [form(0, F.col("text")), form(1, after)]
    forms = F.when(F.col("m") > 1, F.array(*forms, form(2, again))).otherwise(F.array(*forms))
    made = fingerprints(both.select("k1", "k2", F.inline(forms)), ["k1", "k2", "form"], "text", samples)
    digest = lambda made: F.sha2(made.cast("binary"), 256)
    own = both.select("k1", "k2", F.struct("id", "n", "m", digest(after).alias("sha1"), F.when(F.col("m") > 1, digest(again)).alias("sha2")).alias("own"), "p1", "p2")
    to = lambda k1, k2, role: F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"), role.alias("role"))
    itself = to("k1", "k2", F.col("form"))
    routes = F.when(F.col("form") == 0, F.array(itself, to("p1", "p2", F.lit(3)))).otherwise(F.array(itself))
    sent = made.join(own, ["k1", "k2"]).select(F.when(F.col("form") == 0, F.col("own")).alias("own"), "samples", F.inline(routes))
    role = lambda number, what: F.first(F.when(F.col("role") == number, F.col(what)), ignorenulls=True)
    met = sent.groupBy("k1", "k2").agg(role(0, "own").alias("own"), *(role(k, "samples").alias(f"s{k}") for k in range(4)))
    pair = lambda copy, edit, after, sha: F.struct(F.lit(copy).alias("copy"), F.col("own"), F.col("s0").alias("samples"), F.col(edit).alias("edit"), F.col(after).alias("after"), F.col("own")[sha].alias("sha"))
    last, others = pair(0, "s1", "s3", "sha1"), pair(1, "s2", "s0", "sha2")
    found = met.select(F.inline(F.when(F.col("own.m") > 1, F.array(last, others)).otherwise(F.array(last))))
    found = found.withColumn("times", F.when(F.col("copy") == 0, F.lit(1).cast("long")).otherwise(F.col("own.m") - 1))
    found = found.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _COPIES))))
    found = found.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES).cast("long"), F.col("times") - F.col("some") * _COPIES))))
    return found.select(
        F.col("own.id").alias(id),
        F.col("own.n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("samples")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edit")).alias("near_edited"),
        likeness(F.col("samples"), F.col("after")).alias("near_next"),
    )
