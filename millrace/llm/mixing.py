"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .storage import cut

#: About so many documents, and units of size, share a bucket, in which positions within a source are counted.
BUCKET_DOCS, BUCKET_SIZE = 5_000, 1 << 21

_WHITE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    inner = F.btrim(text, F.lit(_WHITE))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(inner, r"[ \t-\r]+"))).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word and the white space behind it."""
    runs = F.split(text, r"(?<=[ \t-\r])(?=[^ \t-\r])")
    leads = F.when(text.rlike(r"^[ \t-\r]"), F.lit(1)).otherwise(F.lit(0))
    return F.array_join(F.slice(runs, F.lit(1), (n + leads).cast("int")), "")


def cyclic_weights(docs: DataFrame, source: str = "source", cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A weight for each source of ``docs``: ``cycle`` over and over, by code point, null last."""
    sources = cut(docs.select(source).distinct())
    named = numbered(sources.where(F.col(source).isNotNull()), [], [source], "_rank")
    last = sources.where(F.col(source).isNull()).withColumn("_rank", F.lit(named.count() + 1).cast("long"))
    place = ((F.col("_rank") - 1) % len(cycle) + 1).cast("int")
    return named.unionByName(last).select(source, F.element_at(F.lit(list(cycle)), place).cast("double").alias("weight"))


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def fill(totals: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``target`` for rows of ``source_size`` and ``weight``.

    All share ``total`` by weight; who would exceed ``max_epochs`` times its size stays there, and the others share the
    rest anew, until none exceeds. The level at which the others stand only rises, so each round is one aggregate.
    """
    cap = max_epochs * F.col("source_size").cast("double")
    level, clamped = -1.0, None
    while True:
        over = F.col("weight") * level > cap if level >= 0 else F.lit(False)
        row = totals.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if row[2] == clamped or row[2] is None:
            break
        clamped = row[2]
        if not row[1]:
            break
        level = max(level, (total - row[0]) / row[1])
    return totals.withColumn("target", F.least(cap, F.col("weight") * max(level, 0.0)))


def mix_sources(docs: DataFrame, weights: DataFrame, size: Column, id: str = "doc_id", source: str = "source", share: float = 1.0, max_epochs: float = 3.0, seed: int = 0, prefix: str = "mix_", content: Column | None = None) -> DataFrame:
    """How much of every row of ``docs`` a mix takes; the columns of ``docs`` and, with ``prefix``:

    ``size``, ``source_size``, ``target`` (of its source, in the unit of ``size``), ``whole`` (repetitions of the whole
    row), ``part`` (units of one more repetition: all of them, some in one row of each source, or 0) and ``taken``.
    What is taken of a source comes to its target, rounded.

    ``weights`` has a row (``source``, weight) for each source; a source without one, or with null, gets nothing.
    Null is a source like others. The mix has ``share`` of all sizes; where every source is at ``max_epochs`` times its
    size, it has less. Rows of null size count as 0. A seeded digest of the id and of ``content`` (by default a hash of all
    columns) puts a source's rows in order, and a part goes to the first; so rows that repeat an id, or have none, are
    told apart by their content, and only rows that are equal in all of it tie. An empty table gives an empty one.

    Positions in a source are counted by buckets of the digest, so that a source of any share of the rows is split.
    """
    own = {n: f"{prefix}{n}" for n in ("size", "source_size", "target", "whole", "part", "taken")}
    if clash := set(own.values()) & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)} already; choose another prefix")
    content = F.xxhash64(*docs.columns) if content is None else content
    hash_ = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("")), content.cast("string")).cast("binary"))
    rows = docs.withColumns({"_mix_size": F.coalesce(size.cast("long"), F.lit(0).cast("long")), "_mix_key": _key(source), "_mix_hash": hash_})
    count, units = rows.agg(F.count("*"), F.sum("_mix_size")).first()
    n = max(1, -(-count // BUCKET_DOCS), -(-(units or 0) // BUCKET_SIZE))
    bucket = F.floor(F.conv(F.substring("_mix_hash", 1, 8), 16, 10).cast("double") * n / (1 << 32)).cast("long")  # rises with the digest
    buckets = cut(rows.withColumn("_mix_bucket", bucket).groupBy("_mix_key", "_mix_bucket").agg(F.sum("_mix_size").alias("words")), free=True)
    weight = weights.groupBy(_key(source).alias("_mix_key")).agg(F.max("weight").alias("weight"))
    totals = cut(buckets.groupBy("_mix_key").agg(F.sum("words").alias("source_size")).join(weight, "_mix_key", "left").na.fill(0.0, ["weight"]))
    total = units or 0
    targets = fill(totals, share * total, max_epochs)
    size_ = F.greatest("source_size", F.lit(1))
    targets = targets.withColumn("whole", F.floor(F.round("target") / size_)).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_mix_key").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = buckets.withColumn("before", before).join(targets.drop("weight"), "_mix_key")
    placed = placed.select("_mix_key", "_mix_bucket", *(F.col(c).alias(f"_mix_{c}") for c in ("before", "source_size", "target", "whole", "rest")))
    order = Window.partitionBy("_mix_key", "_mix_bucket").orderBy("_mix_hash").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_mix_bucket", bucket).join(placed, ["_mix_key", "_mix_bucket"])
    start = F.col("_mix_before") + F.sum("_mix_size").over(order) - F.col("_mix_size")
    part = F.least(F.greatest(F.col("_mix_rest") - start, F.lit(0)), F.col("_mix_size"))
    done = joined.withColumn("_mix_part", part)
    return done.select(
        *(F.col(c) for c in docs.columns),
        F.col("_mix_size").alias(own["size"]),
        F.col("_mix_source_size").alias(own["source_size"]),
        F.col("_mix_target").alias(own["target"]),
        F.col("_mix_whole").alias(own["whole"]),
        F.col("_mix_part").cast("long").alias(own["part"]),
        (F.col("_mix_whole") * F.col("_mix_size") + F.col("_mix_part")).cast("long").alias(own["taken"]),
    )


def repetitions(mixed: DataFrame, text: str = "text", prefix: str = "mix_", out: str = "repetition") -> DataFrame:
    """The rows of a mix: each document as often as it is taken, numbered from 1 in ``out``.

    A partial repetition has the first words of the text. Columns of ``mix_sources`` are left out.
    """
    if out in mixed.columns:
        raise ValueError(f"there is a column {out!r} already")
    part, size, whole = (F.col(f"{prefix}{c}") for c in ("part", "size", "whole"))
    times = (whole + F.when(part > 0, 1).otherwise(0)).cast("int")
    rows = mixed.where(times > 0).withColumn(out, F.explode(F.sequence(F.lit(1), times)))
    shortened = F.when((F.col(out) > whole) & (part < size), first_words(F.col(text), part)).otherwise(F.col(text))
    return rows.withColumn(text, shortened).drop(*(f"{prefix}{c}" for c in ("size", "source_size", "target", "whole", "part", "taken")))
