"""A training corpus from raw documents, stage by stage.

Every stage takes what the stage before it kept. An empty table passes through
all of them; null and empty texts are kept by the first four, and extra columns
stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import decontaminate, is_contaminated
from millrace.llm.jaccard import jaccard_components
from millrace.llm.mixing import cyclic_weights, mix_sources, n_words, repetitions
from millrace.llm.queries import held_out
from millrace.llm.secrets import labelled_findings, redact, train
from millrace.llm.storage import cut
from millrace.llm.toxicity import fit, score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have; names are compared as Spark does, without regard to case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if they score less than a half."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), use=~held_out())
    out = free_name(docs, "_toxicity")
    return score(docs, model, out=out).where(F.col(out)["score"] < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of the smallest id stays.

    Rows that repeat an id stay or go together, and those without an id stay.
    """
    groups = jaccard_components(docs, n=5, threshold=0.8)
    return docs.join(groups.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay unless benchmark windows cover a twentieth of their words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = free_name(docs, "_search")
    return decontaminate(docs, benchmark, out=out).where(~is_contaminated(out)).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their secrets redacted and ``n_chars``, if there is such a column, counted anew where they were."""
    changed = free_name(docs, "_changed")
    cleaned = redact(docs, train(labelled_findings(spark)), changed=changed)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(changed), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n_chars)
    return cleaned.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered in ``repetition``; the last may be a part of its text."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return repetitions(mix_sources(docs, cyclic_weights(docs), n_words(F.col("text")), prefix=prefix), prefix=prefix, out=free_name(docs, "repetition"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("mixing", mixing),
]

#: Not every stage can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
