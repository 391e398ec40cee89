"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Low-quality documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, secrets are blotted out, and what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktree.llm.decontaminate import contaminated
from talktree.llm.near_dedup import NearDupParams, near_duplicates
from talktree.llm.packing import PackingParams, pack_documents
from talktree.llm.quality import keep_quality, train_quality
from talktree.llm.secrets import redacted, train_secrets, with_secrets
from talktree.llm.shared import Scratch, distinct_name


#: A document goes for a benchmark item of so many words; a shorter one occurs in texts by chance.
MIN_ITEM_WORDS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids``; rows with a null id stay."""
    gone = distinct_name(docs.columns, "_gone")
    return docs.join(ids.select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id") == F.col(gone), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules; null, blank and very short texts go, rows are judged one by one."""
    return keep_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, on five-word shingles at similarity 0.8.

    Documents with an empty or null text, or a null id, stay; of rows that repeat an id all stay or go.
    """
    return _without(docs, near_duplicates(docs, params=NearDupParams(shingle=5, percent=80)).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item of ``MIN_ITEM_WORDS`` or more; those with a null id stay, as nothing names them."""
    held = contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, held.where(F.col("item_words") >= MIN_ITEM_WORDS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by a mark; n_chars follows.  Null texts stay null, no row goes."""
    ratio = train_secrets(docs, _table(spark, sf_dir, "labels"))
    base, spans = (distinct_name(docs.columns, x) for x in ("base_spans", "secret_spans"))
    found = with_secrets(docs, ratio, out=(base, spans))
    text = F.when(F.size(spans) > 0, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    count = F.when(F.size(spans) > 0, F.length(redacted(F.col("text"), F.col(spans))).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": count}
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; every row is packed, repeats and empty texts too."""
    return pack_documents(docs, PackingParams(added_tokens=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Training, sketches and searches can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
