"""From raw documents to packed token sequences.

Stages: reject toxic documents, keep one document of each group of near duplicates, replace personal
data, pack the texts into sequences.  Every stage reads what the one before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import minhash, packing, pii, toxicity
from caseweave.llm.common import prepared, store, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score, learnt from the labels, stays below the limit; all columns are kept.

    A missing or empty text scores below it, repeated rows share their fate, and without toxic examples
    all documents stay.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; all columns are kept.

    Equal texts, empty and missing ones among them, are one group each; texts without a run of words
    are compared as a whole.
    """
    prepared(spark)
    return minhash.deduplicated(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in brackets; ``n_chars``, where there is such a column, follows the text.

    A missing text stays missing; every row and column is kept, in any number of repeats.
    """
    prepared(spark)
    changed = docs.withColumn("text", pii.redacted(F.col("text")))
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids; a missing or empty text has its end id only."""
    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

# Trained scores, sketches and tokenizers have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs)
    return docs
