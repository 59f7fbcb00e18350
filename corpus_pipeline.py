"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontamination import without_items
from lodestone.llm.language_id import accepted_only
from lodestone.llm.ngram_join import one_of_each
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import kept_only
from lodestone.llm.stored import drop_stored, read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the share of content lines keep; labels train the line model."""
    return kept_only(docs, read(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return accepted_only(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_items(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the documents, one row for each, without ids: doc_id, start and length say which they are."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The stages are models, hashes and tokenizers, which SQL can't express; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is a table that the next one reads, and that goes when the next one's is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            kept = stored(kept, f"stage-{k}")
            if k:
                drop_stored(docs)
        docs = kept
    return docs
