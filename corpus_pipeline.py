"""A corpus pipeline: quality rules, exact dedup, near-duplicate removal, packing.

Every stage works on all that the one before it kept; all but the last return the columns
of ``documents``.  Each result is written to the shared folder and read again as the next
stage's input.

Defined cases: a null text is empty and fails the quality rules, as an empty one does; a null id
loses to any id of an equal text and is never the near copy that goes; of rows with one id and
text one stays; an empty table, or one of which nothing is left, packs to no rows; very long
texts are read whole and cut into pieces by the last stage alone; other columns pass all
filtering stages unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkgraph.llm import exact_dedup, jaccard, packing, quality
from inkgraph.plans.lineage import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that all quality rules pass."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.share(spark, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("ngram_jaccard", near_stage), ("best_fit_packing", packing_stage),
]

#: Tokenising and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
