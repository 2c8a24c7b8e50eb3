"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, packing.

Each stage works on all documents that the one before kept and takes effect; all
but the last return the columns of ``documents``, further ones included, whatever their names.

Odd input, in every stage: an empty table gives an empty one; null and empty texts are kept
(they are not toxic unless most labels are, have no shingles, no words, and pack as the end id
alone); null ids are kept; repeated rows are one document to the near-duplicate
stage, which keeps the rows of a kept doc_id all, and rows of their own to the others; very long texts are
worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import ngram_join, suffix_decontamination, toxicity
from churnlens.llm.common import materialise
from churnlens.llm.queries import WINDOW, packed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labelled ones, does not reject."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth, or nothing, is verbatim in the benchmark."""
    return suffix_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in the training sequences."""
    return packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: Neither the network nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
