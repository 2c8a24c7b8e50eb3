"""The operators' queries with production parameters: whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (
    best_fit_packing,
    embedding_join,
    embedding_whitening,
    hash_tree_sharding,
    html_extraction,
    license_scan,
    ngram_join,
    phrase_mining,
    suffix_decontamination,
    token_records,
    tool_calls,
    toxicity,
    wordpiece_counts,
)

SHARDS, CAPACITY, WINDOW = 24, 2048, 13
WORD_BPE, WORD_END = "word_bpe_49k.json", 0
BYTE_BPE, BYTE_END, BYTE_IDS = "byte_bpe_50k.json", 2, 50_257


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, share = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, share).select(
        "doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree_sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.vector_components(table(spark, sf_dir, "embeddings"))


def op5_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece_counts.byte_pieces(public_tokenizers.path(WORD_BPE))
    return wordpiece_counts.token_counts(table(spark, sf_dir, "documents"), pieces, pieces)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.text_components(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return best_fit_packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), WORD_END, CAPACITY)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), BYTE_END, BYTE_IDS)


def op9_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = suffix_decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)
    return report.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                         F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The schema of the tool that conversations call.
ANSWER = {"answer": {"prompt": ("string", True), "turn": ("integer", True)}}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return tool_calls.link_tool_calls(*tool_calls.conversation_calls(turns), ANSWER, tool_calls.other_turns(turns))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"), least=10, longest=3, best=2000, share=50)


def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"), html_extraction.fit(html_extraction.labelled_pages(spark)))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_hash_tree_sharding, op4_embedding_range_join, op5_wordpiece_counts,
                            op6_ngram_jaccard_join, op7_best_fit_packing, op8_token_records, op9_suffix_decontamination,
                            op10_tool_calls, op11_phrase_collocations,
                            op12_html_main_text, op13_embedding_whitening)}
