"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, divergence, html, katz, mixing, oracles, quality, simhash, substring, suffix_array, toxicity, trie, warc
from ._common import BENCHMARK, CONVERSATIONS, DOCUMENTS, LABELS, PAGES, read, shared_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", DOCUMENTS), read(spark, sf_dir, "labels", LABELS)
    held_out = toxicity.fold("doc_id", 3) == 1
    model = toxicity.learn(docs, labels.where(~held_out))
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(katz.fit(read(spark, sf_dir, "documents", DOCUMENTS), toxicity.fold("doc_id", 7) == 2))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.remove_repeats(read(spark, sf_dir, "documents", DOCUMENTS))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages", PAGES))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_later(read(spark, sf_dir, "documents", DOCUMENTS))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", DOCUMENTS))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents", DOCUMENTS))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents", DOCUMENTS), read(spark, sf_dir, "benchmark", BENCHMARK))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest columns need no payload, so none leaves the reader
    archives = warc.write_archives(warc.deduplicated(pages := read(spark, sf_dir, "pages", PAGES)), warc.train_dictionary(pages, "html"))
    records = warc.read_archives(archives, with_payload=False)
    return records.where(F.assert_true(F.col("error").isNull(), F.col("error")).isNull()).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to_id")).alias("refers_to")
    )


@query
def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", DOCUMENTS)
    return bpe.bpe_encode(docs, str(public_tokenizers.path("word_bpe_49k.json")), digests=True)


@query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", DOCUMENTS)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents", DOCUMENTS))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = shared_table(trie.ordered_turns(read(spark, sf_dir, "conversations", CONVERSATIONS)), "turns")
    return trie.prefix_trie(*trie.with_shared_heads(turns))


SQL |= {
    "op5_substring_dedup": oracles.SUBSTRING, "op7_quality_rules": oracles.QUALITY,
    "op8_benchmark_decontamination": oracles.CONTAMINATION, "op9_warc_round_trip": oracles.WARC,
    "op12_source_divergence": oracles.DIVERGENCE,
}
