"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import (
    extraction, imatch, jaccard, lexical_search, mixing, packing, prefix_trie, quality_rules, sharding, suffix_dedup, token_counts,
    toxicity, warc)
from emberframe.llm.common import read_table, stash

CAPACITY = 2048
SHARDS = 24
#: Target shares of the languages' tokens.
MIX = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: every third, by a checksum of the key, is held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), CAPACITY)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(read_table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown_by=1.0)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counts.select(F.col("id").alias("doc_id"), "n_pretokens", "n_tokens", F.round("score", 6).alias("score"))


def mix_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> mixing.DomainModel:
    """Labelled table: the languages of the documents that ``labels`` covers."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(
        read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").where(F.col("domain").isin(*MIX))
    return mixing.train_domains(docs, labelled)


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = mix_model(spark, docs, sf_dir)
    members = stash(mixing.membership(docs, model), "members")
    rated, _ = mixing.fit_rates(members, model.domains, MIX)
    return rated.select(
        F.col("id").alias("doc_id"), "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(model.domains)], "rate",
        mixing.copies(F.col("id"), F.col("rate")).alias("copies"), F.lit(mixing.residual(rated, model.domains, MIX)).alias("residual"))


def op5_zstd_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, read_table(spark, sf_dir, "pages"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, learnable(read_table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train_on(pages))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link_documents(read_table(spark, sf_dir, "documents"))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = prefix_trie.turn_sequences(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.share_heads(sequences))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), top=20)
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_rendezvous_sharding, op3_trie_token_counts, op4_soft_mixing, op5_zstd_archives, op6_imatch,
        op7_toxic_sentences, op8_quality_rules, op9_tree_extraction, op10_ngram_jaccard, op11_suffix_dedup, op12_prefix_trie, op13_lexical_search)}
