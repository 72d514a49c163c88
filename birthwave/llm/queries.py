"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, embed, licences, mixing, negatives, pairwise, quality, simhash, substring, suffix, tokens, toxicity, trie
from .common import documents, stage_root
from .oracle import ORACLE  # noqa: F401


def op1_quality_rules(spark, sf_dir):
    cols = ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    return quality.score(documents(spark, sf_dir).select("doc_id", "text")).select(*cols)


def op2_byte_bpe(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)


def op3_toxicity_chain(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain).drop("text")


def op4_embedding_groups(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embed.near_duplicates(vectors).drop("embedding")


def op5_substring_dedup(spark, sf_dir):
    cut = substring.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op7_source_mix(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark, sf_dir):
    """With an empty cache of its own, so that every distinct text is encoded."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cache = f"{stage_root(spark)}/token-cache-{uuid.uuid4().hex}"
    return tokens.count(docs, public_tokenizers.path("byte_bpe_50k.json"), cache).drop("text")


def op9_suffix_dedup(spark, sf_dir):
    cut = suffix.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_license_scan(spark, sf_dir):
    cols = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    return licences.scan(documents(spark, sf_dir).select("doc_id", "text")).select(*cols)



def op11_pairwise_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learned = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    ranking = pairwise.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learned)
    held_out = F.coalesce(~learned, F.lit(False)).alias("held_out")
    return pairwise.score(docs, ranking).select("doc_id", held_out, "score", "predicted")


def op12_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_conversation_trie(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.node_table(trie.shared_starts(trie.spoken(turns)))


QUERIES = [op1_quality_rules, op2_byte_bpe, op3_toxicity_chain, op4_embedding_groups, op5_substring_dedup, op6_simhash_groups, op7_source_mix, op8_token_counts, op9_suffix_dedup, op10_license_scan, op11_pairwise_quality, op12_hard_negatives, op13_conversation_trie]
