"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, fingerprint, hnsw, minhash, mixing, packing, pii, sharding, suffix_tree, token_files, toxicity, trie
from .common import documents, remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    held_out = remainder(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"), "windows", "hits")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 5) == 1)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(documents(spark, sf_dir))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1, path)
    return token_files.checked(token_files.read(spark, path))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(documents(spark, sf_dir)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    own = (op1_byte_bpe, op2_sharding, op3_toxicity, op4_suffix_tree, op5_fingerprint, op6_hnsw, op7_minhash, op8_token_files, op9_packing, op10_personal_data, op11_prefix_trie, op12_mixing, op13_alignment)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {}
