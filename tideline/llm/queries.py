"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, byte_cnn, gru_toxicity, token_orc, tree_bpe
from .common import table
from .gemm_kmeans import centroid_clusters
from .licenses import license_blocks
from .mask_audit import audit
from .mixing import mix_sources
from .parity_join import similar_components
from .pii import private_digests
from .quality_mcd import quality
from .secrets import secret_digests
from .sql import ORACLES


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("lang", "source", "text_print")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents")).withColumn("changes", F.array_join("changes", "; "))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op4_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op5_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bitsliced.numbered(bitsliced.usable(table(spark, sf_dir, "embeddings")))
    return bitsliced.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.new_path(spark)
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.token_digests(spark, path)


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_digests(table(spark, sf_dir, "documents"))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_gemm_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, salt="2:")


def op12_mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gru_toxicity.score(docs, gru_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
