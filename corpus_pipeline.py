"""A corpus pipeline of five stages over documents; each takes what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import tree_bpe
from tideline.llm.common import bounded_batches, new_folder, remove, save, scratch, table
from tideline.llm.graph import first_of_each, without
from tideline.llm.mixing import mixed_documents
from tideline.llm.parity_join import similar_components
from tideline.llm.pii import sanitise
from tideline.llm.quality_mcd import quality

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80

#: Outliers, joins on 64-bit hashes and tokens are not for SQL; tests/llm holds run() against a plain Python version.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A row is known by id, text, language and source, as the same text may stand in another group."""
    bounded_batches(spark)
    with scratch(spark):
        rejected = save(quality(docs).where(~F.col("kept")).select("doc_id", "text_print", "lang", "source").distinct(), "rejected", keep=True)
    return without(docs, rejected)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Texts without words are no group and stay."""
    bounded_batches(spark)
    with scratch(spark):
        rows = save(similar_components(docs, SHINGLE, PERCENT).where("n_shingles > 0"), "grouped")
        stay = save(rows.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "text_print", "doc_id")).alias("s")).select(F.col("component").alias("_c"), F.col("s.doc_id").alias("_doc"), F.col("s.text_print").alias("_own")), "stay")
        told = rows.join(stay, F.col("component") == F.col("_c")).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_print") == F.col("_own")))
        go = save(told.where("not stays").select("doc_id", "text_print").distinct(), "go", keep=True)
        again = save(told.where("stays").groupBy("doc_id", "text_print").count().where("count > 1").select("doc_id", "text_print"), "again", keep=True)
    return first_of_each(without(docs, go), again)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values and the terms that reveal them are replaced."""
    bounded_batches(spark)
    return _sized(sanitise(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights' shares, to the word."""
    return _sized(mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row."""
    bounded_batches(spark)
    return tree_bpe.encode_and_check(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("source mixing", mixing), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. Each stage's tables go once its result is written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            folder = new_folder(spark, keep=True)
            after = stage(spark, docs, sf_dir)
            after.write.parquet(f"{folder}/{name.replace(' ', '_')}")
        docs = spark.read.schema(after.schema).parquet(f"{folder}/{name.replace(' ', '_')}")
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
