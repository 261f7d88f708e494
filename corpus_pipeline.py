"""Corpus preparation in five stages, each written as Parquet and read again as the next one's documents.

toxicity: documents at or above their language's threshold go. near_duplicates: of each group of near copies the
smallest id stays. pii: entities become surrogates, n_chars follows the text. mix: whole documents in the order of the
mix's slots, until each source has its target. pack: the pieces of fixed-size sequences.

Defined cases: nulls, empty and very long texts, repeated rows and ties are those of the operators; an empty table gives
no rows; other columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, near_dup, packing, pii, queries, toxicity
from millrace.llm._common import materialise, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (score,) = unused(docs.columns, "_score")
    model, limits = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~queries.held_out()))
    scored = toxicity.with_scores(docs, model, score)
    return scored.where(~toxicity.toxic_flag(F.col(score), F.col("lang"), limits)).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (count,) = unused(docs.columns, "n_entities")
    done = pii.replace_pii(docs, queries.PII_KEY, count=count)
    n_chars = F.when(F.col(count) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_with_crc(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: Classifier, signatures, tokenizer and keyed digests have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
