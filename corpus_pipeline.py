"""From raw documents to token blocks: the corpus operators as stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm import decontam, mixing, neardup, quality, tokens
from pricegrid.llm.common import aside, restored, shared_folder, table
from pricegrid.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels that are not held out."""
    scored = quality.classify(aside(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return restored(scored.filter("predicted = 1"), docs.columns, "doc_id", "text")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id."""
    return neardup.deduplicated(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words: not at all, once or twice.

    A document that the end of a source's target cuts is there if at least half of its words are taken. One without
    words takes part once.
    """
    mix = mixing.mix(mixing.measured(aside(docs, "doc_id", "text", "source")))
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    repeats = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return restored(mix.select("*", repeats.alias("_time")), docs.columns, "doc_id", "text", "source")


def token_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token blocks, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_rows(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("source mix", mixed_documents),
    ("token blocks", token_documents),
]

#: SQL cannot train a classifier or run a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
