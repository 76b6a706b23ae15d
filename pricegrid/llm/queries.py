"""The operators as queries over the given tables, with production parameters, and the checking SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm import decontam, exactdup, htmltext, language, mixing, neardup, negatives, quality, repeats, secrets, shards, tokens, turns
from pricegrid.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_linked_secrets")
def _(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op2_quality_classifier")
def _(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(texts, table(spark, sf_dir, "labels")).drop("text")


@query("op3_near_duplicates")
def _(spark, sf_dir):
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


@query("op4_byte_shards")
def _(spark, sf_dir):
    cut = shards.byte_shards(table(spark, sf_dir, "documents"), 24)
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op5_benchmark_decontamination", decontam.ORACLE)
def _(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(texts, table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", named, "contaminated")


@query("op7_source_mix")
def _(spark, sf_dir):
    rows = mixing.measured(table(spark, sf_dir, "documents")).drop("text", "lang", "n_chars")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


@query("op8_exact_duplicates", exactdup.ORACLE)
def _(spark, sf_dir):
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op9_main_text")
def _(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op10_repeated_strings", repeats.ORACLE)
def _(spark, sf_dir):
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_token_blocks")
def _(spark, sf_dir):
    return tokens.token_rows(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op11_language")
def _(spark, sf_dir):
    found = language.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op13_conversation_repair", turns.ORACLE)
def _(spark, sf_dir):
    return turns.repaired(turns.damaged(table(spark, sf_dir, "conversations")))


@query("op12_hard_negatives", negatives.ORACLE)
def _(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
