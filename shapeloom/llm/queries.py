"""Queries of the training-data operators: thin wrappers that return what the contracts fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm import chat, decontaminate, language_model, mixing, oracles, quality, secrets, simhash, substrings, tokens, toxicity
from shapeloom.llm.common import documents, fold_of, new_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.assign_copies(documents(spark, sf_dir), mixing.text_size())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits to a new ledger, so that the second scans only blobs that the first has not seen."""
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), secrets.Ledger(spark, new_path(spark, "ledger"))
    early = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    ledger.commit(docs.where(early))
    ledger.commit(docs.where(~early))
    return secrets.digests(ledger.findings(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.deduplicate(documents(spark, sf_dir)))


PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(probe)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), fold_of(F.col("doc_id"), 7) == 2)


TOKENIZER = "word_bpe_49k.json"


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encoded(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0)))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted"))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_mixing": op2_mixing,
        "op3_secrets": op3_secrets,
        "op4_quality": op4_quality,
        "op5_substrings": op5_substrings,
        "op6_chat": op6_chat,
        "op7_decontaminate": op7_decontaminate,
        "op8_language_model": op8_language_model,
        "op9_tokens": op9_tokens,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": oracles.secrets_sql(), "op4_quality": oracles.quality_sql(), "op6_chat": oracles.chat_sql(PROBE)}
