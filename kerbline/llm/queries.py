"""The opN queries: thin calls of the operators over the whole tables, with the digest columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import alignment, chat_format, common, decontaminate, line_dedup, lm_score, packing, pii, quality_rules, simhash, token_counts, token_shards, toxicity, whitening

#: The contract's planted conversation: both turns hold control strings.
PLANTED = "VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def vocabulary() -> tuple[str, str]:
    """One public vocabulary, as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digest(turns.unionByName(spark.sql(f"SELECT * FROM {PLANTED}")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.documents(spark, sf_dir))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.report(common.documents(spark, sf_dir), vocabulary())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(common.documents(spark, sf_dir), vocabulary())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_counts(common.documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), *vocabulary())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(common.documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(common.documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(common.documents(spark, sf_dir), vocabulary()[0])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.report(common.documents(spark, sf_dir), *vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_token_shards": op4_token_shards,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_score": op6_lm_score,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}
