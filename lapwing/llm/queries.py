"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.decontaminate import contamination
from lapwing.llm.html_text import main_text
from lapwing.llm.language_model import scores
from lapwing.llm.line_quality import quality_rules
from lapwing.llm.merkle import document_proofs
from lapwing.llm.mixing import Mixture
from lapwing.llm.near_dedup import near_duplicates
from lapwing.llm.prefix_trie import prefix_trie
from lapwing.llm.quality import quality
from lapwing.llm.sharding import balanced_shards
from lapwing.llm.token_ids import token_files
from lapwing.llm.tool_calls import calls_of_turns, chat_schemas, link_tool_calls
from lapwing.llm.toxicity import fit_toxicity, toxicity

#: The vocabulary of op8; its folder is that of the public vocabulary package.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents")).by_document().select("doc_id", "size", "source_size", "target", "taken")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no remainder: its ``held_out`` is null, and its text is scored."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    scored = toxicity(docs, fit_toxicity(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def op7_quality_rules_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no remainder: its ``held_out`` is null, and its text is scored."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = quality(docs, labels, ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary())


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no tool calls: each user turn stands for a call, each assistant turn for the result of the turn before."""
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, chat_schemas(spark)).withColumn("errors", F.array_join("errors", ";"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no remainder: its row is not tampered with."""
    return document_proofs(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of a negative ``conv_id`` is that of SQL's remainder, which has the sign of the id."""
    c = F.col("conv_id")
    return prefix_trie(table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string")) % 9, 8)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no remainder: its ``held_out`` is null, and its text is scored but not learnt from."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    x = scores(table(spark, sf_dir, "documents"), ~held_out)
    return x.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_line_quality": op4_line_quality,
    "op5_toxicity": op5_toxicity,
    "op6_balanced_sharding": op6_balanced_sharding,
    "op7_quality_rules_ensemble": op7_quality_rules_ensemble,
    "op8_token_files": op8_token_files,
    "op9_tool_call_linking": op9_tool_call_linking,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_language_model": op13_language_model,
}
