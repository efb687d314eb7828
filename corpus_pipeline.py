"""From raw documents to mixed, tokenised training data, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import cut, row_key, rows_of
from lapwing.llm.decontaminate import contamination
from lapwing.llm.mixing import Mixture
from lapwing.llm.near_dedup import near_duplicates
from lapwing.llm.queries import table, vocabulary
from lapwing.llm.token_ids import token_files
from lapwing.llm.toxicity import fit_toxicity, without_toxic


#: Per cent of common shingles from which documents are near duplicates, and samples in a band.
SIMILARITY, ROWS = 80, 7


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, row``: the rows of ``docs`` in one column, so that their own columns may have any names."""
    return docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_key` is in the one column of ``keys``."""
    return _keyed(docs).join(keys.toDF("key").distinct(), "key", "left_semi").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts are scored like others, repeated rows alike."""
    labels = table(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    return without_toxic(docs, fit_toxicity(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest id, null being the largest.

    Rows are judged apart, so rows that share an id or have none are too.
    Texts without words are linked with nothing and stay.
    """
    rows = docs.select(row_key().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near_duplicates(rows.select(F.col("rk").alias("doc_id"), "text"), SIMILARITY, 100, rows=ROWS)
    # rows of equal keys are equal in all that is given here, so that joins need one of each
    found = found.groupBy(F.col("doc_id").alias("rk")).agg(F.first("component_id").alias("component"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    ids = rows.groupBy("rk").agg(F.first("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", (F.when(F.col("n_shingles") > 0, F.col("n")).otherwise(1) > 1).alias("again")))
    stay = cut(found.join(ids, "rk").groupBy("component").agg(first.alias("c")).select("c.rk", "c.again"), "stay")
    once = _only(docs, stay.where("not again").select("rk"))
    again = rows_of(_keyed(docs), "key", stay.where("again").select("rk")).dropDuplicates(["key"]).select("row.*")
    return once.union(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and wordless texts hold none and stay, and rows of one id are judged apart."""
    return _only(docs, contamination(docs, table(spark, sf_dir, "benchmark"), key=True).where("not contaminated").select("rk"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them; those of which it takes none, null and wordless ones among them, are left out.

    A null source is one like others.  Repeated rows are each packed.
    """
    out = Mixture(docs).texts(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and what they hold of each document: ids ascending, null first, repeated ids by text."""
    return token_files(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token files", token_stage),
]

#: The classifier and the pseudorandom mix are outside SQL; tests hold the stages that drop near duplicates and contaminated rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
