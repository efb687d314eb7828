"""Ingest: profiles, screens and shapes of incoming documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions import text as t

MAX_BYTES = 25 * 1024 * 1024
#: Accepted extensions and their media types; the last ones have none of their own.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".py": "text/x-python",
    ".cpp": "text/x-c",
    ".c": "text/x-c",
    ".h": "text/x-c",
    ".java": "text/x-java-source",
    ".js": "application/octet-stream",
    ".ts": "application/octet-stream",
}


def document_profile(docs: DataFrame, least: int = 15, words_per_page: int = 450) -> DataFrame:
    """Word and page counts, checksum, snippet, and ``failed`` for texts that are too short to analyse."""
    s = t.strip_space(F.col("text"))
    n = F.size(F.filter(F.split(s, r"\s+"), lambda x: x != ""))
    return docs.select("doc_id", n.cast("long").alias("word_count"), F.greatest(F.lit(1), F.ceil(n / words_per_page)).cast("long").alias("page_count"), F.when(F.length(s) < least, "failed").otherwise("ok").alias("status"), t.checksum(F.col("text")).alias("checksum"), t.snippet(F.col("text")).alias("snippet"))


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, size, reason, media_type`` of every file below a folder, from its listing: no content is read.  Spark lists no empty files."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    x = x.select("path", name.alias("name"), F.col("length").alias("size"))
    return x.select("*", reject_reason(F.col("name"), F.col("size")).alias("reason"), media_type(F.col("name")).alias("media_type"))


def reject_reason(name: Column, size: Column, types: tuple[str, ...] = tuple(MEDIA_TYPES)) -> Column:
    """Why a file is not taken: ``too_large``, ``empty``, ``type``; null if it is."""
    n = F.lower(name)
    known = F.lit(False)
    for ext in types:
        known = known | n.endswith(ext)
    return F.when(size > MAX_BYTES, "too_large").when(size == 0, "empty").when(~F.coalesce(known, F.lit(False)), "type")


def media_type(name: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in reversed(MEDIA_TYPES.items()):
        out = F.when(F.lower(name).endswith(ext), kind).otherwise(out)
    return out
