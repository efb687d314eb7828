"""Arriving documents against the stored corpus: each micro-batch is matched, then joins the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lapwing.operators import shingles
from lapwing.operators.durable import durable

INDEX = "doc_id long, h long, n long, bucket int, batch long"
#: Ranges of hashes that the postings are dealt over, each in folders of its own.
BUCKETS = 256


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


def postings(spark: SparkSession, index: str, before: int, buckets: list[int]) -> DataFrame:
    """Stored postings of the batches ``before`` one in some ``buckets``; no folder of another one is read."""
    return _stored(spark, index, INDEX).where((F.col("batch") < before) & F.col("bucket").isin(buckets))


def screen_batch(batch: DataFrame, batch_id: int, index: str, matches: str, n: int = 5, share: float = shingles.LEAST_SHARE) -> None:
    """Match the documents ``doc_id, text`` of one micro-batch with all that came before them and with each other.

    Writes ``doc_id, source_id, shared, shingles`` and the batch's postings to
    folders of the batch's number, replaced when the batch is run again; a run
    only reads postings of earlier batches, so that it gives the same rows, and of
    these the ranges of hashes that its own documents have.
    """
    spark = batch.sparkSession
    lists = shingles.token_lists(batch)
    new = shingles.shingles(lists, n).select("doc_id", F.xxhash64("shingle").alias("h")).distinct()
    new = new.join(new.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    new = durable(new.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "postings", "bucket")
    new.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(index)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # `BUCKETS` numbers at most
    named = (F.col("doc_id").alias("source_id"), "h", F.col("n").alias("source_n"))
    old = postings(spark, index, batch_id, touched).select(*named)
    every = old.union(new.select(*named))
    hit = new.join(every, "h").where("source_id <> doc_id").groupBy("doc_id", "source_id").agg(F.count("*").alias("shared"), F.first("n").alias("shingles"), F.first("source_n").alias("source_n"))
    hit.where(F.col("shared") >= share * F.least("shingles", "source_n")).drop("source_n").write.mode("overwrite").parquet(f"{matches}/batch={batch_id}")


def screen_stream(arriving: DataFrame, index: str, matches: str, checkpoint: str, **options) -> StreamingQuery:
    """Start the job over the stream ``arriving(doc_id, text)``; ``index`` and ``matches`` are folders that all executors share."""
    run: Callable[[DataFrame, int], None] = lambda b, i: screen_batch(b, i, index, matches, **options)
    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_matches(spark: SparkSession, matches: str) -> DataFrame:
    return _stored(spark, matches, "batch int, doc_id long, source_id long, shared long, shingles long").drop("batch")
