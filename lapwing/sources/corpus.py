"""The corpus of source documents: scans of providers, one normalised record, exact copies, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.functions import text as t

#: Columns of the normalised record.
RECORD = ("source_id", "provider", "source_type", "title", "author", "url", "domain", "text", "checksum", "institution_id", "course_id", "assignment_id", "student_id")


def indexed(docs: DataFrame) -> DataFrame:
    """Documents that have a text, white space aside."""
    return docs.where(F.length(t.strip_space(F.col("text"))) > 0)


def of_types(sources: DataFrame, *types: str) -> DataFrame:
    return sources.where(F.col("source_type").isin(*types))


def peer_records(submissions: DataFrame) -> DataFrame:
    """Submissions ``submission_id, student_name, roll, text, ...`` in the shape of sources; those without a text are left out."""
    shaped = {
        "source_id": F.col("submission_id").cast("string"),
        "provider": F.lit("internal"),
        "source_type": F.lit("student_submission"),
        "title": F.concat(F.lit("Submission by "), F.col("roll"), F.lit(" ("), F.col("student_name"), F.lit(")")),
        "author": F.col("student_name"),
        "url": F.concat(F.lit("internal://submissions/"), F.col("submission_id").cast("string")),
    }
    return indexed(submissions).withColumns(shaped).drop("submission_id", "student_name", "roll")


def union_sources(*ranked: DataFrame) -> DataFrame:
    """Sources of several providers, in their order, as normalised records; columns that one lacks are null."""
    out = None
    for rank, df in enumerate(ranked):
        df = df.withColumn("provider_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    have = set(out.columns)
    out = out.withColumn("checksum", F.coalesce(*([F.col("checksum")] if "checksum" in have else []), t.checksum(F.col("text"))))
    out = out.withColumn("domain", F.coalesce(*([F.col("domain")] if "domain" in have else []), t.url_host(F.col("url"))))
    return out.select("provider_rank", *[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in RECORD])


def exact_copies(docs: DataFrame, order: list[Column]) -> DataFrame:
    """``docs`` with ``copy_of``: the first document, in ``order``, of those whose text is equal but for white space; null for that one itself.

    The first of a group is found by an aggregate, so a group of any size needs no task of its own.
    """
    x = docs.withColumn("checksum", t.checksum(F.col("text")))
    first = x.groupBy("checksum").agg(F.min_by("doc_id", F.struct(*order)).alias("first_id"))
    return x.join(first, "checksum", "left").withColumn("copy_of", F.when(F.col("first_id") != F.col("doc_id"), F.col("first_id"))).drop("first_id")


def lookup(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """``key`` and the source that it names by id, else by checksum, else by code, case aside."""
    k = keys.select("key", F.lower("key").alias("k")).distinct()
    legs = [sources.select(F.lower(F.col(c).cast("string")).alias("k"), "source_id", F.lit(i).alias("by")) for i, c in enumerate(("source_id", "checksum", "code")) if c in sources.columns]
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    return k.join(every, "k").groupBy("key").agg(F.min_by("source_id", F.struct("by", "source_id")).alias("source_id"), F.min("by").alias("by"))


def screened(docs: DataFrame, least: int = 15) -> DataFrame:
    """Every document with the status that ingest gives it and, of rejected ones, why: bad rows never end a job."""
    reason = F.when(F.col("text").isNull(), "no text").when(F.length(t.strip_space(t.clean_input(F.col("text")))) < least, "too short")
    return docs.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "indexed").otherwise("quarantined"))


def provider_health(providers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of every provider, those without any included."""
    n = sources.groupBy("provider").agg(F.count("*").alias("n_sources"))
    x = providers.join(n, "provider", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("long")))
    return x.withColumn("available", F.col("n_sources") > 0)


def capped(candidates: DataFrame, query: str, order: list[Column], k: int, per_provider: dict[str, int] | None = None) -> DataFrame:
    """The ``k`` best candidates of each query, of each provider no more than its own limit: a top-k report."""
    if per_provider:
        limit = F.create_map(*[F.lit(v) for kv in per_provider.items() for v in kv])
        mine = F.row_number().over(Window.partitionBy(query, "provider").orderBy(*order))
        candidates = candidates.withColumn("_n", mine).where(F.col("_n") <= F.coalesce(F.try_element_at(limit, F.col("provider")), F.lit(k))).drop("_n")
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)
