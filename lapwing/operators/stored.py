"""A stored table that is kept by key: batches rewrite only the parts that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from lapwing.operators.durable import durable

#: Parts of a table.
BUCKETS = 64


class KeyedTable:
    """Rows of ``schema`` in the folder ``path``, one a key, dealt over parts by a hash of ``by`` (some of the keys).

    ``upsert`` reads the newest version of the parts that its rows fall in and writes
    new ones under its own version number; readers take each part's newest. A version
    that is written again only reads older ones and replaces its own, so a batch that
    failed can be offered again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.bucket = F.pmod(F.xxhash64(*(by or keys)), F.lit(buckets)).cast("int")

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The table as it is, or as it was ``before`` a version; some of its parts if asked."""
        try:
            x = self.spark.read.schema(f"{self.schema}, bucket int, version long").parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], self.schema)
        if before is not None:
            x = x.where(F.col("version") < before)
        if parts is not None:
            x = x.where(F.col("bucket").isin(parts))
        last = x.groupBy("bucket").agg(F.max("version").alias("version"))
        return x.join(F.broadcast(last), ["bucket", "version"]).drop("bucket", "version")  # a row a part

    def upsert(self, rows: DataFrame, order: list[Column], version: int) -> None:
        """Of old and new rows of a key the first in ``order`` stays; of equal ones the new."""
        old_columns = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        new = durable(rows.select(*old_columns), "rows")
        touched = [r[0] for r in new.select(self.bucket).distinct().collect()]  # `buckets` numbers at most
        old = self.read(version, touched).select(*old_columns)
        every = old.withColumn("_old", F.lit(1)).union(new.withColumn("_old", F.lit(0)))
        first = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order, "_old"))
        merged = every.withColumn("_n", first).where("_n = 1").select(*old_columns)
        merged = merged.withColumn("bucket", self.bucket).withColumn("version", F.lit(version).cast("long")).repartition("bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
