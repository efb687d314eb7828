"""Stage tables: results that several steps read are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and driver and executors are one process, a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def durable(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder, dealt by ``by`` if given, and read back: its plan ends here, and a lost executor costs a task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(*by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
