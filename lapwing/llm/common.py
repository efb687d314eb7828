"""Helpers shared by the operators: durable cut points and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a machine-local folder is made if driver and
    executors are one process (tests, the benchmark); a cluster must have it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at durable files, so a lost executor costs one task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """``df`` if it has ``most`` rows at most, else the ``most`` rows of the smallest hashes of ``key``.

    Only rows whose hash is small enough to count are sorted, so that what
    reaches one task follows ``most``, not ``df``, which is read twice.
    """
    n = df.count()
    if n <= most:
        return df
    h = F.xxhash64(*key)
    share = min(1.0, (most + 8 * most**0.5 + 64) / n)
    return df.where(h <= F.lit(int(share * (1 << 64)) - (1 << 63) - (share == 1))).orderBy(h, *key).limit(most)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number for a row's id and text: rows that only share one of them, or a null id, differ."""
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return F.xxhash64(F.coalesce(i, F.lit(-1)), i.isNull(), t, t.isNull())


def rank_in_groups(df: DataFrame, groups: list[str], order: list[Column], spread: list[str], out: str, weight: Column | None = None, bucket: Column | None = None, per_bucket: int = 20_000) -> DataFrame:
    """Gapless position (or running weight before the row) of each row in its group.

    A group of any size is dealt over hash buckets: positions are counted in
    each bucket and shifted by the sums of the buckets before it, so no task
    holds a whole group.  The order is (bucket, ``order``): pseudorandom by
    ``spread`` but the same in every run; a ``bucket`` that rises with ``order``
    gives that order itself.  ``df`` should be durable, since it is read twice.
    """
    if bucket is None:
        bucket = F.pmod(F.xxhash64(*spread, F.lit(71)), F.lit(max(1, -(-df.count() // per_bucket))))
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    x = df.withColumn("_b", bucket).withColumn("_w", w)
    sums = x.groupBy(*groups, "_b").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0).cast("long"))).drop("_s")
    inside = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0).cast("long")))
    on = [x[g].eqNullSafe(sums[g]) for g in groups] + [x["_b"].eqNullSafe(sums["_b"])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    keep = [x[c] for c in df.columns]
    return x.join(sums, cond).select(*keep, (x["_in"] + sums["_base"]).alias(out))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over all rows before each one in ``order``, which must tell rows apart.

    Rows are dealt by ranges of ``order`` and made durable; sums inside a range
    are shifted by those of the ranges before it, so no task holds all rows.
    """
    x = df.select("*", *[v.alias(f"_{k}") for k, v in sums.items()]).repartitionByRange(*order)
    x = cut(x.withColumn("_range", F.spark_partition_id()), "ranges")
    whole = x.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    whole = whole.select("_range", *[F.coalesce(F.sum(f"_{k}").over(up), F.lit(0)).alias(f"_base_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(*df.columns, "_range", *[F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)).alias(f"_{k}") for k in sums])
    return x.join(F.broadcast(whole), "_range").select(*df.columns, *[(F.col(f"_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])


#: Bits of the filter below: 512 rows of 4 KB, whatever it is made from.
FILTER_BITS = 1 << 24


def rows_of(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of a wide ``df`` whose ``key`` is in the one column of ``ids``.

    A bitmap of fixed size over the ids' hashes is broadcast and drops nearly all
    other rows before the join that decides: only rows that count are shuffled.
    """
    i = ids.columns[0]

    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    bits = ids.select(F.shiftright(slot(i), 15).alias("_part"), slot(i).bitwiseAND(32767).alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    at = slot(key).bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = df.withColumn("_part", F.shiftright(slot(key), 15)).join(F.broadcast(bits), "_part").where(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1)
    return likely.select(*df.columns).join(ids.select(F.col(i).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")
