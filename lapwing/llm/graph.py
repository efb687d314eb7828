"""Connected components of an undirected graph, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import cut


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (smallest reachable node) for every node on an edge.

    Large-star and small-star steps alternate until the edge set is stable: a
    number of rounds logarithmic in the longest path.  Hot nodes are joined to
    their minimum, never gathered into a list.  Loops and nulls are ignored.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    e, mark = _settled(e)
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours hang on the smallest one
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours hang on the smallest one
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("a"), "m", "u")
        e = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e = e.select("x.u", "x.v").where("u <> v").distinct()
        e, now = _settled(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = cut(e, "edges")
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return e, (r["n"], r["h"])
