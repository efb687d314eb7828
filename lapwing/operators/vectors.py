"""Hashed subword vectors as sparse rows, and cosines of vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.functions.text import content_tokens, fnv1a_abs, js_round, stem, synonym
from lapwing.operators import meetings
from lapwing.operators.durable import durable

BUCKETS = 8192


def embed(texts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, bucket, w`` of unit length: stems of 3 letters or more weigh 3, synonym groups 5, each 4-gram of a token 0.4.

    Equal tokens are hashed once; a text without content tokens has no rows.
    """
    tok = texts.select(F.col(id_col).alias("id"), F.explode(content_tokens(F.col(text))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    t = F.col("token")
    grams = F.transform(F.when(F.length(t) >= 4, F.sequence(F.lit(1), F.length(t) - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.substring(t, i, F.lit(4)).alias("f"), F.lit(0.4).alias("w")))
    s, g = stem(t), synonym(t)
    none = F.array().cast("array<struct<f:string,w:double>>")
    parts = F.concat(F.when(F.length(s) >= 3, F.array(F.struct(s.alias("f"), F.lit(3.0).alias("w")))).otherwise(none), F.when(g.isNotNull(), F.array(F.struct(g.alias("f"), F.lit(5.0).alias("w")))).otherwise(none), grams)
    features = tok.select("token").distinct().select("token", F.explode(parts).alias("x")).select("token", (fnv1a_abs(F.col("x.f")) % BUCKETS).alias("bucket"), F.col("x.w").alias("w"))
    v = tok.join(features, "token").groupBy("id", "bucket").agg(F.sum(F.col("tf") * F.col("w")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # at most BUCKETS rows an id
    return v.select("id", "bucket", (F.col("w") / norm).alias("w"))


def cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_a, doc_b, semantic`` for given pairs; 0 where a side has no vector."""
    need = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    v = vectors.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("bucket", "w")).alias("v"))  # at most BUCKETS rows an id
    rows = need.join(v, "doc_id", "left").select("doc_id", F.col("v.bucket").cast("array<int>").alias("buckets"), F.col("v.w").alias("ws"))
    return meetings.in_tiles(pairs, durable(rows, "document-vectors"), meetings.cosines, "doc_a long, doc_b long, semantic double", 8192)


def dense_cosine(a: Column, b: Column) -> Column:
    """Of two dense unit vectors, in per cent; 0 if their lengths differ."""
    dot = _dot(a, b)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(js_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot)) * 100, 1))


def mean_pool(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, dim, w``: the mean of a key's dense vectors, scaled to unit length."""
    x = vectors.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.select(key, "dim", (F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))).alias("w"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def all_cosines(queries: DataFrame, vectors: DataFrame, of: int = 512, by: int = 4096) -> DataFrame:
    """``query_id, vec_id, semantic`` of each of ``queries(vec_id, embedding)`` with every vector of another id, in per cent.

    Both sides are dealt over blocks by hash, about ``of`` queries and ``by`` vectors, and a task
    multiplies one block of each, so that its memory does not grow with the tables.  Of unequal
    lengths the common dimensions count; a null element, or a vector that is null, counts as zero.
    """
    def similarities(queries, vectors):
        """Of one block of queries and one of vectors, as Arrow tables; products are summed in the order of the dimensions."""
        import numpy as np
        import pyarrow as pa

        def ids(table, name):
            return table.column(name).to_numpy()

        def dense(column):
            rows = [[x or 0.0 for x in v] if v else [] for v in column.to_pylist()]
            out = np.zeros((len(rows), max(map(len, rows), default=0)))
            for row, v in zip(out, rows, strict=True):
                row[: len(v)] = v
            return out

        if not queries.num_rows or not vectors.num_rows:  # an empty side has no columns
            return pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("semantic", pa.float64())]).empty_table()
        q, v = dense(queries.column("q")), dense(vectors.column("v")).T.copy()
        of, to, found = ids(queries, "query_id"), ids(vectors, "vec_id"), []
        for i in range(0, len(q), 16):
            dot = np.zeros((len(q[i : i + 16]), len(to)))
            for k in range(min(q.shape[1], len(v))):
                dot += q[i : i + 16, k, None] * v[k]
            semantic = np.floor(np.clip(dot, 0.0, 1.0) * 100 * 10 + 0.5) / 10
            other = of[i : i + 16, None] != to
            found.append(pa.table({"query_id": np.repeat(of[i : i + 16], other.sum(axis=1)), "vec_id": np.broadcast_to(to, other.shape)[other], "semantic": semantic[other]}))
        return pa.concat_tables(found)

    n = max(1, math.ceil(queries.count() / of))
    m = max(1, math.ceil(vectors.count() / by))

    def block(name, count):
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(name)

    def every(name, count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    real = F.col("vec_id").isNotNull()
    q = queries.where(real).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"), block("of", n), every("by", m))
    v = vectors.where(real).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), block("by", m), every("of", n))
    return q.groupBy("of", "by").cogroup(v.groupBy("of", "by")).applyInArrow(similarities, "query_id long, vec_id long, semantic double")


#: What rounding may add to distances of unit vectors, whose squares are exact to some millionths.
_SLACK = 5e-3


class VectorIndex:
    """Exact search by similarity among unit vectors ``vec_id, embedding``.

    Each vector belongs to the nearest of at most ``pivots`` vectors, picked by hash,
    and keeps its distance to it.  The triangle inequality tells of a query which
    pivots' vectors, and which of these, can be as near as the ``k`` nearest that
    the query's own pivots give; only they are compared.  A pivot's vectors are
    dealt over blocks, so that no pivot is a task of its own.
    """

    def __init__(self, vectors: DataFrame, pivots: int = 256, block: int = 4096):
        n = vectors.count()
        few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(pivots, math.isqrt(n))))
        one = few.agg(F.collect_list(F.struct(F.col("vec_id").alias("pivot"), "embedding")).alias("pivots"))  # `pivots` vectors at most
        self.pivots = durable(one, "pivots")
        v = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(self.pivots))  # one row
        near = F.array_max(F.transform("pivots", lambda p: F.struct(_dot(F.col("embedding"), p["embedding"]).alias("dot"), p["pivot"].alias("pivot"))))
        v = durable(v.select("vec_id", "embedding", near.alias("near")), "near").select("vec_id", "embedding", F.col("near.pivot").alias("pivot"), _distance(F.col("near.dot")).alias("away"))
        size = v.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("away").alias("inner"), F.max("away").alias("outer"))
        self.cells = durable(size, "cells")
        v = v.join(self.cells.select("pivot", "blocks"), "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        self.vectors = durable(v, "vectors", "pivot", "block")

    def _met(self, visits: DataFrame) -> DataFrame:
        """``query_id, vec_id, dot`` of ``visits(query_id, q, pivot, away, bound)``: vectors of these pivots that the bound admits."""
        x = visits.join(self.cells.select("pivot", "blocks"), "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        v = self.vectors.withColumnRenamed("away", "v_away")
        x = x.join(v, ["pivot", "block"]).where((F.col("query_id") != F.col("vec_id")) & (F.abs(F.col("away") - F.col("v_away")) <= F.col("bound") + _SLACK))
        return x.select("query_id", "vec_id", _dot(F.col("q"), F.col("embedding")).alias("dot"))

    def search(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """The ``k`` nearest other vectors of each of ``queries(vec_id, embedding)``: ``query_id, vec_id, semantic, rank``; and
        ``query_id, scored``, with how many each was compared.

        Nearest first, of equal ones the smaller id.  Queries of another length than the vectors' find nothing.
        """
        q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).crossJoin(F.broadcast(self.pivots))  # one row
        q = q.select("query_id", "q", F.explode(F.transform("pivots", lambda p: F.struct(p["pivot"].alias("pivot"), _distance(_dot(F.col("q"), p["embedding"])).alias("away")))).alias("p"))
        q = q.select("query_id", "q", "p.*").join(F.broadcast(self.cells.select("pivot", "inner", "outer")), "pivot")  # a row a pivot
        q = durable(q.withColumn("least", F.greatest(F.lit(0.0), F.col("away") - F.col("outer"), F.col("inner") - F.col("away"))), "queries")
        order = Window.partitionBy("query_id").orderBy("away", "pivot")  # a row a pivot
        first = q.withColumn("nth", F.row_number().over(order)).where("nth <= 2").withColumn("bound", F.lit(2.0))
        best = Window.partitionBy("query_id").orderBy(F.desc("dot"), "vec_id")
        seen = self._met(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        bound = seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max(_distance(F.col("dot")))).otherwise(2.0).alias("bound"))
        left = q.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0))).where(F.col("least") <= F.col("bound") + _SLACK)
        met = durable(self._met(left), "compared")
        found = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        semantic = js_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot"))) * 100, 1)
        return found.select("query_id", "vec_id", semantic.alias("semantic"), "rank"), met.groupBy("query_id").agg(F.count("*").alias("scored"))


def _distance(dot: Column) -> Column:
    """Of unit vectors with this dot product."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def embed_distinct(texts: DataFrame, id_col: str, text: str, batch) -> DataFrame:
    """``id, vector`` by a supplied Arrow batch function of texts; each distinct text is embedded once.

    ``batch``: a list of texts to a list of float lists, called with 16 texts at a time.
    """
    size = 16

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.column("text").to_pylist()
            out = [v for a in range(0, len(rows), size) for v in batch(rows[a : a + size])]
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(out, pa.list_(pa.float32()))], names=["text", "vector"])

    t = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = t.select("text").distinct().mapInArrow(run, "text string, vector array<float>")
    return t.join(made, "text").select("id", "vector")
