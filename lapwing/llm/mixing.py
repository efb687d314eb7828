"""Mixing sources to target weights over packed blocks.

Each source is packed into blocks of a fixed number of words.  The words to
take of a source are whole passes over its blocks and part of one more, which
gives it as many slots, and tickets of one urn.  Each output shard draws its
slots from the urn, so its counts by source are a multinomial draw, conditioned
on totals that meet the targets; a shard's slots of a source are the next ones of
that source.  A keyed permutation for each pass of a source maps slots to its
blocks, and slots and blocks are joined by that index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lapwing.llm import bytewords as bw
from lapwing.llm.common import cut, rank_in_groups, running_sums

WEIGHTS = (3, 1, 2)
#: Words in a block and in an output shard.
BLOCK, SHARD_WORDS = 1024, 1 << 20
SHARE, MOST = 1.5, 2
SEED = 20240229


def _sizes(batches):
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        for a, b, buf, offs in bw.chunks(batch.column("text")):
            w = bw.SPACED[buf]
            first = w.copy()
            first[1:] &= ~w[:-1]
            inner = offs[:-1][(offs[:-1] > 0) & (offs[:-1] < len(buf))]
            first[inner] = w[inner]
            edge = np.concatenate([[0], np.cumsum(first)])
            out[a:b] = edge[offs[1:]] - edge[offs[:-1]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("tk"), pa.array(out)], names=["doc_id", "source", "tk", "size"])


@F.pandas_udf(T.LongType())
def permuted(index: pd.Series, key: pd.Series, n: pd.Series) -> pd.Series:
    """``index`` under the ``key``-th pseudorandom permutation of 0 .. n-1: a Feistel network, walked until it falls in range."""
    x, k, n = index.to_numpy().astype(np.uint64), bw.mix(key.to_numpy().astype(np.uint64)), n.to_numpy().astype(np.uint64)
    half = np.array([(max(int(v) - 1, 1).bit_length() + 1) // 2 for v in n], dtype=np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    turns = bw.mix(np.arange(1, 5))
    todo = np.arange(len(x))
    while len(todo):
        a, b, h, m, q = x[todo] >> half[todo], x[todo] & low[todo], half[todo], low[todo], k[todo]
        for r in range(4):
            a, b = b, a ^ (bw.mix(b + q + turns[r]) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo]]
    return pd.Series(x.astype(np.int64))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words by weight, none above ``most`` times its own.

    Sources in code-point order, null last, take the weights in turn.  A capped
    source's excess is shared by weight among the others until none is above:
    then all uncapped ones stand at the same level of words per weight, which
    running sums in the order of each source's own cap give at once.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # a row per source
    name = F.col("source").asc_nulls_last()
    s = running_sums(s, [name], {"turn": F.lit(1).cast("long")})
    s = s.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[(F.col("turn") % len(weights)).cast("int")]).withColumn("cap", most * F.col("source_size").cast("double"))
    s = running_sums(s.withColumn("height", F.col("cap") / F.col("w")), [F.col("height"), name], {"below": F.col("cap"), "lighter": F.col("w")})
    s = s.crossJoin(F.broadcast(s.agg((F.sum("source_size") * F.lit(share)).alias("share"), F.sum("w").alias("weights"))))  # one row
    s = s.withColumn("level", (F.col("share") - F.col("below")) / (F.col("weights") - F.col("lighter")))
    level = s.agg(F.coalesce(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))), F.lit(float("inf"))).alias("top"))
    return s.crossJoin(F.broadcast(level)).select("source", "source_size", F.least("cap", F.col("top") * F.col("w")).alias("target"))


class Mixture:
    """The mix of ``docs(doc_id, text, source)``; each part is durable once made.

    ``packed``: doc_id, source, tk, size, start (of its words in its source).
    ``targets``: source, source_size, target.  ``slots``: shard, source, pass,
    block, words.  ``counts``: shard, source, slots, words.  ``pieces``: of each slot's block the runs of words of each
    document: shard, source, pass, doc_id, tk, start, first, last (exclusive,
    counted in the document).
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS):
        x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))
        sizes = cut(x.mapInArrow(_sizes, "doc_id long, source string, tk long, size long"), "sizes")
        self.packed = cut(rank_in_groups(sizes, ["source"], [F.col("doc_id"), F.col("tk")], ["doc_id", "tk"], "start", F.col("size")), "packed")
        self.targets = cut(source_targets(sizes, weights, share, most), "targets")
        self.slots = self._slots(block, seed, shard_words)
        self.counts = self.slots.groupBy("shard", "source").agg(F.count("*").alias("slots"), F.sum("words").alias("words"))
        last = F.col("start") + F.col("size")
        cell = self.packed.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((last - 1) / block))).alias("block"))
        s = self.slots.select("shard", F.col("source").alias("_s"), "pass", F.col("block").alias("_b"), "words")
        met = cell.join(s, (F.col("block") == F.col("_b")) & cell["source"].eqNullSafe(s["_s"]))
        first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
        end = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
        self.pieces = cut(met.select("shard", "source", "pass", "doc_id", "tk", "start", first.alias("first"), end.alias("last")).where("last > first"), "pieces")

    def _slots(self, block: int, seed: int, shard_words: int) -> DataFrame:
        t = self.targets.where("source_size > 0")
        take = F.round("target").cast("long")
        t = t.withColumn("whole", F.floor(take / F.col("source_size"))).withColumn("part", take - F.floor(take / F.col("source_size")) * F.col("source_size"))
        t = t.withColumn("full", F.floor(F.col("source_size") / block))  # blocks that are full
        t = t.withColumn("n", F.ceil(F.col("source_size") / block)).withColumn("rest", F.col("source_size") - F.col("full") * block)
        t = t.withColumn("tickets", F.col("whole") * F.col("n") + F.ceil(F.col("part") / block))
        t = cut(running_sums(t, [F.col("source").asc_nulls_last()], {"first": F.col("tickets")}), "tickets")
        urn = t.agg(F.sum("tickets")).first()[0] or 0
        per_shard = max(1, shard_words // block)
        p = t.select("*", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("pass"))
        # slots of a pass: every block of a whole pass; of the last one, the blocks that hold `part` words
        p = p.withColumn("used", F.when(F.col("pass") < F.col("whole"), F.col("n")).otherwise(F.ceil(F.col("part") / block))).where("used > 0")
        step = 1 << 14
        p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("used") - 1, F.lit(step))).alias("lo")).repartition("source", "pass", "lo")
        p = p.select("*", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + step, F.col("used")) - 1)).alias("slot"))
        key = F.xxhash64("source", "pass", F.lit(seed))
        # full blocks are permuted; a source's short last block takes the last slot
        p = p.withColumn("block", F.when(F.col("slot") < F.col("full"), permuted(F.when(F.col("slot") < F.col("full"), F.col("slot")).otherwise(0), key, F.greatest("full", F.lit(1)))).otherwise(F.col("full")))
        have = F.when(F.col("slot") < F.col("full"), F.lit(block)).otherwise(F.col("rest"))
        words = F.when(F.col("pass") < F.col("whole"), have).otherwise(F.least(have, F.col("part") - F.col("slot") * block))
        # a slot's ticket is drawn from the urn at a pseudorandom turn, and shards draw one after the other
        ticket = F.col("first") + F.col("pass") * F.col("n") + F.col("slot")
        shard = F.floor(permuted(ticket, F.lit(seed).cast("long"), F.lit(max(urn, 1)).cast("long")) / per_shard)
        return cut(p.select(shard.cast("long").alias("shard"), "source", "pass", "block", words.alias("words")), "slots")

    def by_document(self) -> DataFrame:
        """``doc_id, tk, size, source_size, target, taken`` for every document."""
        taken = self.pieces.groupBy("source", "start").agg(F.sum(F.col("last") - F.col("first")).alias("n"))
        taken = taken.select(F.col("source").alias("_s"), F.col("start").alias("_at"), "n")
        t = self.targets.select(F.col("source").alias("_t"), "source_size", "target")
        d = self.packed
        d = d.join(t, d["source"].eqNullSafe(t["_t"]))
        d = d.join(taken, (F.col("size") > 0) & (F.col("start") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_s")), "left")
        return d.select("doc_id", "tk", "source", "start", "size", "source_size", "target", F.coalesce("n", F.lit(0).cast("long")).alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """``docs`` as mixed: each taken document once, its text the words of each pass, passes on lines of their own.

        Documents that no slot takes are left out; other columns stay.
        """
        spans = self.pieces.groupBy("source", "start", "doc_id", "tk").agg(F.array_sort(F.collect_list(F.struct("pass", "first", "last"))).alias("spans"))  # of one document
        spans = spans.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "tk").orderBy("source", "start"))).select("doc_id", "tk", "nth", "spans")
        # the documents' own columns stay inside one, whatever their names
        text = next(c for c in docs.columns if c.lower() == "text")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"), F.col("source").cast("string").alias("source"))
        rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("id", "hash").orderBy("source")))
        x = rows.join(spans, rows["id"].eqNullSafe(spans["doc_id"]) & rows["hash"].eqNullSafe(spans["tk"]) & (rows["number"] == spans["nth"]))
        return x.select("row", "spans").mapInArrow(_cut_texts(text), docs.schema)


def _cut_texts(text: str):
    def run(batches):
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans").to_pylist()
            names = [f.name for f in row.type]
            cols = [row.field(i) for i in range(len(names))]
            at = names.index(text)
            cols[at] = pa.array(_taken(cols[at], spans), cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _taken(texts: pa.Array, spans: list) -> list[str]:
    """Of each text the words that its spans take."""
    out = [None] * len(spans)
    for a, b, buf, offs in bw.chunks(texts):
        row, begin, size, _ = bw.find_words(buf, offs)
        raw, bounds = buf.tobytes(), bw.row_bounds(row, b - a)
        for i in range(b - a):
            first, n = bounds[i], bounds[i + 1] - bounds[i]
            runs: list[list[int]] = []
            for s in spans[a + i]:
                if runs and runs[-1][0] == s["pass"] and runs[-1][2] == s["first"]:
                    runs[-1][2] = s["last"]
                else:
                    runs.append([s["pass"], s["first"], s["last"]])
            parts = []
            for _, lo, hi in runs:
                x = offs[i] if lo == 0 else begin[first + lo]
                y = offs[i + 1] if hi == n else begin[first + hi - 1] + size[first + hi - 1]
                parts.append(raw[x:y].decode())
            out[a + i] = "\n".join(parts)
    return out
