"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a set of word shingles.  Shingles are ordered by their
rarity in the corpus; exact containment needs only a prefix of one, the rarest,
to be looked for.  Documents give a row only where such a shingle occurs, with
the words around it; the join on the shingle then yields, for each window, its
offset there, which the lengths and positions bound and the words verify.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import bytewords as bw
from lapwing.llm.common import cut, row_key

WINDOW = 10
#: Words in a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: Bits of the filter that keeps most other shingles out of the join: its size is fixed, whatever the benchmark's.
FILTER_BITS = 1 << 22


def _item_windows(window: int, shingle: int):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("item_id", "words", "offset", "shingle")}
            for a, b, buf, offs in bw.chunks(batch.column(1)):
                row, _, _, h = bw.find_words(buf, offs, bw.ALNUM, lower=True)
                bounds = bw.row_bounds(row, b - a)
                for r in range(b - a):
                    w = h[bounds[r] : bounds[r + 1]]
                    size = min(window, len(w))
                    if not size:
                        continue
                    k = min(shingle, size)
                    s, _ = bw.windows(w, np.zeros(len(w), np.int64), k)
                    s, words = s.view(np.int64), w.view(np.int64)
                    for at in range(len(w) - size + 1):
                        for o in range(size - k + 1):
                            out["item_id"].append(batch.column(0)[a + r].as_py())
                            out["words"].append(words[at : at + size])
                            out["offset"].append(o)
                            out["shingle"].append(int(s[at + o]))
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.int64()), pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["offset"], pa.int32()), pa.array(out["shingle"], pa.int64())], names=list(out))

    return run


def _bits(shingles: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit set for every shingle."""
    slots = shingles.select(F.pmod("shingle", F.lit(FILTER_BITS)).cast("int").alias("s")).distinct()
    # at most FILTER_BITS small numbers, however large the benchmark is
    at = np.fromiter((r["s"] for r in slots.toLocalIterator()), dtype=np.int64)
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[at] = True
    return np.packbits(bits)


def _counts(bitmap, sizes: list[int]):
    def run(batches):
        bits = np.unpackbits(bitmap.value).astype(bool)
        for batch in batches:
            for a, b, buf, offs in bw.chunks(batch.column(0)):
                row, _, _, h = bw.find_words(buf, offs, bw.ALNUM, lower=True)
                for k in sizes:
                    s, _ = bw.windows(h, row, k)
                    s = s.view(np.int64)
                    s, n = np.unique(s[bits[s % FILTER_BITS]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return run


def _places(bitmap, sizes: list[int], window: int):
    reach = window - 1

    def run(batches):
        bits = np.unpackbits(bitmap.value).astype(bool)
        for batch in batches:
            for a, b, buf, offs in bw.chunks(batch.column(1)):
                rows = b - a
                row, _, _, h = bw.find_words(buf, offs, bw.ALNUM, lower=True)
                begin = bw.row_bounds(row, rows)
                words = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(reach + 1, np.uint64)]).view(np.int64)
                got, where = [], []
                for k in sizes:
                    s, at = bw.windows(h, row, k)
                    s = s.view(np.int64)
                    hit = bits[s % FILTER_BITS]
                    got.append(s[hit])
                    where.append(at[hit])
                got, where = np.concatenate(got), np.concatenate(where)
                order = np.argsort(where, kind="stable")
                got, where = got[order], where[order]
                r = row[where]
                near = words[where[:, None] + np.arange(2 * reach + 1)]
                ends = np.searchsorted(r, np.arange(rows + 1)).astype(np.int32)
                spots = pa.StructArray.from_arrays([pa.array(got), pa.array(where - begin[r]), pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))], names=["shingle", "at", "near"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(np.diff(begin).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), spots)], names=["rk", "n_words", "spots"])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: bool = False) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document.

    ``docs`` has ``doc_id, text`` and ``items`` has ``item_id, text``.  Words are
    runs of lower-cased letters, digits and non-ASCII characters.  A window is
    ``window`` consecutive words of an item; a shorter item is one window; an
    item without words has none.  Words inside any occurrence of a window are
    hit.

    Null or wordless text: no words, no hits.  Rows with the same id and text
    share their result; rows that only share an id do not.  Items that repeat
    an id count once; items without an id are ignored.  Empty tables give no
    rows or no hits.  Other columns are ignored.  With ``key``, ``rk`` comes
    first: the :func:`row_key` that tells rows of one id apart.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rk", row_key())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    win = cut(items.mapInArrow(_item_windows(window, shingle), "item_id long, words array<long>, offset int, shingle long"), "windows")
    sizes = [r["k"] for r in win.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct().collect()] or [shingle]  # at most `shingle` numbers

    seen = spark.sparkContext.broadcast(_bits(win))
    df = docs.select("text").mapInArrow(_counts(seen, sizes), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = win.join(df, "shingle")  # a window with a shingle that no document has cannot occur
    lacking = win.join(df, "shingle", "left_anti").select("words").distinct()
    prefix = ranked.groupBy("words").agg(F.min_by(F.struct("shingle", "offset"), F.struct("n", "shingle", "offset")).alias("p")).join(lacking, "words", "left_anti")
    prefix = cut(prefix.select("words", F.size("words").alias("m"), "p.shingle", "p.offset"), "prefix")

    bits = spark.sparkContext.broadcast(_bits(prefix))
    doc = cut(docs.select("rk", "text").mapInArrow(_places(bits, sizes, window), "rk long, n_words long, spots array<struct<shingle:long,at:long,near:array<long>>>"), "places")
    spot = doc.select("rk", "n_words", F.explode("spots").alias("s")).select("rk", "n_words", "s.*")
    start = F.col("at") - F.col("offset")
    met = spot.join(prefix, "shingle").where((start >= 0) & (start + F.col("m") <= F.col("n_words")))
    met = met.where(F.slice("near", F.lit(window) - F.col("offset"), F.col("m")) == F.col("words"))
    met = cut(met.select("rk", start.alias("start"), "m", F.xxhash64("words").alias("w"), "words").distinct(), "met")

    hit = met.select("rk", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("at")).distinct().groupBy("rk").agg(F.count("*").alias("n_hit"))
    owners = win.select("item_id", "words").distinct()
    named = met.select("rk", "words").distinct().join(owners, "words").select("rk", F.col("item_id").cast("string").alias("i")).distinct()
    named = named.groupBy("rk").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("names"))
    n = doc.groupBy("rk").agg(F.first("n_words").alias("n_words"))
    out = docs.select("doc_id", "rk").join(n, "rk").join(hit, "rk", "left").join(named, "rk", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(*["rk"][: int(key)], "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
