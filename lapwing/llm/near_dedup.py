"""MinHash near-duplicate detection with odd sketches.

Every text gets MinHash samples of its word shingles; bands of samples are the
blocking keys, and the samples fold into an odd sketch: a bitmap whose bits are
the parities of the samples that hash there.  The population count of two
sketches' XOR estimates their similarity closely when it is high, so almost all
candidates are settled on 128 bytes.  A link counts only when the full shingle
sets confirm it.

Equal word sequences are one class from the start.  In a band's bucket no pairs
are listed: its classes first meet one of them, the centre, which then leaves;
only buckets that still hold several components after two such rounds are
compared in blocks of bounded size, and only across components.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import bytewords as bw
from lapwing.llm.common import cut, rows_of
from lapwing.llm.graph import components

ROWS = 8
#: Share of pairs at the asked similarity that may meet in no band.
MISS = 3e-6
SKETCH_BITS = 1024
#: Deviations above the mean of their XOR up to which sketches of such a pair go to the full sets.
DEVIATIONS = 5.56
BLOCK = 256
#: Rounds in which each bucket compares its members with one of them.
PEELS = 2

FEATURES = "doc_id long, n_shingles long, klass binary, bands array<long>, sketch array<long>"


def bands_for(similarity: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` samples that leave ``MISS`` of the pairs at ``similarity`` without a common one: 40 for 0.85."""
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**rows))) if similarity < 1 else 1


def xor_for(similarity: float, samples: int) -> int:
    """XOR bits up to which full sets are compared: 150 for 0.85 and 320 samples.

    Samples differ independently, and each that does flips two random bits; the
    mean and the deviation of the differing bits follow.
    """
    n = SKETCH_BITS
    one, two = ((similarity + (1 - similarity) * (1 - c / n) ** 2) ** samples for c in (2, 4))
    mean = n * (1 - one) / 2
    variance = mean + n * (n - 1) * (1 - 2 * one + two) / 4 - mean**2
    return math.ceil(mean + DEVIATIONS * math.sqrt(max(0.0, variance)))


def _seeds(n: int, salt: int) -> np.ndarray:
    return bw.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt))


def shingle_sets(col: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: rows (first, end), words' rows and hashes, distinct shingles sorted by row, their rows, and counts."""
    for a, b, buf, offs in bw.chunks(col):
        rows = b - a
        row, _, _, h = bw.find_words(buf, offs, bw.SPACED, lower=True)
        s, at = bw.windows(h, row, size)
        srow = row[at]
        count = np.bincount(row, minlength=rows)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            bounds = bw.row_bounds(row, rows)
            whole = np.array([bw.windows(h[bounds[r] : bounds[r + 1]], row[bounds[r] : bounds[r + 1]], int(count[r]))[0][0] for r in short], dtype=np.uint64)
            s, srow = np.concatenate([s, whole]), np.concatenate([srow, short])
        key = bw.distinct(bw.keyed(srow, s))
        srow = (key >> np.uint64(64 - bw.ROW_BITS)).astype(np.int64)
        yield a, b, row, h, bw.mix(key << np.uint64(bw.ROW_BITS)), srow, np.bincount(srow, minlength=rows)


def _features(size: int, rows: int, bands: int):
    k = rows * bands
    xor = (_seeds(k, 11) >> np.uint64(32)).astype(np.uint32)
    mul = (_seeds(k, 12) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    where = _seeds(k, 13)
    band_salt = _seeds(bands, 14)

    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b, row, h, s, srow, count in shingle_sets(text, size):
                n = b - a
                full = np.flatnonzero(count)
                heads = np.searchsorted(srow, full)
                h32 = (s >> np.uint64(32)).astype(np.uint32)
                sample = np.empty((len(full), k), dtype=np.uint32)
                if len(full):
                    for j in range(k):
                        sample[:, j] = np.minimum.reduceat((h32 ^ xor[j]) * mul[j], heads)
                wide = bw.mix(sample.astype(np.uint64) ^ where)
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                for r in range(rows):
                    keys = bw.mix(keys ^ wide[:, r::rows])
                keys = bw.mix(keys ^ band_salt).view(np.int64)
                bit = (wide % np.uint64(SKETCH_BITS)).astype(np.int64)
                parity = np.bincount((np.arange(len(full))[:, None] * SKETCH_BITS + bit).ravel(), minlength=len(full) * SKETCH_BITS) & 1
                sketch = np.packbits(parity.astype(np.uint8).reshape(len(full), SKETCH_BITS), axis=1)
                # the word sequence, as 128 bits
                klass = np.zeros((len(full), 2), dtype=np.uint64)
                if len(full):
                    begin = np.searchsorted(row, full)
                    step = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
                    p = bw.powers(int(step.max()) + 1)
                    klass[:, 0] = np.add.reduceat(h * p[step], begin)
                    klass[:, 1] = np.add.reduceat(bw.mix(h + np.uint64(5)) * p[step], begin)
                out_k, out_b, out_s = [None] * n, [None] * n, [None] * n
                for i, r in enumerate(full):
                    out_k[r], out_b[r], out_s[r] = klass[i].tobytes(), keys[i], sketch[i].view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(count.astype(np.int64)), pa.array(out_k, pa.binary()), pa.array(out_b, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "klass", "bands", "sketch"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b, _, _, s, srow, _ in shingle_sets(text, size):
                bounds = bw.row_bounds(srow, b - a)
                out = [np.sort(s[bounds[i] : bounds[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(out, pa.binary())], names=["doc_id", "items"])

    return run


def _confirm(numerator: int, denominator: int):
    def run(batches):
        for batch in batches:
            sets = zip(batch.column("items_u"), batch.column("items_v"), strict=True)
            keep = [_confirmed(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), numerator, denominator) for x, y in sets]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether two sorted shingle sets are as similar as asked."""
    if denominator * min(len(x), len(y)) < numerator * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return denominator * same >= numerator * (len(x) + len(y) - same)


def _across(numerator: int, denominator: int, max_xor: int):
    """Sorted rows (bucket, i, j, side, node, component, sketch, items) to links that join components.

    A block's rows follow each other, so one block is held at a time.  Pairs are
    tried in the order of their sketches' distance; one whose ends are joined
    already needs no look, so a block gives a spanning forest at most.
    """

    def links(i, j, side, node, comp, sketch, items):
        roots, own = np.unique(comp, return_inverse=True)
        if len(roots) < 2:
            return
        parent = list(range(len(roots)))

        def root(a):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            return a

        us, vs, far = [], [], []
        for x in np.flatnonzero(side == i):
            to = np.flatnonzero(((side == j) if i != j else (np.arange(len(node)) > x)) & (own != own[x]))
            d = np.bitwise_count(sketch[to] ^ sketch[x]).sum(axis=1)
            near = d <= max_xor
            us.append(np.full(int(near.sum()), x))
            vs.append(to[near])
            far.append(d[near])
        us, vs = np.concatenate(us), np.concatenate(vs)
        for k in np.argsort(np.concatenate(far), kind="stable"):
            a, b = root(own[us[k]]), root(own[vs[k]])
            if a != b and _confirmed(items[us[k]], items[vs[k]], numerator, denominator):
                parent[a] = b
                yield node[us[k]], node[vs[k]]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("bucket", "i", "j", "side", "node", "component")]
            cols.append(np.asarray(batch.column("sketch").flatten()).view(np.uint64).reshape(batch.num_rows, -1))
            items = np.empty(batch.num_rows, dtype=object)
            items[:] = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("items")]
            cols.append(items)
            if held is not None:
                cols = [np.concatenate([p, q]) for p, q in zip(held, cols, strict=True)]
            new = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])))
            held = [c[new[-1] :] for c in cols]
            yield from found(cols, new)
        if held is not None:
            yield from found(held, np.array([0, len(held[0])]))

    def found(cols, new):
        out = [link for a, b in zip(new[:-1], new[1:], strict=True) if b - a > 1 for link in links(cols[1][a], cols[2][a], *(c[a:b] for c in cols[3:]))]
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, numerator: int = 85, denominator: int = 100, shingle: int = 5, rows: int = ROWS, bands: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Texts link when ``denominator * |A & B| >= numerator * |A | B|`` over their
    distinct shingles of ``shingle`` lower-cased words (a shorter text is one
    shingle).  ``component_id`` is the smallest ``doc_id`` that links reach.

    Null or wordless text: no shingles, linked with nothing, kept.  A null
    ``doc_id`` is kept under a null component.  Rows that repeat an id are one
    node.  Other columns are ignored.  An empty table gives an empty result.
    The number of bands and the sketches' bound follow from the similarity.
    """
    bands = bands_for(numerator / denominator, rows) if bands is None else bands
    max_xor = xor_for(numerator / denominator, rows * bands)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(docs.mapInArrow(_features(shingle, rows, bands), FEATURES), "features")

    # buckets of several classes, and their classes: all rows of a class share their buckets
    keyed = seen.where("klass is not null and doc_id is not null")
    banded = keyed.select("doc_id", "klass", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.min(F.xxhash64("klass")).alias("lo"), F.max(F.xxhash64("klass")).alias("hi")).where("lo <> hi")
    member = rows_of(banded, "bucket", cut(full.select("bucket"), "buckets"))
    member = cut(member.groupBy("bucket", "klass").agg(F.min("doc_id").alias("node")).select("bucket", "node"), "members")

    # what comparing them takes: sketches, and full sets
    nodes = member.select("node").distinct()
    sketch = cut(rows_of(keyed.select(F.col("doc_id").alias("node"), "sketch"), "node", nodes), "sketches")
    items = rows_of(docs, "doc_id", nodes).mapInArrow(_sets(shingle), "doc_id long, items binary").where("length(items) > 0")
    items = cut(items.select(F.col("doc_id").alias("node"), "items"), "sets")

    # 1. all classes of a bucket against its centre, which leaves the bucket then
    confirm = _confirm(numerator, denominator)
    left, links, comp = member, None, None
    for _ in range(PEELS):
        left = _several(left, comp)
        pairs = left.where("node <> centre and component <> centre_component").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
        pairs = pairs.join(_named(sketch, "sketch", "u"), "u").join(_named(sketch, "sketch", "v"), "v")
        pairs = cut(pairs.where(_xor_bits("sketch_u", "sketch_v") <= max_xor).select("u", "v"), "pairs")
        pairs = pairs.join(_named(items, "items", "u"), "u").join(_named(items, "items", "v"), "v")
        found = pairs.select("u", "v", "items_u", "items_v").mapInArrow(confirm, "u long, v long")
        links = cut(found if links is None else found.union(links), "links")
        comp = components(links)
        left = cut(left.where("node <> centre").select("bucket", "node"), "left")

    # 2. buckets that still hold several components, in blocks
    left = _several(left, comp)
    left = left.withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    left = left.join(items, "node").join(sketch, "node").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    left = left.select("bucket", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "node", "component", "sketch", "items")
    left = left.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    hubs = comp.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    links = cut(hubs.union(left.mapInArrow(_across(numerator, denominator, max_xor), "u long, v long")), "links")

    klass = keyed.groupBy("klass").agg(F.min("doc_id").alias("node"))
    comp = components(links)
    by_class = klass.join(comp, "node", "left").select("klass", F.coalesce("component", "node").alias("component"))
    out = seen.select("doc_id", "n_shingles", "klass").join(by_class, "klass", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _several(left: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold several components: with those, the
    bucket's centre (its smallest node) and the number of its members."""
    left = left.withColumn("component", F.col("node")) if comp is None else left.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    full = left.groupBy("bucket").agg(F.min(F.struct("node", "component")).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    full = full.select("bucket", F.col("c.node").alias("centre"), F.col("c.component").alias("centre_component"), "n")
    return left.join(full, "bucket")


def _named(attributes: DataFrame, column: str, side: str) -> DataFrame:
    """``attributes(node, column)`` for the end ``side`` of a pair."""
    return attributes.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))


def _xor_bits(s: str, t: str):
    """Differing bits of two sketches."""
    bits = [F.bit_count(F.col(s)[i].bitwiseXOR(F.col(t)[i])) for i in range(SKETCH_BITS // 64)]
    return reduce(operator.add, bits)
