"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

The n-grams of all training texts are counted, whatever their number.  Documents
are read in blocks; a block's distinct n-grams go, with their counts, to hash
buckets that add them up over all blocks, and each block gets the totals of its
own n-grams back.  No task and no executor ever holds the whole model: a block
builds the part of the automaton that its texts can reach, which is all they need.

Smoothing: ``p(w | h) = (1 - m) c(hw) / c(h) + m p(w | h')``, where ``h'`` is ``h``
without its first token, and below single tokens all words, an unknown one
included, are alike.  ``m`` belongs to the order and to the size of ``c(h)``: it is
the share of training tokens behind such contexts whose n-gram is seen once, the
Good-Turing estimate of the mass of unseen ones.  The probabilities of all tokens,
the unknown one included, sum to one after any context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm import bytewords as bw
from lapwing.llm.common import cut

#: Bytes of text in a block, and of text for each bucket of n-grams.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
ORDER = 3
U = np.uint64
#: The token at a text's end, and the marks before its first token.
END, BEGIN = bw.mix([1])[0], bw.mix([2, 3])


def _blocks(batches, size: int):
    """The rows of a partition in blocks: one ends where its texts reach ``size`` bytes, wherever batches end."""
    pending, have = [], 0
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            reach = np.cumsum(n[at:]) + have
            rows = int(np.searchsorted(reach, size)) + 1
            pending.append(batch.slice(at, rows))
            if rows > len(reach):
                have = int(reach[-1])
                break
            yield pa.Table.from_batches(pending)
            pending, have, at = [], 0, at + rows
    if pending:
        yield pa.Table.from_batches(pending)


def _stream(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, each text as two begin marks, its words and its end; and the row of each token."""
    tokens, rows, base = [], [], 0
    column = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    for a, b, buf, offs in bw.chunks(column):
        row, _, _, h = bw.find_words(buf, offs, lower=True)
        count = np.bincount(row, minlength=b - a) + 3
        first = np.cumsum(count) - count
        t = np.empty(int(count.sum()), U)
        t[first], t[first + 1], t[first + count - 1] = BEGIN[0], BEGIN[1], END
        t[np.arange(len(h)) + 3 * row + 2] = h
        tokens.append(t)
        rows.append(np.repeat(np.arange(a, b), count))
    if not tokens:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(tokens), np.concatenate(rows)


def _places(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a text begins, and where its words and its end are."""
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    real = ~head
    real[1:] &= ~head[:-1]
    return head, real


def _grams(t: np.ndarray, row: np.ndarray, order: int):
    """By n from 1: the places at which n-grams end, and the n-grams' hashes with a free lowest bit.

    Single begin marks and pairs of them are n-grams too, since they are contexts.
    """
    head, real = _places(row)
    h = np.zeros(len(t), U)
    for n in range(1, order + 1):
        # the n-gram's hash grows to the left, one token a round
        h[n - 1 :] = bw.mix(h[n - 1 :] * U(0xD1342543DE82EF95) + t[: len(t) - n + 1] + U(n))
        at = np.flatnonzero(~head if n < 3 else real)
        yield at, h[at] & ~U(1)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the number of each key among them."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(first) - 1
    return k[first], number


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: first the lowest bytes of all, then the next; small numbers compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _count_blocks(order: int, bits: int, size: int):
    """Of each block and bucket: the sorted keys of its n-grams, as steps, and how often the training texts hold each.

    A bucket is n and the upper bits of the keys.
    """

    def run(batches):
        for i, x in enumerate(_blocks(batches, size)):
            block = (TaskContext.get().partitionId() << 32) + i
            t, row = _stream(x.column("text"))
            learn = x.column("learn").to_numpy().astype(U)[row]
            for n, (at, k) in enumerate(_grams(t, row, order)):
                k = np.sort(k | learn[at])  # one sort: the lowest bit tells training texts
                first = np.ones(len(k), bool)
                first[1:] = (k[1:] | U(1)) != (k[:-1] | U(1))
                start = np.flatnonzero(first)
                count = np.add.reduceat(k & U(1), start) if len(start) else np.zeros(0, U)
                uniq = k[start] & ~U(1)
                edge = np.searchsorted(uniq >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
                used = np.flatnonzero(edge[1:] > edge[:-1])
                steps = [_planes(np.diff(uniq[edge[b] : edge[b + 1]], prepend=U(0))) for b in used]
                counts = [_planes(count[edge[b] : edge[b + 1]]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used + (n << bits), pa.int64()), pa.array([block] * len(used), pa.int64()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())],
                    names=["bucket", "block", "keys", "counts"],
                )

    return run


#: The n-gram of a text's second begin mark alone: a context, but no token.
_MARK = bw.mix(BEGIN[1:] + U(1))[0] & ~U(1)


def _add_up(bits: int):
    """Of a bucket: the totals of each block's n-grams; and in a row of block -1 the tokens, and the distinct ones, of the training texts."""

    def run(x: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unplanes(k), dtype=U) for k in x.column("keys").to_pylist()]
        key, number = _numbered(np.concatenate(parts))
        n = np.concatenate([_unplanes(c) for c in x.column("counts").to_pylist()])
        total = np.bincount(number, weights=n, minlength=len(key)).astype(U)
        bucket, block = x.column("bucket").to_pylist(), x.column("block").to_pylist()
        single = total[(key != _MARK) & (total > 0)] if bucket[0] >> bits == 0 else total[:0]
        ends = np.cumsum([len(p) for p in parts])
        out = [_planes(total[number[e - len(p) : e]]) for p, e in zip(parts, ends, strict=True)]
        stats = [[int(single.sum()), len(single)]]
        columns = {"block": pa.array([*block, -1], pa.int64()), "bucket": pa.array([*bucket, bucket[0]], pa.int64())}
        columns |= {"totals": pa.array([*out, None], pa.binary()), "stats": pa.array([None] * len(out) + stats, pa.list_(pa.int64()))}
        return pa.table(columns)

    return run


def _level(count: np.ndarray) -> np.ndarray:
    """Contexts of like counts: 0 to 7 each alone, above by powers of two."""
    return np.where(count < 8, count, 5 + np.floor(np.log2(np.maximum(count, 1)))).astype(np.int64)


LEVELS = 72


class Reach:
    """A block's tokens with the totals of their n-grams.

    By n: ``index``, the number of the n-gram that ends at each place; ``total``, how
    often the training texts hold each n-gram.  ``real``: the places of tokens that
    are no begin marks; ``row``: the document of each of these.
    """

    def __init__(self, docs: pa.Table, totals: pa.Table, order: int, tokens: int):
        t, row = _stream(docs.column("text"))
        totals = totals.sort_by("bucket")
        every = np.concatenate([_unplanes(b) for b in totals.column("totals").to_pylist()] or [np.zeros(0, U)])
        self.index, self.total, self.tokens = [], [], tokens
        for at, keys in _grams(t, row, order):
            uniq, number = _numbered(keys)
            index = np.zeros(len(t), np.int64)
            index[at] = number
            self.index.append(index)
            self.total.append(every[: len(uniq)].astype(np.float64))
            every = every[len(uniq) :] if len(every) >= len(uniq) else None
            if every is None:
                break
        if every is None or len(every):
            raise RuntimeError("the documents changed between two reads: give a table that is read from files")
        self.real = np.flatnonzero(_places(row)[1])
        self.row = row[self.real]

    def seen(self, n: int, at: np.ndarray) -> np.ndarray:
        """How often the training texts hold the n-gram that ends at each place."""
        return self.total[n - 1][self.index[n - 1][at]]

    def context(self, n: int, at: np.ndarray) -> np.ndarray:
        """How often the training texts hold the n-1 tokens before each place."""
        return np.full(len(at), float(self.tokens)) if n == 1 else self.seen(n - 1, at - 1)


def _seen_once(order: int, tokens: int):
    """By n and level of the context: the block's training tokens, and those whose n-gram no other training token ends."""

    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        r = Reach(docs, totals, order, tokens)
        at = r.real[docs.column("learn").to_numpy()[r.row]]
        out = []
        for n in range(1, order + 1):
            level = _level(r.context(n, at))
            once = r.seen(n, at) == 1
            out += [np.bincount(level, minlength=LEVELS), np.bincount(level, weights=once, minlength=LEVELS)]
        have, once = np.concatenate(out[::2]).astype(np.int64), np.concatenate(out[1::2]).astype(np.int64)
        cell = np.flatnonzero(have)
        return pa.table({"cell": pa.array(cell), "tokens": pa.array(have[cell]), "once": pa.array(once[cell])})

    return run


class Automaton:
    """The states and arcs that a block's texts can reach.

    A state is a context; its arc to a token has the log-probability of the two,
    and its failure arc, of weight ``m``, leads to the context without its first
    token.  ``fail``: by n and level of the context's count, ``m``.
    """

    def __init__(self, reach: Reach, fail: np.ndarray, types: int):
        self.reach, self.fail, self.log_arc = reach, fail, []
        self.nothing = 1.0 / (types + 1)
        lower = None
        for n in range(1, len(fail) + 1):
            index, total = reach.index[n - 1], reach.total[n - 1]
            place = np.full(len(total), -1)
            place[index[reach.real]] = reach.real  # some place of each n-gram: all of its places give the same arc
            arcs = np.flatnonzero((total > 0) & (place >= 0))
            at = place[arcs]
            state = reach.context(n, at)
            m = fail[n - 1][_level(state)]
            below = self.nothing if n == 1 else lower[reach.index[n - 2][at]]
            arc = np.zeros(len(total))
            arc[arcs] = (1 - m) * total[arcs] / state + m * below
            with np.errstate(divide="ignore"):
                self.log_arc.append(np.log10(arc))
            lower = arc

    def walk(self) -> np.ndarray:
        """The log-probability of each token: its state's arc or, where there is none, failure arcs until a state has one."""
        r = self.reach
        score, left = np.zeros(len(r.real)), np.arange(len(r.real))
        for n in range(len(self.fail), 0, -1):
            at = r.real[left]
            has = r.seen(n, at) > 0
            score[left[has]] += self.log_arc[n - 1][r.index[n - 1][at[has]]]
            left, at = left[~has], at[~has]
            score[left] += np.log10(self.fail[n - 1][_level(r.context(n, at))])
        score[left] += np.log10(self.nothing)
        return score


def _score_blocks(order: int, fail: list[list[float]], tokens: int, types: int):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        r = Reach(docs, totals, order, tokens)
        log = Automaton(r, np.array(fail), types).walk()
        count = r.seen(1, r.real)
        base = np.log10((count + 1) / (tokens + types + 1))
        add = lambda w: np.bincount(r.row, weights=w, minlength=docs.num_rows)
        whole = lambda x: pa.array(x.astype(np.int64))
        lengths = np.bincount(r.row, minlength=docs.num_rows)
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": whole(lengths), "n_known": whole(add(count > 0)), "base_score": add(base), "score": add(log)})

    return run


def scores(docs: DataFrame, learn: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs(doc_id, text)``.

    Tokens: words with A-Z in lower case, then one end.  ``learn``: which rows are
    training texts; null is no.  ``base_score``: single tokens with one added to
    each count.  ``score``: log10 of the text's probability under the model.

    Null and empty texts are an end alone.  Null ids, repeated ids and repeated
    rows are scored and learnt from row by row; other columns are not read.  No
    training text at all leaves one class of words, of probability 1.  A text is
    held whole by one task, a block is a text at least.  ``docs`` is read four
    times and must be durable; a block that differs between reads is an error.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(size // bucket_bytes).bit_length())
    parts = x.mapInArrow(_count_blocks(order, bits, block_bytes), "bucket long, block long, keys binary, counts binary")
    totals = parts.groupBy("bucket").applyInArrow(_add_up(bits), "block long, bucket long, totals binary, stats array<long>")
    totals = cut(totals, "totals")
    tokens, types = totals.where("block = -1").select(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in (0, 1)]).first()

    def tag(batches):
        for i, b in enumerate(_blocks(batches, block_bytes)):
            block = (TaskContext.get().partitionId() << 32) + i
            yield from b.append_column("block", pa.array([block] * b.num_rows, pa.int64())).to_batches()

    rows = x.mapInArrow(tag, "doc_id long, text string, learn boolean, block long")
    met = rows.groupBy("block").cogroup(totals.where("block >= 0").select("block", "bucket", "totals").groupBy("block"))
    seen = met.applyInArrow(_seen_once(order, tokens), "cell long, tokens long, once long").groupBy("cell").agg(F.sum("tokens"), F.sum("once"))
    fail = [[1.0] + [0.5] * (LEVELS - 1) for _ in range(order)]  # a context that the training texts lack only fails
    for cell, have, once in seen.collect():  # a row for each n and level
        fail[cell // LEVELS][cell % LEVELS] = (once + 1) / (have + 2)
    out = met.applyInArrow(_score_blocks(order, fail, tokens, types), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
