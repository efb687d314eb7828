"""A prefix trie over conversations that are rebuilt from turns of others, without building their texts.

A turn has a number modulo three primes; a sequence of turns has the polynomial of
these numbers.  Polynomials of parts compose: that of a rebuilt prefix is the product
of its base's head with the own turns behind it, shifted by powers of the base.  One
running sum over all turns, taken as one long row, holds the polynomials of all
stretches of it, so a conversation of any length is no task of its own.

Prefixes of equal depth and polynomial are one node.  That they are equal is
verified: turns of equal hash have equal role and text, and all members of a node
refer to one such turn and to one node above.  If either fails, everything is
hashed anew with another seed.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwing.llm.common import cut, running_sums

#: Three primes under 2**31, and a base for each.
PRIMES, BASES = (2147483647, 2147483629, 2147483587), (1103515245, 1664525, 69069069)
#: Turns of a conversation that one row of its parameters serves, and ids in one piece of a node's list.
CELL, PIECE = 4096, 4096
_F, _P = ["f0", "f1", "f2"], ["p0", "p1", "p2"]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in "abc"]))
def powers(n: pd.Series) -> pd.DataFrame:
    """Each base to the power of ``n``, which may be negative."""
    out = {}
    for name, p, base in zip("abc", PRIMES, BASES, strict=True):
        e, x, b = np.mod(n.to_numpy().astype(np.int64), p - 1), np.ones(len(n), np.int64), base
        for bit in range(31):
            x = np.where((e >> bit) & 1 == 1, x * b % p, x)
            b = b * b % p
        out[name] = x
    return pd.DataFrame(out)


def _times(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a * b, F.lit(p))


def _sum(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a + b, F.lit(p))


def _less(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a - b, F.lit(p))


def _hashed(turns: DataFrame, seed: int) -> DataFrame:
    """Turns with two hashes of role and text, in place of which they then stand."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return x.withColumns({"t0": F.xxhash64(F.lit(seed), "role", "text"), "t1": F.xxhash64(F.lit(seed + 1), "text", "role")})


def _of(rows: DataFrame, at: Column, params: DataFrame, first: Column, last: Column) -> DataFrame:
    """``rows`` with their conversation's ``params``, which serve ``CELL`` places each: a long conversation is many keys."""
    spread = params.select("*", F.explode(F.sequence(F.floor(first / CELL), F.floor(last / CELL))).alias("cell"))
    return rows.withColumn("cell", F.floor(at / CELL)).join(spread, ["conv_id", "cell"]).drop("cell")


def _placed(turns: DataFrame, seed: int) -> DataFrame:
    """``conv_id, rank, start, n, t0, t1, bytes`` and by prime the polynomial of the conversation's turns before (p) and with (f) this one."""
    x = _hashed(turns, seed)
    # what orders turns of one number: role and text by their openings, then hashes; rows equal in all may swap
    lead = lambda c: F.substring(c, 1, 64).alias(f"{c}_lead")
    x = cut(x.select("conv_id", "turn", lead("role"), lead("text"), "t0", "t1", F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *(F.col(c) for c in ("role_lead", "text_lead", "t0", "t1", "row"))]
    x = running_sums(x, order, {"rank": F.lit(1).cast("long")}).select("conv_id", "rank", "t0", "t1", "bytes")
    power = x.withColumn("power", powers("rank"))
    terms = {f"e{i}": _times(F.pmod(F.xxhash64("t0", "t1", F.lit(i)), F.lit(p)), F.col(f"power.{c}"), p) for i, (p, c) in enumerate(zip(PRIMES, "abc", strict=True))}
    x = cut(power.withColumns(terms).drop("power"), "terms")
    x = cut(running_sums(x, [F.col("rank")], {f"s{i}": F.col(f"e{i}").cast("decimal(20,0)") for i in range(3)}), "sums")
    convs = x.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("n"), *[F.min_by(f"s{i}", "rank").alias(f"z{i}") for i in range(3)])
    convs = cut(convs.withColumn("back", powers(-F.col("start"))), "convs")
    x = _of(x, F.col("rank"), convs, F.col("start"), F.col("start") + F.col("n") - 1)
    for i, (p, c) in enumerate(zip(PRIMES, "abc", strict=True)):
        before = F.pmod(F.col(f"s{i}") - F.col(f"z{i}"), F.lit(p)).cast("long")
        x = x.withColumn(_P[i], _times(before, F.col(f"back.{c}"), p))
        x = x.withColumn(_F[i], _sum(F.col(_P[i]), _times(F.col(f"e{i}"), F.col(f"back.{c}"), p), p))
    return cut(x.select("conv_id", "rank", "start", "n", "t0", "t1", "bytes", *_F, *_P), "placed")


def rebuilt(placed: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """``conv_id, depth, last, t0, t1, bytes`` and the polynomials of the prefix (f) and of the one above (p), for every prefix of every rebuilt conversation.

    ``base`` and ``head`` (at most ``most``): of a ``conv_id``, the conversation whose first ``head`` turns stand before its own from there on.
    """
    turn = F.struct((F.col("rank") - F.col("start")).alias("at"), "t0", "t1", "bytes", *_F, *_P)
    few = placed.where(F.col("rank") - F.col("start") < most)
    heads = few.groupBy("conv_id").agg(F.first("start").alias("start"), F.first("n").alias("n"), F.array_sort(F.collect_list(turn)).alias("turns"))  # at most `most`
    heads = cut(heads.select("*", head.cast("int").alias("h"), base.alias("base")), "heads")
    own = heads.alias("o").join(heads.select(F.col("conv_id").alias("b"), F.col("turns").alias("base_turns")), F.col("base") == F.col("b"), "left")
    own = own.withColumn("k", F.least("h", F.coalesce(F.size("base_turns"), F.lit(0))))
    own = own.withColumns({"used": F.least("h", F.size("turns")), "shift": powers((F.col("k") - F.col("h")).cast("long"))})
    value = lambda turns, k, f: F.when(F.col(k) > 0, F.element_at(turns, F.greatest(F.col(k), F.lit(1)))[f]).otherwise(0).cast("long")
    for f in _F:  # of the base's head, and of the own turns that it replaces
        own = own.withColumns({f"b_{f}": value("base_turns", "k", f), f"o_{f}": value("turns", "used", f)})
    own = own.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = cut(own.select("conv_id", "start", "n", "h", "k", "length", "shift", *[f"{x}_{f}" for f in _F for x in "bo"], F.slice("base_turns", 1, F.greatest("k", F.lit(0))).alias("base_turns")), "own")
    cols = ["conv_id", "depth", "last", "t0", "t1", "bytes", *_F, *_P]
    zero = [F.lit(0).cast("long").alias(c) for c in ("t0", "t1", "bytes", *_F, *_P)]
    root = own.select("conv_id", F.lit(0).cast("long").alias("depth"), (F.col("length") == 0).alias("last"), *zero)
    x = own.where("k > 0").select("conv_id", "length", F.explode("base_turns").alias("t"))
    first = x.select("conv_id", (F.col("t.at") + 1).alias("depth"), (F.col("t.at") + 1 == F.col("length")).alias("last"), *[F.col(f"t.{c}") for c in ("t0", "t1", "bytes", *_F, *_P)])
    params = own.where("n > h").select("conv_id", F.col("h"), F.col("k"), "length", "shift", F.col("start").alias("s"), F.col("n").alias("m"), *[f"{x}_{f}" for f in _F for x in "bo"])
    y = _of(placed, F.col("rank"), params, F.col("s"), F.col("s") + F.col("m") - 1).where(F.col("rank") - F.col("start") >= F.col("h"))
    for i, (p, c) in enumerate(zip(PRIMES, "abc", strict=True)):
        for f in (_F[i], _P[i]):
            y = y.withColumn(f, _sum(F.col(f"b_{_F[i]}"), _times(_less(F.col(f), F.col(f"o_{_F[i]}"), p), F.col(f"shift.{c}"), p), p))
    depth = F.col("rank") - F.col("start") - F.col("h") + F.col("k") + 1
    rest = y.select("conv_id", depth.alias("depth"), (depth == F.col("length")).alias("last"), "t0", "t1", "bytes", *_F, *_P)
    return cut(root.select(*cols).union(first.select(*cols)).union(rest.select(*cols)), "prefixes")


def _pieces(batches):
    """Runs of ids of one node, joined; at most ``PIECE`` in a piece."""
    for b in batches:
        key = [b.column(c).to_numpy() for c in ("depth", *_F)]
        new = np.zeros(b.num_rows, bool)
        new[::PIECE] = True
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        ids = b.column("conv_id").to_pylist()
        ends = [*at[1:], b.num_rows]
        text = [",".join(map(str, ids[i:j])) for i, j in zip(at, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k[at]) for k in key] + [b.column("conv_id").take(pa.array(at)), pa.array(text)], names=["depth", *_F, "first", "ids"])


def _hash_lists(batches):
    """One sha256 a node over its pieces, which follow each other; only the running hash is held."""
    node, h = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in node] + [pa.array([h.hexdigest()])], names=["depth", *_F, "ends_sha256"])

    for b in batches:
        out = []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in ("depth", *_F, "ids")), strict=True):
            if key == node:
                h.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append(done())
            node, h = key, sha256(ids.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if node is not None:
        yield done()


def list_hashes(members: DataFrame) -> DataFrame:
    """``depth, f0, f1, f2, ends_sha256``: of each node in ``members`` the sha256 of its ids, ascending.

    Ids are sorted and joined by ranges, a node's pieces over many tasks; sha256 has to
    read its input in order, so one task streams a node's pieces through it.
    """
    key = ["depth", *_F]
    x = members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    x = cut(x.mapInArrow(_pieces, "depth long, f0 long, f1 long, f2 long, first long, ids string"), "pieces")
    x = x.repartition(*key).sortWithinPartitions(*key, "first")
    return x.mapInArrow(_hash_lists, "depth long, f0 long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column, head: Column, most: int, seed: int = 0) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    ``turns(conv_id, turn, role, text)``; ``base``, ``head``: columns of ``conv_id``
    (see :func:`rebuilt`).  Result: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by their number, null first, then by role, the text's first 64
    characters and hashes.  A null role or text is empty.  Rows without ``conv_id``
    belong to no conversation.  Repeated rows are turns each.  A base that is absent
    has no turns.  An empty table has no node.  Other columns are not read.
    """
    key = ["depth", *_F]
    for s in count(seed, 2):
        texts = _hashed(turns, s).groupBy("t0", "t1").agg(F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high"))
        if not texts.where("low <> high").isEmpty():
            continue
        prefixes = rebuilt(_placed(turns, s), base, head, most)
        ref, up = F.struct("t0", "t1"), F.struct(*_P)
        nodes = prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min(ref).alias("r"), F.max(ref).alias("r2"), F.min(up).alias("up"), F.max(up).alias("up2"))
        nodes = cut(nodes, "nodes")
        if nodes.where("r <> r2 or up <> up2").isEmpty():
            break
    parent = [(F.col("depth") - 1).alias("depth"), *[F.col("up")[p].alias(f) for p, f in zip(_P, _F, strict=True)]]
    children = nodes.where("depth > 0").select(*parent).groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, key, "left").fillna(0, ["n_children"])
    weights = nodes.select("conv_id", "depth", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    # a node's weight stands in its smallest member's row; a node's subtree is what its members hold from its depth on
    w = cut(prefixes.select(*key, "conv_id", "last", *_P).join(weights, ["conv_id", "depth"], "left").fillna(0, ["n_children", "leaf", "saved"]), "weights")
    w = cut(running_sums(w, [F.col("conv_id"), F.col("depth")], {"leaf_before": F.col("leaf"), "saved_before": F.col("saved")}), "weights")
    whole = w.groupBy("conv_id").agg(F.max("depth").alias("deepest"), F.max(F.col("leaf_before") + F.col("leaf")).alias("leaf_end"), F.max(F.col("saved_before") + F.col("saved")).alias("saved_end"))
    w = _of(w, F.col("depth"), whole, F.lit(0), F.col("deepest"))
    rows = w.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum(F.col("leaf_end") - F.col("leaf_before")).alias("n_leaves"),
        F.sum(F.col("saved_end") - F.col("saved_before")).alias("saved_tokens"),
        F.max(F.struct(*_P)).alias("up"),
    )
    rows = cut(rows.join(list_hashes(prefixes.where("last")), key, "left"), "nodes")
    # only a node whose smallest member is not its parent's has to ask; children of the root need not
    root = rows.where("depth = 0").select("conv_id").first()
    over = rows.select(F.col("depth").alias("d"), *[F.col(f).alias(f"u_{f}") for f in _F], F.col("conv_id").alias("over_conv_id")).where("d > 0")
    on = (F.col("d") == F.col("depth") - 1) & (F.col("u_f0") == F.col("up.p0")) & (F.col("u_f1") == F.col("up.p1")) & (F.col("u_f2") == F.col("up.p2"))
    deep = rows.where("depth > 1").join(over, on).select(*rows.columns, F.col("over_conv_id").alias("parent_conv_id"))
    flat = rows.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")))
    out = deep.unionByName(flat)
    none = sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
