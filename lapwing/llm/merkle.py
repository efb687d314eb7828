"""A Merkle manifest that grows by appends and keeps a witness for every leaf.

Leaves of a group stand in a row; every 8 consecutive nodes become one, until one
is left.  The row is dealt in aligned blocks of 512 leaves.  A block is built by
streaming its leaves through a :class:`Frontier`, which attaches partial witnesses
to open subtrees; a subtree that gets its siblings has the witnesses below it
extended by them.  The roots of closed blocks are appends to the row above, and so
on; blocks that are still open lend a provisional root when witnesses are asked for.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import cut, new_path, running_sums

ARITY, HEIGHT = 8, 3
BLOCK = ARITY**HEIGHT


def _h(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def digest(*fields: Column) -> Column:
    """Hex sha256 of the fields: ``-`` for null, else the bytes of the value, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(f.cast("string")) for f in fields]), 256)


class Frontier:
    """The open subtrees of a row of leaves, and what each leaf's witness holds so far.

    A witness is a list of (left siblings, right siblings), from the leaf up.
    """

    def __init__(self):
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self._add(0, leaf, len(self.witness) - 1, len(self.witness))

    def _add(self, level: int, node: str, first: int, last: int) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, first, last))
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [node for node, _, _ in run]
        for i, (_, first, last) in enumerate(run):
            step = ("".join(names[:i]), "".join(names[i + 1 :]))
            for w in self.witness[first:last]:
                w.append(step)
        self._add(level + 1, _h("".join(names)), run[0][1], run[-1][2])

    def finish(self, alone: bool) -> str:
        """Close what is open: up to one node if the block is alone in its group, else up to a block's height."""
        level = 0
        while True:
            top = len(self.open[level]) == 1 and not any(self.open[level + 1 :]) if alone else level == HEIGHT
            if top:
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1


def _frontier(x: pa.Table) -> Frontier:
    f = Frontier()
    for d in x.column("digest").to_pylist():
        f.append(d)
    return f


def _root_of_block(x: pa.Table) -> pa.Table:
    x = x.sort_by("pos")
    root = _frontier(x).finish(x.column("alone")[0].as_py())
    return pa.table({"g": x.column("g")[:1], "pos": x.column("block")[:1], "digest": [root]})


_WITNESS = "array<struct<left:string,right:string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _steps(witness, outer) -> list[dict]:
    return [{"left": a, "right": b} for a, b in witness] + outer


def _witness_block(x: pa.Table, above: pa.Table) -> pa.Table:
    x = x.sort_by("pos")
    f = _frontier(x)
    f.finish(x.column("alone")[0].as_py())
    outer = above.column("witness")[0].as_py()
    return pa.table({"g": x.column("g"), "pos": x.column("pos"), "digest": x.column("digest"), "witness": pa.array([_steps(w, outer) for w in f.witness], _STEPS)})


def _proofs_of_block(x: pa.Table, above: pa.Table) -> pa.Table:
    """Each leaf's whole proof, hashed, and what the offered leaf folds to along it."""
    x = x.sort_by("pos")
    f = _frontier(x)
    f.finish(x.column("alone")[0].as_py())
    outer = [(s["left"], s["right"]) for s in above.column("witness")[0].as_py()]
    tail = "".join(a + b for a, b in outer).encode()
    proofs, folded = [], []
    for offered, w in zip(x.column("offered").to_pylist(), f.witness, strict=True):
        proofs.append(sha256("".join(a + b for a, b in w).encode() + tail).hexdigest())
        for a, b in w + outer:
            offered = _h(a + offered + b)
        folded.append(offered)
    same = lambda c: pa.array(above.column(c).to_pylist() * x.num_rows, pa.string())
    return pa.table({"id": x.column("id"), "leaf": x.column("digest"), "subroot": same("subroot"), "root": same("root"), "proof_sha256": proofs, "folded_root": folded})


class Manifest:
    """Rows of digests by group ``g``, in a folder that driver and executors share.

    ``append`` adds a batch behind what its groups hold.  It reads the open blocks
    only (fewer than 512 items of a group and level) and the batch; blocks that it
    closes are appended to the level above.  A batch whose id is in the folder's log is
    skipped, so a stream can offer it again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "manifest")
        try:
            log = spark.read.parquet(f"{self.path}/log").collect()  # a row a batch
        except AnalysisException:
            log = []
        self.batches = {r["batch"]: r["levels"] for r in sorted(log, key=lambda r: r["n"])}

    def _read(self, kind: str, level: int, batches: list) -> DataFrame | None:
        have = [f"{self.path}/{kind}{level}/{b}" for b in batches if self.batches[b] > level]
        return self.spark.read.parquet(*have) if have else None

    def _write(self, df: DataFrame, kind: str, level: int, batch: str) -> DataFrame:
        where = f"{self.path}/{kind}{level}/{batch}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def append(self, items: DataFrame, order: list[Column], batch: str = "0") -> None:
        """``items``: g (a string, never null), digest, id, offered; within a group by ``order``, which must tell unequal rows apart."""
        if batch in self.batches:
            return
        last = list(self.batches)[-1:]
        x = running_sums(items, [F.col("g"), *order], {"at": F.lit(1).cast("long")})
        first = x.groupBy("g").agg(F.min("at").alias("first"))
        x = x.join(first, "g").select("g", (F.col("at") - F.col("first")).alias("pos"), "digest", "id", "offered")
        level = 0
        while True:
            old = self._read("count", level, last)
            if level == 0 and old is not None:
                x = x.join(old, "g", "left").withColumn("pos", F.col("pos") + F.coalesce("n", F.lit(0))).drop("n")
            x = self._write(x, "items", level, batch)
            now = x.groupBy("g").agg((F.max("pos") + 1).alias("n"))
            if old is not None:
                now = now.union(old).groupBy("g").agg(F.max("n").alias("n"))
            now = self._write(now, "count", level, batch)
            before = self._read("open", level, last)
            x = x.select("g", "pos", "digest")
            x = x.union(before) if before is not None else x
            x = x.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(now, "g").withColumn("alone", F.lit(False))
            full = (F.col("block") + 1) * BLOCK <= F.col("n")
            self._write(x.where(~full).select("g", "pos", "digest"), "open", level, batch)
            up = x.where(full).groupBy("g", "block").applyInArrow(_root_of_block, "g string, pos long, digest string")
            level += 1
            x = cut(up, "closed")
            if x.isEmpty() and (not last or self.batches[last[0]] <= level):
                break
        log = self.spark.createDataFrame([(len(self.batches), batch, level)], "n long, batch string, levels int")
        log.write.mode("append").parquet(f"{self.path}/log")
        self.batches[batch] = level

    def levels(self) -> list[DataFrame]:
        """``g, pos, digest, block, alone`` by level, provisional roots included; the last level holds a row a group."""
        every, last = list(self.batches), list(self.batches)[-1:]
        out, extra = [], None
        while True:
            level = len(out)
            items, count, opened = (self._read(k, level, b) for k, b in (("items", every), ("count", last), ("open", last)))
            n = None if count is None else count
            if extra is not None:
                more = extra.select("g", (F.col("pos") + 1).alias("n"))
                n = more if n is None else n.union(more).groupBy("g").agg(F.max("n").alias("n"))
                bare = items.select("g", "pos", "digest").union(extra) if items is not None else extra
                items = bare
                opened = extra if opened is None else opened.union(extra)

            def dealt(x):
                return x.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(n, "g").withColumn("alone", F.col("n") <= BLOCK).drop("n")

            out.append(dealt(items))
            most = n.agg(F.max("n")).first()[0] or 0
            if most <= 1:
                return out
            extra = cut(dealt(opened).groupBy("g", "block").applyInArrow(_root_of_block, "g string, pos long, digest string"), "provisional")

    def proofs(self) -> DataFrame:
        """``id, leaf, subroot, root, proof_sha256, folded_root`` of every item; subroots by ``g`` are leaves of one more tree, which gives the root."""
        levels = self.levels()
        top = Manifest(self.spark)
        subroot = levels[-1].select("g", "digest")
        top.append(subroot.select(F.lit("").alias("g"), "digest", F.col("g").alias("id"), F.lit(None).cast("string").alias("offered")), [F.col("id")])
        rows = top.levels()
        above = _down(rows, rows[-1].select("g", "pos", F.expr(f"cast(array() as {_WITNESS})").alias("witness")))
        names = top._read("items", 0, ["0"]).select(F.col("id").alias("g"), "pos")
        root = rows[-1].select(F.col("digest").alias("root"))
        at = names.join(above.select("pos", "witness"), "pos").drop("pos").join(subroot.withColumnRenamed("digest", "subroot"), "g")
        at = cut(at.crossJoin(F.broadcast(root)), "subroots")  # the root is one row
        outer = _down(levels[1:], at.select("g", F.lit(0).cast("long").alias("pos"), "witness"))
        outer = outer.select("g", F.col("pos").alias("block"), "witness").join(at.drop("witness"), "g")
        met = levels[0].groupBy("g", "block").cogroup(outer.groupBy("g", "block"))
        return met.applyInArrow(_proofs_of_block, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def _down(levels: list[DataFrame], witness: DataFrame) -> DataFrame:
    """The witnesses of the lowest of ``levels``, from those (g, pos, witness) of the highest."""
    for level in reversed(levels[:-1]):
        above = witness.select("g", F.col("pos").alias("block"), "witness")
        met = level.select("g", "pos", "digest", "block", "alone").groupBy("g", "block").cogroup(above.groupBy("g", "block"))
        witness = cut(met.applyInArrow(_witness_block, f"g string, pos long, digest string, witness {_WITNESS}"), "witness")
    return witness


def document_items(docs: DataFrame, tampered: Column) -> DataFrame:
    """Items of ``docs``: g (``lang``, null before all), digest (the leaf), id, and the leaf offered for proof.

    ``tampered`` says of which rows the leaf with a text of lower-case A-Z is offered; null is no.
    """
    own = [F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang")), F.col("n_chars").cast("long"), F.col("text").cast("string")]
    lower = F.translate(own[4], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = digest(*own)
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), own[2]), F.lit("")).alias("g"),
        leaf.alias("digest"),
        own[0].cast("string").alias("id"),
        F.when(F.coalesce(tampered, F.lit(False)), digest(*own[:4], lower)).otherwise(leaf).alias("offered"),
        F.monotonically_increasing_id().alias("row"),
    )


def document_proofs(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    Leaves of a lang ascend by id, null first, and rows of one id by leaf.  Null
    fields are part of the leaf; rows without lang are a group of their own, the
    first.  Repeated rows are leaves each.  An empty table gives no rows.  Other
    columns are not read.  No task holds more than 512 leaves of a group.
    """
    spark = docs.sparkSession
    m = Manifest(spark)
    items = cut(document_items(docs, tampered), "leaves")
    m.append(items, [F.col("id").cast("long").asc_nulls_first(), F.col("digest"), F.col("row")])
    x = m.proofs()
    return x.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
