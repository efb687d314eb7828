"""Balanced label propagation of documents over shards.

Equal texts are linked.  Linked documents start in pseudorandom shards; in each
round a document moves towards the shard that most of its group is in, of those
whose quota of linked documents has room, as far as it has, until none moves.
Documents without links fill the shards to sizes at most one apart, so balance
costs no cut edge as long as they last.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import cut, rank_in_groups

SHARDS = 16


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, cut_links`` for every document.

    ``size`` is the UTF-8 length of the text plus 1, ``law`` is ``rows``: shard
    sizes are at most one row apart.  ``slot`` is gapless from 0 in each shard;
    ``grown_shard`` is null, as that law moves rows when shards are added.
    ``cut_links`` counts the rows of equal text in other shards.

    A null ``doc_id`` is an id like others.  A null text counts as an empty one.  Rows with equal texts, repeated rows
    included, are linked; a group above a shard's quota is split over as few
    shards as have room.  Fewer rows than shards leave shards empty.  Other
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text), F.reverse(text)).alias("g"))
    x = cut(x, "documents")
    n = x.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]

    groups = x.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    start = F.pmod(F.xxhash64("doc_id", "g", F.lit(3)), F.lit(shards)).cast("int")
    linked = cut(x.join(groups, "g").withColumn("shard", start), "linked")
    while True:  # each round makes some groups' rows lie closer together, so that the rounds end
        held = linked.groupBy("g", "shard").agg(F.count("*").alias("n"))
        room = _room(held, [n // shards] * shards)
        # the fullest shard of the group among those with room; documents go there from emptier ones
        at = F.array(*[F.lit(r) for r in room])[F.col("shard")]
        best = held.groupBy("g").agg(F.max(F.struct((at > 0).alias("open"), "n", (-F.col("shard")).alias("s"))).alias("b"))
        fuller = (F.col("b.n") > F.col("n")) | ((F.col("b.n") == F.col("n")) & (-F.col("b.s") < F.col("shard")))
        plan = held.join(best, "g").select("g", "shard", (-F.col("b.s")).alias("best"), (F.col("b.open") & fuller).alias("go"))
        state = cut(linked.join(plan, ["g", "shard"]), "state")
        wish = state.where("go").select("doc_id", "size", "text_crc32", "g", "shard", "best")
        wish = rank_in_groups(wish, ["best"], [F.col("g"), F.col("doc_id")], ["g", "doc_id"], "place")
        room_of = F.array(*[F.lit(r) for r in room])[F.col("best")]
        moved = wish.withColumn("shard", F.when(F.col("place") < room_of, F.col("best")).otherwise(F.col("shard")))
        linked = cut(state.where("not go").select(*linked.columns).union(moved.select(*linked.columns)), "linked")
        if not state.where("go").limit(1).count():
            break

    # linked documents above a shard's quota and those without links fill what is free
    full = F.array(*[F.lit(q) for q in quota])[F.col("shard")]
    linked = cut(rank_in_groups(linked, ["shard"], [F.col("g"), F.col("doc_id")], ["g", "doc_id"], "place").withColumn("fits", F.col("place") < full), "fits")
    kept = linked.where("fits").select("doc_id", "size", "text_crc32", "g", "shard")
    loose = x.join(groups, "g", "left_anti").select("doc_id", "size", "text_crc32", "g")
    pool = loose.union(linked.where("not fits").select("doc_id", "size", "text_crc32", "g"))
    free = _room(kept.groupBy("shard").agg(F.count("*").alias("n")), quota)
    ends = [sum(free[: s + 1]) for s in range(shards)]
    pool = rank_in_groups(cut(pool.withColumn("all", F.lit(0)), "pool"), ["all"], [F.col("g"), F.col("doc_id")], ["g", "doc_id"], "place")
    pool = pool.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place"))))
    done = cut(kept.union(pool.select("doc_id", "size", "text_crc32", "g", F.col("shard").cast("int"))), "shards")
    done = rank_in_groups(done, ["shard"], [F.col("g"), F.col("doc_id")], ["g", "doc_id"], "slot")
    inside = linked.select("g").distinct().join(done, "g").groupBy("g", "shard").agg(F.count("*").alias("n"))
    links = inside.join(inside.groupBy("g").agg(F.sum("n").alias("all")), "g").where(F.col("n") < F.col("all")).select("g", "shard", (F.col("all") - F.col("n")).alias("cut_links"))
    done = done.join(links, ["g", "shard"], "left").withColumn("cut_links", F.coalesce("cut_links", F.lit(0).cast("long")))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cut_links")


def _room(held: DataFrame, quota: list[int]) -> list[int]:
    """Free rows of each shard: one number a shard comes to the driver."""
    used = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [max(0, q - used.get(s, 0)) for s, q in enumerate(quota)]
