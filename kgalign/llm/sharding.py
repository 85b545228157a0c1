"""Operator 1, sharding by balanced label propagation.

Documents that share a link key (here: the same text) are neighbours. Each
starts in a shard given by the hash of its id; then, in rounds of joins, linked
documents move to the shards where most of their neighbours are, as far as the
capacity of these allows. A last step evens the shards out to the row: surplus
rows, unlinked ones first, fill the holes of other shards.

Defined results: a null text counts 0 bytes and links with nothing; an empty
text is a text like others; a long text is hashed as a whole; rows with the same
doc_id move together, except where the last step parts them; a null doc_id is a row
like others; ties in a shard fall by doc_id, size and checksum, and rows equal in these
are interchangeable; an empty table gives an empty result; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_sum

#: Bytes counted for each document beside its text.
ROW_BYTES = 16


def _start(doc_id: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def _chosen(values: list, index: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[index]


def propagate(scratch: Scratch, links: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """Shards ``(doc_id, shard)`` of the documents in ``links(doc_id, key)``.

    ``capacity`` is the number of linked documents a shard may take. What goes
    to the driver is one number for each pair of shards.
    """
    sizes = links.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    # A table of its own: the join with a hot key's rows can then be split, here and below.
    sizes = scratch.save(sizes.where("n > 1 and lo <> hi").select("key", "n"), "sizes")
    links = scratch.save(links.join(sizes, "key"), "links")
    state = scratch.save(links.groupBy("doc_id").agg(F.lit(0)).select("doc_id", _start("doc_id", shards).alias("shard")), "state")
    for turn in range(rounds):
        load = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        room = [max(0, capacity - load.get(s, 0)) for s in range(shards)]
        placed = scratch.save(links.join(state, "doc_id"), "placed")
        held = placed.groupBy("key", "shard").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        # A group larger than a shard wants as many shards as it fills; others want one.
        ranked = held.groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.xxhash64("key", "shard").alias("tie"), "shard"))).alias("by_count"),
            F.ceil(F.max("n") / F.lit(max(1, capacity))).cast("int").alias("k"),
        )
        ranked = ranked.select(
            "key",
            F.expr("transform(slice(by_count, 1, k), x -> x.shard)").alias("home"),
            F.slice(F.filter("by_count", lambda x: _chosen([r > 0 for r in room], x["shard"])), 1, F.col("k")).alias("free"),
        ).withColumn("free", F.expr("transform(free, x -> x.shard)"))
        ranked = scratch.save(ranked, "ranked")
        wish = placed.join(ranked, "key").where("not array_contains(home, shard) and size(free) > 0")
        wish = wish.select(
            "doc_id", "shard", "n",
            F.expr("free[cast(pmod(xxhash64(doc_id, 7), size(free)) as int)]").alias("target"),
            F.when(F.col("n") * 8 > capacity, F.xxhash64("doc_id", F.lit(turn))).otherwise(F.xxhash64("key", F.lit(turn))).alias("draw"),
        ).where("target <> shard")
        # A document with several keys follows the largest group that wants it elsewhere.
        wish = wish.groupBy("doc_id", "shard").agg(F.max_by(F.struct("target", "draw"), F.struct("n", "target", "draw")).alias("w"))
        wish = scratch.save(wish.select("doc_id", "w.target", "w.draw"), "wish")
        asked = {r["target"]: r["count"] for r in wish.groupBy("target").count().collect()}
        if not asked:
            break
        quota = [min(1.0, room[s] / asked[s]) if s in asked else 0.0 for s in range(shards)]
        moved = wish.where(F.pmod("draw", F.lit(1 << 20)) < _chosen(quota, F.col("target")) * (1 << 20)).select("doc_id", "target")
        new = scratch.save(state.join(moved, "doc_id", "left").select("doc_id", F.coalesce("target", "shard").alias("shard")), "state")
        for old in (state, placed, ranked, wish):
            scratch.drop(old)
        state = new
    return state


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 40, rounds: int = 5) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the law is ``rows``."""
    scratch = Scratch(spark, "sharding")
    rows = scratch.save(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("key"),
        ),
        "rows",
    )
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    state = propagate(scratch, rows.where("key is not null and doc_id is not null").select("doc_id", "key"), shards, total // shards, rounds)
    placed = rows.join(state.withColumn("linked", F.lit(True)), "doc_id", "left")
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        F.coalesce("shard", _start("doc_id", shards)).alias("shard"),
        F.when(F.col("linked"), 0).otherwise(1).alias("kind"),
        F.when(F.col("linked"), F.col("key")).otherwise(F.lit(b"")).alias("near"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = scratch.save(placed, "placed")
    load = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    ranked = running_sum(scratch, placed, ["shard"], ["kind", "near", "doc_id", "size", "text_crc32"], "one", "rank")
    shift, begins, surplus = [], [], 0
    for s in range(shards):
        shift.append(surplus - quota[s])
        surplus += max(0, load.get(s, 0) - quota[s])
    hole = 0
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        if (free := quota[s] - load.get(s, 0)) > 0:
            begins.append((s, hole, hole + free))
            hole += free
    at = F.col("rank") + _chosen(shift, F.col("shard"))
    for s, lo, hi in reversed(begins):
        to = F.when(F.col("at") < hi, F.lit(s)).otherwise(to)
        slot = F.when(F.col("at") < hi, F.col("at") - lo + load.get(s, 0)).otherwise(slot)
    stays = F.col("rank") < _chosen(quota, F.col("shard"))
    return ranked.withColumn("at", at).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.when(stays, F.col("shard")).otherwise(to).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
