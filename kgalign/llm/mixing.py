"""Operator 5, mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots of ``block_words`` words each. Slot ``i`` has the
point ``frac(i * golden ratio)``; the cumulative target shares say which source
owns it. Each source's slots are ranked, and its ``j``-th slot takes the
``j``-th equal block of the source's shuffled words, going round the source
again where its target is larger than its size. A source's last slot is cut so
that the words taken meet the target to the word.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. Targets
share all words by weight; none exceeds ``max_repeats`` times its source's size,
and what is over is shared again by weight.

Defined results: a null text has no words; documents without words are never
taken; a long text lies in as many blocks as it needs; the order inside a source is the
hash of doc_id and text, so it does not depend on the input's order, and rows with the
same doc_id and text, a null doc_id among them, are interchangeable; an empty table
gives an empty result; other columns are ignored, or passed on by ``mixed_documents``. Up to ``MAX_SOURCES`` sources are a list, held by the driver
and every chunk of the schedule; more are a table, with the same results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, free_name, running_sum, shuffle_partitions, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
MAX_SOURCES = 4096
#: Points are multiples of 1 / MODULUS; the step is the golden ratio's fraction of it, made odd.
MODULUS = 1 << 31
GOLDEN_STEP = 1327217885
#: The schedule is ranked by chunks; there are at most MAX_CHUNKS, of MIN_CHUNK slots or more.
MIN_CHUNK, MAX_CHUNKS = 1 << 14, 1 << 16


def targets(sizes: list[int], weights: list[int], max_repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Targets that share ``sum(sizes)`` by weight, none above ``max_repeats`` times its size."""
    out, free, left = [Fraction(0)] * len(sizes), [i for i, n in enumerate(sizes) if n], Fraction(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > max_repeats * sizes[i] * total]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(max_repeats * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _owners(chunk: int, size: int, n: int, bounds: list[int]):
    """The slots of a chunk and the source number of each."""
    import numpy as np

    slot = np.arange(chunk * size, min(n, (chunk + 1) * size), dtype=np.int64)
    return slot, np.searchsorted(np.array(bounds, dtype=np.int64), slot % MODULUS * GOLDEN_STEP % MODULUS, side="right")


def _count_chunks(size: int, n: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                found = np.bincount(_owners(chunk, size, n, bounds)[1], minlength=len(bounds) + 1)
                ids = pa.array(np.full(len(found), chunk, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found.astype(np.int64))], names=["chunk", "k", "c"])

    return run


def _rank_chunks(size: int, n: int, bounds: list[int], quota: list[int], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        most = np.array(quota, dtype=np.int64)
        for batch in batches:
            for chunk, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slot, k = _owners(chunk, size, n, bounds)
                order = np.argsort(k, kind="stable")
                sorted_k = k[order]
                first = np.searchsorted(sorted_k, np.arange(len(most)))
                j = np.empty(len(k), dtype=np.int64)
                j[order] = np.arange(len(k)) - first[sorted_k] + np.array(before, dtype=np.int64)[sorted_k]
                take = np.minimum(block, most[k] - j * block)
                ok = take > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[ok].astype(np.int32)), pa.array(j[ok]), pa.array(slot[ok]), pa.array(take[ok])], names=["k", "j", "slot", "take"]
                )

    return run


def _drawn(total: int, sources: int) -> int:
    """Slots to draw: a few more than wanted, so that few are lacking."""
    return total + total // 64 + 64 * min(sources, 4096)


def schedule(spark: SparkSession, quota: list[int], block: int = BLOCK_WORDS) -> DataFrame:
    """Slots ``k, j, slot, take``: source number, rank in the source, place in the schedule, words to take.

    Points leave gaps wider than a small source's interval, so a source may own fewer
    slots than wanted; those it lacks stand after the last one drawn.
    """
    wanted = [-(-q // block) for q in quota]
    total = max(1, sum(wanted))
    n = _drawn(total, len(quota))
    done, bounds = 0, []
    for w in wanted[:-1]:
        done += w
        bounds.append(done * MODULUS // total)
    size = max(MIN_CHUNK, -(-n // MAX_CHUNKS))
    chunks = spark.range(0, -(-n // size), 1, min(-(-n // size), 4 * shuffle_partitions(spark))).withColumnRenamed("id", "chunk")
    counts = Scratch(spark, "schedule").save(chunks.mapInArrow(_count_chunks(size, n, bounds), "chunk long, k int, c long"), "counts")
    before = counts.select("chunk", "k", F.expr("sum(c) over (partition by k order by chunk rows between unbounded preceding and 1 preceding)").alias("c"))
    before = before.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("c", F.lit(0)).alias("c")))).alias("x"))
    ranked = before.select("chunk", F.expr("transform(x, y -> y.c)").alias("before"))
    drawn = ranked.mapInArrow(_rank_chunks(size, n, bounds, quota, block), "k int, j long, slot long, take long")
    got = {r["k"]: r["c"] for r in counts.groupBy("k").agg(F.sum("c").alias("c")).collect()}  # one number for each source
    lacking, at = [], n
    for k, w in enumerate(wanted):
        if got[k] < w:
            lacking.append((k, got[k], w, at, quota[k]))
            at += w - got[k]
    late = spark.createDataFrame(lacking, "k int, got long, wanted long, at long, quota long")
    late = late.select("k", "got", "at", "quota", F.expr("explode(sequence(got, wanted - 1))").alias("j"))
    return drawn.unionByName(late.select("k", "j", (F.col("at") + F.col("j") - F.col("got")).alias("slot"), F.expr(f"least({block}L, quota - j * {block})").alias("take")))


def _source_table(scratch: Scratch, sizes: DataFrame, block: int, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``name, k, source_size, target, quota, wanted`` of ``sizes(source, n)``: ranks and ``targets`` without a list."""
    ordered = scratch.save(sizes.select(F.col("source").alias("name"), F.col("source").isNull().alias("_null"), "n", F.lit(1).alias("_one")), "sizes")
    ranked = running_sum(scratch, ordered, [], ["_null", "name"], "_one", "k")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int")).cast("long")
    rows = scratch.save(ranked.select("name", "k", "n", weight.alias("w")), "ranked")
    words, shares = rows.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left, free, over = words, shares, F.lit(False)
    while free:
        # The share of a free source grows from round to round, so that what was over the limit once stays over it.
        most = F.coalesce(*[F.when(F.col("w") == w, F.lit((left * w - 1) // (max_repeats * free))) for w in sorted(set(WEIGHTS))])
        over = (F.col("n") > 0) & (F.col("n") <= most)
        n, w = rows.where(over).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if (left, free) == (words - max_repeats * n, shares - w):
            break
        left, free = words - max_repeats * n, shares - w
    given, rest = F.expr(f"({left}L * w) div {max(1, free)}L"), F.expr(f"2 * (({left}L * w) % {max(1, free)}L)")
    up = (rest > free) | ((rest == free) & (given % 2 == 1))  # halves go to the even number, as in Python
    share = F.expr(f"cast({left}L * w as double) / cast({max(1, free)}L as double)")
    out = rows.withColumns({
        "target": F.when(F.col("n") == 0, 0.0).when(over, (max_repeats * F.col("n")).cast("double")).otherwise(share),
        "quota": F.when(F.col("n") == 0, 0).when(over, max_repeats * F.col("n")).otherwise(given + F.when(up, 1).otherwise(0)).cast("long"),
    })
    out = out.withColumn("wanted", F.expr(f"(quota + {block - 1}) div {block}"))
    return scratch.save(out.select("name", "k", F.col("n").alias("source_size"), "target", "quota", "wanted"), "source_table")


def _schedule_of_table(scratch: Scratch, sources: DataFrame, block: int) -> DataFrame:
    """``schedule`` of the saved table ``sources(k, quota, wanted)``."""
    count, total = sources.agg(F.count("*"), F.sum("wanted")).first()
    total = max(1, total)
    n = _drawn(total, count)
    bounds = running_sum(scratch, sources.select("k", "wanted"), [], ["k"], "wanted", "done").where("k > 0")
    bounds = bounds.select(F.expr(f"cast(cast(done as decimal(20)) * {MODULUS} div {total} as long)").alias("p"), F.lit(-1).cast("long").alias("slot"), F.lit(1).alias("_bound"))
    points = scratch.spark.range(n).select(F.expr(f"id % {MODULUS} * {GOLDEN_STEP} % {MODULUS}").alias("p"), F.col("id").alias("slot"), F.lit(0).alias("_bound"))
    # A point's source is the number of bounds up to it.
    owners = running_sum(scratch, scratch.save(bounds.unionByName(points), "points"), [], ["p", "slot"], "_bound", "k").where("slot >= 0")
    owners = scratch.save(owners.select("k", "slot", F.lit(1).alias("_one")), "owners")
    limits = sources.select("k", "quota", "wanted")
    drawn = running_sum(scratch, owners, ["k"], ["slot"], "_one", "j").join(limits, "k").select("k", "j", "slot", "quota")
    got = owners.groupBy("k").agg(F.count("*").alias("got"))
    lacking = limits.join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < wanted").withColumn("lack", F.expr("wanted - got"))
    late = running_sum(scratch, scratch.save(lacking, "lacking"), [], ["k"], "lack", "at")
    late = late.select("k", "got", "at", "quota", F.expr("explode(sequence(got, wanted - 1))").alias("j"))
    slots = drawn.unionByName(late.select("k", "j", (F.lit(n) + F.col("at") + F.col("j") - F.col("got")).alias("slot"), "quota"))
    return slots.select("k", "j", "slot", F.expr(f"least({block}L, quota - j * {block})").alias("take")).where("take > 0")


def _listed(spark: SparkSession, found: list, block: int) -> tuple[DataFrame, DataFrame]:
    """The sources to broadcast and the schedule, from a list of ``source, n``."""
    # Python compares strings by code point.
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    aims = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    quota = [round(x) for x in aims]
    names = spark.createDataFrame(
        [(r["source"], k, sizes[k], float(aims[k]), quota[k]) for k, r in enumerate(found)],
        "name string, k int, source_size long, target double, quota long",
    )
    return F.broadcast(names), schedule(spark, quota or [0], block)  # at most MAX_SOURCES rows


def _mixed(scratch: Scratch, rows: DataFrame, block: int) -> DataFrame:
    """``_row, size, source_size, target, taken, first_slot`` for saved ``rows(_row, doc_id, source, size, _text)``; ``_text`` is a hash."""
    spark = scratch.spark
    sizes = rows.groupBy("source").agg(F.sum("size").alias("n"))
    found = sizes.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        names = _source_table(scratch, sizes, block)
        slots = _schedule_of_table(scratch, names, block)
    else:
        names, slots = _listed(spark, found, block)
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("name")))
    keyed = scratch.save(rows.select("_row", "doc_id", "size", "k", "source_size", "target", "quota", F.xxhash64("doc_id", "_text", F.lit(5)).alias("h")), "keyed")
    placed = running_sum(scratch, keyed.where("size > 0"), ["k"], ["h", "doc_id", "size", "_row"], "size", "at")
    # Where each document lies in the source's words, for every round through the source that the quota reaches.
    laps = placed.select("_row", "k", "size", "quota", F.expr("explode(transform(sequence(0, greatest(0, cast((quota - 1) div source_size as int))), q -> at + q * source_size))").alias("at"))
    laps = laps.where("at < quota")
    pieces = laps.select("_row", "k", "size", "at", F.expr(f"explode(sequence(at div {block}, (least(at + size, quota) - 1) div {block}))").alias("j"))
    # The slots are as many as the words allow; their size is not in the statistics of what makes them.
    met = pieces.join(slots.hint("merge"), ["k", "j"]).select("_row", "slot", F.expr(f"least(at + size, j * {block} + take) - greatest(at, j * {block})").alias("words"))
    taken = met.where("words > 0").groupBy("_row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return keyed.join(taken, "_row", "left").select(
        "_row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def mix_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``doc_id, size, source_size, target, taken, first_slot``, one for each document."""
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row")
    )
    return _mixed(scratch, scratch.save(rows, "rows"), block).drop("_row")


def _cut(names: list[str], size_name: str, taken_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            index, texts = [], []
            for i, (text, size, taken) in enumerate(zip(*(columns[x].to_pylist() for x in ("text", size_name, taken_name)))):
                index += [i] * (taken // size)
                texts += [text] * (taken // size)
                if rest := taken % size:
                    for n, found in enumerate(word.finditer(text), 1):
                        if n == rest:
                            index.append(i)
                            texts.append(text[: found.end()])
                            break
            columns["text"] = pa.array(texts, pa.string())
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] if n == "text" else columns[n].take(at) for n in names], names=names)

    return run


def mixed_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time cut after the words taken."""
    scratch = Scratch(spark, "mixing")
    row, words, size, cut = (free_name(docs, n) for n in ("_row", "_words", "_size", "_taken"))
    rows = scratch.save(docs.withColumns({row: F.monotonically_increasing_id(), words: word_count(F.col("text"))}), "rows")
    taken = _mixed(scratch, rows.select(F.col(row).alias("_row"), "doc_id", "source", F.col(words).alias("size"), F.xxhash64("text").alias("_text")), block)
    taken = taken.where("taken > 0").select(F.col("_row").alias(row), F.col("size").alias(size), F.col("taken").alias(cut))
    schema = T.StructType(docs.schema.fields)
    return rows.drop(words).join(taken.hint("shuffle_hash"), row).mapInArrow(_cut(schema.names, size, cut), schema)
