"""Operator 9, harmonic packing of documents into sequences of at most ``capacity`` tokens.

Lengths fall in classes by reciprocals of the capacity: class ``k`` holds lengths
over ``capacity / (k + 1)`` up to ``capacity / k``, and each of its bins takes
exactly ``k`` pieces. Full sequences are cut off a document first. What is left is
one piece where it wastes at most ``slack`` tokens of its share of a bin; else the
next class's whole share is cut off it, and so on. Each task packs its own pieces:
it numbers them by class, and the numbers of all tasks are joined by the counts of
the tasks before. The pieces that fill no bin of their class (fewer than ``k`` each,
so a bounded number in all) are laid end to end in sequences of full length; what
is left at the very end is cut into powers of two, which need no padding.

Defined results: a null text is an empty one, a document of its end token alone;
rows with the same doc_id are documents of their own; an empty table gives an
empty result; columns other than doc_id and text are ignored. Token ids are cut at
any place, each lies in exactly one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

CAPACITY = 2048
END_ID = 1
#: Tokens of padding accepted for a piece.
SLACK = 8


def cut_lengths(n: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """Pieces ``(length, class)`` of a document of ``n`` tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        share = capacity // (k + 1)
        if capacity - k * rest <= slack * k or not share:
            out.append((rest, k))
            break
        out.append((share, capacity // share))
        rest -= share
    return out


def _pieces(path: str, capacity: int, slack: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import defaultdict

        from pyspark import TaskContext

        from .token_ids import word_ids

        encode, task, numbers, serial = word_ids(path, special_as_text).encode, TaskContext.get().partitionId(), defaultdict(int), 0
        end = END_ID.to_bytes(4, "little")
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, at = encode(text) + end, 0
                total = len(ids) // 4
                for length, k in cut_lengths(total, capacity, slack):
                    for column, value in zip(rows, (serial, doc_id, at, ids[4 * at : 4 * (at + length)], total, k, numbers[k])):
                        column.append(value)
                    numbers[k] += 1
                    at += length
                    serial += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(rows, types)]
            tasks = pa.array([task] * len(rows[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([tasks, *columns], names=["task", "serial", "doc_id", "start", "ids", "doc_tokens", "k", "number"])

    return run


def _fit(capacity: int):
    """Cut leftover pieces, laid end to end, at multiples of the capacity and, at the very end, at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, start, ids, total, at, all_left in zip(*(batch.column(i).to_pylist() for i in range(6))):
                done, n = 0, len(ids) // 4
                while done < n:
                    here = at + done
                    begin = here // capacity * capacity
                    end, serial = begin + capacity, 0
                    if end > all_left:  # the last sequence falls into powers of two
                        part, left = begin, all_left - begin
                        while left:
                            size = 1 << (left.bit_length() - 1)
                            if here < part + size:
                                break
                            part, left, serial = part + size, left - size, serial + 1
                        begin, end = part, part + size
                    length = min(n - done, end - here)
                    row = (doc_id, start + done, ids[4 * done : 4 * (done + length)], total, here // capacity + serial, here - begin, length)
                    for column, value in zip(out, row):
                        column.append(value)
                    done += length
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "length"]
            )

    return run


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: int = SLACK, with_ids: bool = True,
    special_as_text: bool = False,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, asked for, ``ids`` (little-endian 32-bit).

    A control string in a text is its one id, as the library encodes it by default, or with ``special_as_text`` like other text.
    """
    scratch = Scratch(spark, "packing")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(tokenizer_path, capacity, slack, special_as_text),
        "task int, serial long, doc_id long, start long, ids binary, doc_tokens long, k int, number long",
    )
    pieces = scratch.save(cut, "pieces")
    counts = scratch.save(pieces.groupBy("task", "k").agg(F.count("*").alias("c")), "counts")
    classes = [(r["k"], r["n"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n")).orderBy("k").collect()]  # at most ``capacity``
    first, rows = 0, []
    for k, n in classes:
        rows.append((k, n // k * k, first))
        first += n // k
    known = spark.createDataFrame(rows, "k int, binned long, first long")
    # One row for each task and class: the pieces of the class in the tasks before.
    before = counts.select("task", "k", F.expr("coalesce(sum(c) over (partition by k order by task rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    before = scratch.save(before.join(F.broadcast(known), "k"), "before")
    own = ["doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens"]
    ranked = pieces.select("task", "serial", "k", "number", *own, *(["ids"] if with_ids else []))
    ranked = ranked.join(before, ["task", "k"]).withColumn("rank", F.col("before") + F.col("number"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    inside = "coalesce(sum(length) over (partition by sequence_id order by rank rows between unbounded preceding and 1 preceding), 0)"
    binned = ranked.where("rank < binned").withColumn("sequence_id", F.expr("first + rank div k")).withColumn("offset", F.expr(inside))
    # Fewer than k pieces of each class are left, under ``capacity * (1 + ln capacity)`` rows in all.
    left = ranked.where("rank >= binned").select("task", "serial", "k", "rank", "length")
    left = left.withColumn("at", F.expr("coalesce(sum(length) over (order by k, rank rows between unbounded preceding and 1 preceding), 0)"))
    left = scratch.save(left.select("task", "serial", "at", F.expr("sum(length) over ()").alias("all_left")), "left")
    left = pieces.select("task", "serial", "doc_id", "start", "ids", "doc_tokens").join(F.broadcast(left), ["task", "serial"])
    left = left.select("doc_id", "start", "ids", "doc_tokens", "at", "all_left").mapInArrow(
        _fit(capacity), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, length long"
    )
    left = left.withColumns({"ids_crc32": F.crc32("ids"), "sequence_id": F.col("sequence_id") + first})
    return binned.select(*names).unionByName(left.select(*names))
