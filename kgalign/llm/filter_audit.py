"""Operator 13, audit of how filters interact, over every order in which they can be applied.

A document is a mask of the filters it fails. Only the counts of the masks of each part go
on, at most ``2 ** filters`` cells, so a part's size doesn't matter. The orders are visited by
swaps of two neighbours (the walk of Steinhaus, Johnson and Trotter): a swap changes only
the two steps it touches, whose values are read from the cells again; the other steps stand.
What each filter removes is added up along the walk: its Shapley value, times the number of
orders.

Condition E needs the least doc_id of each text in the whole table: texts are reduced to
128-bit hashes where they are read, and only these and a few bytes a document are shuffled.

Defined results: a null text is an empty one, and equal to it; a null source is the part
``""``, as an empty one is; a null doc_id is no smaller than any and none is smaller; rows
of the same doc_id and text are no copies of each other; a document is good, or toxic, where any row of
``labels`` for its doc_id says so, and neither without one; every row counts, repeated ones too; long
texts are read whole, by one row each; ties don't occur, since steps are sums; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch

#: The orders of so many filters are listed: 8! = 40,320 for each part.
MAX_FILTERS = 8
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counts of a cell: documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")


def text_conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    n, chars = F.size(words), F.char_length(text)
    return {
        "A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * (chars - F.char_length(F.translate(text, UPPER, ""))) > 5 * chars, "D": F.char_length(F.translate(text, SYMBOLS, "")) < chars,
    }


def transpositions(n: int) -> Iterator[int]:
    """The places ``i`` whose item is swapped with the next one, ``n! - 1`` of them, so that every order of ``n`` items is met once."""
    if n < 2:
        return
    inner, at, step = transpositions(n - 1), n - 1, -1
    while True:
        # The last item walks through the others, then they make one swap beside it, and it walks back.
        for _ in range(n - 1):
            yield min(at, at + step)
            at += step
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + (at == 0)
        step = -step


def _walk(names: str):
    """Rows of all orders and steps for each part, a row ``part, cells`` with its cells' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n = len(names)
        masks = np.arange(1 << n)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, lists = batch.column(0), batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            cells = {c: np.zeros((batch.num_rows, 1 << n), dtype=np.int64) for c in COUNTS}
            flat = lists.flatten()
            for c in COUNTS:
                cells[c][row, flat.field("mask").to_numpy()] = flat.field(c).to_numpy()
            fails = [cells["n"][:, (masks >> f) & 1 == 1].sum(axis=1) for f in range(n)]
            alone = [cells["n"][:, 1 << f] for f in range(n)]
            total = np.zeros((n, batch.num_rows), dtype=np.int64)  # of each filter, what it removed in the orders so far

            def step(before: int, f: int) -> dict:
                """The counts of one step: filter ``f`` after the filters of the mask ``before``."""
                here = (masks & before == 0) & ((masks >> f) & 1 == 1)
                out = {k: cells[c][:, here].sum(axis=1) for k, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))}
                return out | {"kept": cells["n"][:, masks & (before | 1 << f) == 0].sum(axis=1), "redundant": fails[f] - out["removed"], "unique_fails": alone[f]}

            order, before, at = list(range(n)), 0, []
            for f in order:
                at.append(step(before, f))
                before |= 1 << f
            orders, found = [], []

            def visit():
                orders.append("".join(names[f] for f in order))
                found.append(list(at))
                for f, x in zip(order, at):
                    total[f] += x["removed"]

            visit()
            for i in transpositions(n):
                order[i], order[i + 1] = order[i + 1], order[i]
                before = sum(1 << f for f in order[:i])
                at[i], at[i + 1] = step(before, order[i]), step(before | 1 << order[i], order[i + 1])
                visit()
            size = batch.num_rows
            for name, steps in zip(orders, found):
                columns = {"part": pa.concat_arrays([parts] * n), "filter_order": pa.array([name] * (n * size)), "step": pa.array(np.repeat(np.arange(1, n + 1, dtype=np.int32), size))}
                for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    columns[k] = pa.array(np.concatenate([x[k] for x in steps]))
                columns["shapley"] = pa.array(np.concatenate([total[names.index(f)] for f in name]))
                yield pa.RecordBatch.from_pydict(columns)

    return run


ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(rows: DataFrame, names: str) -> DataFrame:
    """Rows ``part, filter_order, step`` and their counts, of ``rows(part, mask, good, toxic)``: bit i of the mask says that filter ``names[i]`` fails."""
    if not 0 < len(names) <= MAX_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MAX_FILTERS} filters with names of one letter each, all different")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # of at most 2 ** filters cells
    # A batch of parts takes one walk and writes as many rows for each part as there are steps in all orders.
    return lists.mapInArrow(_walk(names), ROWS)


def failures(scratch: Scratch, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``part, mask, good, toxic`` of the five conditions A to E, one for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_conditions(text).values())), F.lit(0))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("key"), mask.cast("int").alias("mask"))
    slim = scratch.save(slim, "masks")
    # Tables of their own, so that the joins with a hot text or doc_id can be split.
    least = slim.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Both grow with the documents, so neither is to be broadcast, however small its file may look.
    least, known = scratch.save(least, "least").hint("merge"), scratch.save(known.where("good = 1 or toxic = 1"), "known").hint("merge")
    rows = slim.join(least, "key", "left").join(known, "doc_id", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("least")).cast("int"), F.lit(0))
    return rows.select("part", (F.col("mask") + copy * 16).alias("mask"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the filters A to E over ``docs(doc_id, text, source)`` and ``labels(doc_id, quality, toxic)``."""
    return audit(failures(Scratch(spark, "audit"), docs, labels), "ABCDE")
