"""One large JSON object read by many tasks.

A file that holds one object, keyed by name or id, is one value for Spark's JSON reader. Here it is read as text that ends at a
mark which also ends records in JSON, so that byte ranges of a file are read by different tasks. Whether a mark stands in a string,
and how deep, depends on all that is before it; that takes two passes: the first tells what a range adds, quotes and depth, for
either way it may begin; sums of these over the ranges of a file, a few numbers each, give the state in which each begins; then each
range is cut at the commas of the object itself. Entries that go over the end of a range are put together last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import workers_find_package, written
from .files import CANDIDATE

_ESCAPE = re.compile(rb"\\.", re.DOTALL)


def _marks(text: bytes, in_string: bool):
    """Bytes of ``text`` outside strings, others as 0, and whether its end is in a string."""
    import numpy as np

    plain = np.frombuffer(_ESCAPE.sub(b"..", text), dtype=np.uint8)  # what is escaped ends no string
    quotes = np.cumsum(plain == 34) + in_string
    return np.where(quotes % 2 == 0, plain, 0), bool(quotes[-1] % 2) if len(plain) else in_string


def _steps(marks):
    """How each byte changes the depth."""
    import numpy as np

    return ((marks == 123) | (marks == 91)).astype(np.int64) - ((marks == 125) | (marks == 93)).astype(np.int64)


def _by_range(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple]:
    """``file, start, text`` of consecutive rows ``value, file, start`` of a range, each value with its mark again."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in (1, 2, 0))
        at = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (files[i], starts[i]) != (files[at], starts[at]):
                yield files[at], starts[at], b"".join(v.encode() + mark for v in values[at:i])
                at = i


def _states(mark: bytes):
    """What each range adds: ``file, start, quotes, depth0, depth1``, its depth if it begins outside or inside a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth = None, [False, True], [0, 0]

        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (*now, int(inside[0]), *depth)], names=["file", "start", "quotes", "depth0", "depth1"]
            )

        for file, start, text in _by_range(batches, mark):
            if (file, start) != now:
                if now is not None:
                    yield told()
                now, inside, depth = (file, start), [False, True], [0, 0]
            for way in (0, 1):
                marks, inside[way] = _marks(text, inside[way])
                depth[way] += int(_steps(marks).sum())
        if now is not None:
            yield told()

    return run


def _cut(mark: bytes):
    """Pieces of entries of each range: ``file, start, number, whole, piece``; the first and the last one of a range are not whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows(file, start, number, pieces, whole):
            n = len(pieces)
            columns = [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(whole, pa.bool_()), pa.array(pieces, pa.string())], names=["file", "start", "number", "whole", "piece"])

        now, held, number, inside, depth = None, b"", 0, False, 0
        for batch in batches:
            known = dict(zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())))
            for file, start, text in _by_range([batch], mark):
                if (file, start) != now:
                    if now is not None:
                        yield rows(*now, number, [held.decode()], [False])
                    now, held, number = (file, start), b"", 0
                    inside, depth = known[now]
                    inside = bool(inside)
                marks, inside = _marks(text, inside)
                step = _steps(marks)
                level = np.cumsum(step) + depth
                depth = int(level[-1])
                # The object's own braces, and what is before and after it, are no part of an entry.
                data = np.frombuffer(text, dtype=np.uint8).copy()
                data[((level <= 0) & (marks != 0)) | ((level == 1) & (step == 1))] = 32
                cuts = np.flatnonzero((marks == 44) & (level == 1)).tolist()
                data, at, out = data.tobytes(), 0, []
                for c in cuts:
                    out.append((held + data[at:c]).decode())
                    held, at = b"", c + 1
                held += data[at:]
                if out:
                    yield rows(file, start, number, out, [number + i > 0 for i in range(len(out))])
                    number += len(out)
        if now is not None:
            yield rows(*now, number, [held.decode()], [False])

    return run


def read_json_object(spark: SparkSession, path: str, value: T.DataType = CANDIDATE) -> DataFrame:
    """``key, value`` of the JSON objects in a file or folder, one object a file, each read in byte ranges.

    Values of a struct end at ``}``, others at ``,``: there a range may begin. Values that don't parse are null.
    """
    workers_find_package(spark)
    mark = "}" if isinstance(value, T.StructType | T.MapType) else ","
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", mark).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    states = lines.mapInArrow(_states(mark.encode()), "file string, start long, quotes long, depth0 long, depth1 long")
    # A row for each range.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    added = F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    states = written(states.select("file", "start", "inside", F.coalesce(F.sum(added).over(before), F.lit(0)).alias("depth")))
    # Rows of a range stay together and in order: the few states are looked up where the rows are.
    begun = lines.join(F.broadcast(states), ["file", "start"]).select("value", "file", "start", "inside", "depth")
    pieces = written(begun.mapInArrow(_cut(mark.encode()), "file string, start long, number long, whole boolean, piece string"))
    # Pieces that are not whole, two for each range: one that follows the last cut of a range begins an entry, those before the next cut go on with it.
    ends = pieces.where("not whole")
    entry = F.sum(F.when(F.col("number") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "number"))
    ends = ends.withColumn("entry", entry).groupBy("file", "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "number", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    whole = pieces.where("whole").select("piece").unionByName(ends.select("piece"))
    parsed = whole.where(F.trim("piece", F.lit(" \t\r\n")) != "").select(F.from_json(F.concat(F.lit("{"), "piece", F.lit("}")), T.MapType(T.StringType(), value)).alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))
