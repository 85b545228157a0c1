"""Token frequencies and token ids of texts ``id, content``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..storage import workers_find_package, written

if TYPE_CHECKING:
    import pyarrow as pa

#: Arrow bytes of the tokens of a bundle: what a task numbers at a time.
BUNDLE_BYTES = 32 << 20


def token_frequencies(texts: DataFrame, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """``token, n``, most frequent first, ties by token."""
    return texts.select(F.explode(tokenize(F.col("content"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token")


def token_sequences(texts: DataFrame, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    return texts.select("id", tokenize(F.col("content")).alias("tokens"))


def _bundle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, lists = (pa.concat_arrays([p.column(k) for p in parts]) for k in range(2))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    codes, names = coded.indices.to_numpy(), coded.dictionary
    # A token's first place: the smallest id, then the place in that text.
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    row = np.zeros(len(ids) + 1, dtype=np.int64)
    row[rank] = np.arange(len(ids))
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, codes, np.repeat(rank << 32, lengths) | at)
    lists = [ids, pa.array(lengths, pa.int32()), names, ids.take(pa.array(row[first >> 32])), pa.array(first & 0xFFFFFFFF, pa.int32())]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays([*columns, pa.array([codes.astype("<i4").tobytes()], pa.binary())], names=["ids", "lengths", "names", "first_ids", "first_ats", "codes"])


def _bundles(bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                held.append(batch.slice(i, 16))
                size += held[-1].column(1).nbytes
                if size >= bundle_bytes:
                    yield _bundle(held)
                    held, size = [], 0
        if held:
            yield _bundle(held)

    return run


def bundled(texts: DataFrame, tokenize: Callable[[Column], Column] = words, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Texts of a task side by side, a row for each bundle: ``ids, lengths``, each distinct token once (``names``, with its first
    place by id in ``first_ids, first_ats``), all texts' tokens as numbers in ``names`` (``codes``), and a number ``bundle``."""
    workers_find_package(texts.sparkSession)
    rows = texts.select("id", tokenize(F.col("content")).alias("tokens"))
    kind = rows.dtypes[0][1]
    shape = f"ids array<{kind}>, lengths array<int>, names array<string>, first_ids array<{kind}>, first_ats array<int>, codes binary"
    return written(rows.mapInArrow(_bundles(bundle_bytes), shape).withColumn("bundle", F.monotonically_increasing_id()))


def names_of(bundles: DataFrame) -> DataFrame:
    """``name, pos`` of the bundles' tokens, for ``graph.dictionary``: a token once for each bundle, with its first place there."""
    each = bundles.select(F.explode(F.arrays_zip("names", "first_ids", "first_ats")).alias("x"))
    return each.select(F.col("x.names").alias("name"), F.struct(F.col("x.first_ids").alias("id"), F.col("x.first_ats").alias("at")).alias("pos"))


def _numbered(key: tuple, bundle: pa.Table, known: pa.Table) -> pa.Table:
    """The texts of a bundle, with the ids that ``known(code, token_id)`` has for their tokens: none, one or several each."""
    import numpy as np
    import pyarrow as pa

    ids, lengths = (bundle.column(c).chunk(0).flatten() for c in ("ids", "lengths"))
    codes = np.frombuffer(bundle.column("codes")[0].as_buffer(), dtype="<i4")
    known = known.sort_by([("code", "ascending"), ("token_id", "ascending")])
    n = np.bincount(known.column("code").to_numpy(), minlength=int(codes.max(initial=-1)) + 1)
    each = n[codes]
    ends = np.concatenate(([0], np.cumsum(each)))
    found = np.repeat((np.cumsum(n) - n)[codes] - ends[:-1], each) + np.arange(ends[-1])
    offsets = ends[np.concatenate(([0], np.cumsum(lengths.to_numpy())))]
    token_ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), known.column("token_id").combine_chunks().take(pa.array(found)))
    return pa.table({"id": ids, "token_ids": token_ids})


def ids_of_bundles(bundles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, token_ids`` of the texts in ``bundles``: a bundle asks for each of its tokens once, and no token is shuffled for each place."""
    v = vocabulary.select(F.col("id").cast("long").alias("token_id"), "name")
    known = bundles.select("bundle", F.posexplode("names").alias("code", "name")).join(v, "name").select(F.col("bundle").alias("asks"), "code", "token_id")
    texts = bundles.select("bundle", "ids", "lengths", "codes")
    kind = dict(bundles.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return texts.groupBy("bundle").cogroup(known.groupBy("asks")).applyInArrow(_numbered, f"id {kind}, token_ids array<long>")


def token_ids(texts: DataFrame, vocabulary: DataFrame, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """``id, token_ids`` in order, through ``vocabulary(id, name)``; a text without tokens has an empty list."""
    return ids_of_bundles(bundled(texts, tokenize), vocabulary)
