"""Operator 3, token ids in binary files coded by a range asymmetric numeral system.

Texts are tokenized once, to a table of ids, where each task also leaves its counts of ids; their sums over the whole corpus
give the frequency table that all blocks share. The documents are then dealt by
range of doc_id, and each task writes its part as independent blocks of whole
documents, in ascending order. A block holds its documents' ids and lengths, its
decoder states, checkpoints inside, and checksums, so blocks decode in parallel,
as do the parts of a block. Blocks are rows of a Parquet table: it has a commit
protocol, so a lost executor's half-written files are never seen, and it lies in
any store that Spark can reach. The frequency table lies beside it: a folder with
``blocks`` and ``frequencies`` is all that a reader needs. See ``rans`` for a block's
layout.

Defined results: a null or empty text is the end id alone; rows with the same
doc_id follow each other in the order of their first ids' bytes, then of a hash of all, so that also
many rows of one doc_id, or without one, are dealt over all parts; a null doc_id comes
first; an empty table gives an empty file; columns other than doc_id and text are
ignored; a long text is one document of one block, however many ids it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder
from .common import Scratch, shuffle_partitions, slices
from .token_ids import STORE_BYTES

END_ID = 0
BLOCK_TOKENS = 1 << 20


def _id_type(vocabulary: int) -> str:
    """Ids of a small vocabulary are held in 16 bits until they are coded."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _tokenize(path: str, special_as_text: bool, kind: str, store_bytes: int, vocabulary: int):
    """``doc_id, ids, counts``: a row for each text and, last, one with the counts of a task's ids: these ids, then their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .token_ids import word_ids

        encode, end, total = word_ids(path, special_as_text, store_bytes).encode, END_ID.to_bytes(4, "little"), np.zeros(vocabulary, dtype=np.int64)

        def rows(ids, data: list, counts: list):
            return pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "ids", "counts"])

        for batch in slices(batches):
            ids = [encode(t) + end for t in batch.column(1).to_pylist()]
            whole = np.frombuffer(b"".join(ids), dtype="<u4")
            total += np.bincount(whole, minlength=vocabulary)
            width = int(kind[-1])
            data, cut = whole.astype(kind).tobytes(), np.cumsum([0, *(len(x) // 4 * width for x in ids)]).tolist()
            yield rows(batch.column(0), [data[i:j] for i, j in zip(cut, cut[1:])], [None] * len(ids))
        seen = np.flatnonzero(total)
        yield rows(pa.array([None], pa.int64()), [None], [np.concatenate((seen, total[seen])).astype("<i8").tobytes()])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts that tasks left, ``id, c``."""
    import numpy as np

    for batch in batches:
        for data in batch.column(0).to_pylist():
            ids, counts = np.frombuffer(data, dtype="<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts)], names=["id", "c"])


def _write_blocks(freq, block_tokens: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        from .rans import Model, encode_block

        model, part, start, number = Model(freq.value), TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        held: list[bytes] = []
        size, width = 0, int(kind[-1])

        def flush():
            nonlocal docs, held, size, start, number
            ids = np.frombuffer(b"".join(held), dtype=kind).astype(np.uint32)
            row = [part, number, start, len(ids), encode_block(model, ids, docs, start)]
            start, number, docs, held, size = start + len(ids), number + 1, [], [], 0
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["part", "number", "start", "tokens", "block"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append((doc_id, len(ids) // width))
                held.append(ids)
                size += len(ids) // width
                if size >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def _read_blocks(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from .rans import Model, decode_block

        model = Model(freq.value)
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block, ids = decode_block(model, blob)
                data, at, begins, crcs = memoryview(ids.astype("<u4").tobytes()), 0, [], []
                for n in block["sizes"].tolist():
                    begins.append(block["start"] + at)
                    crcs.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    at += n
                n = len(begins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(block["doc_ids"], pa.int64()), pa.array(begins, pa.int64()), pa.array(block["sizes"]), pa.array(crcs, pa.int64())],
                    names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, block_tokens: int = BLOCK_TOKENS, special_as_text: bool = False,
    store_bytes: int = STORE_BYTES,
) -> str:
    """The folder written, ``path`` or one in the shared folder.

    ``blocks`` holds ``part, number, start, tokens, block``, ``frequencies`` the table ``id, freq`` shared by all blocks.
    A control string in a text is its one id, as the library encodes it by default, or with ``special_as_text`` like other text.
    A worker remembers words in ``store_bytes`` about.
    """
    import numpy as np
    from tokenizers import Tokenizer

    from .rans import Model

    scratch = Scratch(spark, "token_files")
    path = path or new_folder(spark, "files")
    vocabulary = max([END_ID, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()]) + 1
    kind = _id_type(vocabulary)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer_path, special_as_text, kind, store_bytes, vocabulary), "doc_id long, ids binary, counts binary")
    ids = scratch.save(ids, "ids")
    counts = np.zeros(vocabulary, dtype=np.int64)
    # At most one row for each id of the vocabulary.
    for row in ids.where("counts is not null").select("counts").mapInArrow(_counts, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        counts[row["id"]] = row["c"]
    freq = Model.of_counts(counts).freq.astype(np.int64)
    spark.createDataFrame([(i, int(freq[i])) for i in np.flatnonzero(freq).tolist()], "id int, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    # Rows equal in all of the order but the last are equal, so it doesn't matter how they are numbered.
    order = ["doc_id", F.substring("ids", 1, 8), F.xxhash64("ids"), F.monotonically_increasing_id()]
    dealt = ids.where("counts is null").select("doc_id", "ids", *[c.alias(f"order{i}") for i, c in enumerate(order[1:])])
    order = ["doc_id", "order0", "order1", "order2"]
    dealt = dealt.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    shape = "part int, number long, start long, tokens long, block binary"
    blocks = dealt.mapInArrow(_write_blocks(spark.sparkContext.broadcast(freq), block_tokens, kind), shape)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` decoded from the files in ``path`` alone."""
    import numpy as np

    blocks, known = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/frequencies").collect()  # one row for each id that occurs
    freq = np.zeros(max(r["id"] for r in known) + 1, dtype=np.int64)
    for r in known:
        freq[r["id"]] = r["freq"]
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    # One row for each part of the file, so as many as there were tasks that wrote: small beside the decoded rows, which need not be dealt.
    parts = parts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    read = _read_blocks(spark.sparkContext.broadcast(freq))
    rows = blocks.select("part", "block").mapInArrow(read, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
