"""Vectors ``id, embedding``: encoding, norms, linear maps and reduction of dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..storage import workers_find_package, written


#: Most dimensions of which the sum of outer products is made; most parts that meet in a group.
MAX_GRAM, FAN_IN = 4096, 512


def normalized(embedding: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(embedding, lambda x: F.when(norm > 0, x.cast("double") / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(0.0)))


def _mapped(matrix, normalize: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        m = matrix.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64) @ m
            if normalize:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n > 0, n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])

    return run


def mapped(vectors: DataFrame, matrix, normalize: bool = False) -> DataFrame:
    """``embedding`` times a d x e matrix, broadcast: its size is the square of the dimension, whatever the rows."""
    spark = vectors.sparkSession
    workers_find_package(spark)
    return vectors.select("id", "embedding").mapInArrow(_mapped(spark.sparkContext.broadcast(matrix), normalize), "id long, embedding array<double>")


def stacked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both graphs, texts or vectors, with ``kg``: 1 or 2."""
    return first.withColumn("kg", F.lit(1)).unionByName(second.withColumn("kg", F.lit(2)))


def _summed(vectors: DataFrame, product: Callable) -> DataFrame:
    """The sum of ``product(rows as a matrix)`` over all batches, ``row, vals`` as bytes.

    Tasks add up their own batches; their matrices meet row by row in two levels, so that no group takes more than FAN_IN
    parts, up to FAN_IN ** 2 tasks.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                part = product(np.array(batch.column(0).to_pylist(), dtype=np.float64))
                total = part if total is None else total + part
        if total is not None:
            few = np.full(len(total), TaskContext.get().partitionId() // FAN_IN, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(few), pa.array([v.tobytes() for v in total], pa.binary())], names=["row", "few", "vals"])

    def summed(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in parts.column("vals").to_pylist())
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "vals": pa.array([total.tobytes()], pa.binary())})

    workers_find_package(vectors.sparkSession)
    parts = vectors.select("embedding").mapInArrow(run, "row long, few int, vals binary")
    return parts.groupBy("row", "few").applyInArrow(summed, "row long, vals binary").groupBy("row").applyInArrow(summed, "row long, vals binary")


def gram(vectors: DataFrame) -> DataFrame:
    """The d x d sum of outer products, ``row, vals``, each row's numbers as bytes."""
    return _summed(vectors, lambda x: x.T @ x)


def _collected(rows: DataFrame):
    """``row, vals`` as a matrix on the driver: d rows."""
    import numpy as np

    return np.array([np.frombuffer(r["vals"]) for r in sorted(rows.collect(), key=lambda r: r["row"])])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``row, vals`` of ``gram`` with their numbers as arrays."""
    import numpy as np

    for batch in batches:
        vals = [np.frombuffer(v).tolist() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vals, pa.list_(pa.float64()))], names=["row", "vals"])


def main_directions(vectors: DataFrame, dims: int, max_gram: int = MAX_GRAM, rounds: int = 4):
    """The ``dims`` main directions of all vectors (not centred), as columns.

    Up to ``max_gram`` dimensions from the d x d sum of products. Of longer vectors no such sum is made: some more directions
    than wanted, drawn at random, are multiplied with all vectors and their transposes, round by round, each a d x few sum, which turns
    them into the main ones; with as many directions as the vectors have rank the result is exact after one round.
    """
    import numpy as np

    first = vectors.select(F.size("embedding").alias("d")).first()
    d = first["d"] if first else 0
    if d <= max_gram:
        g = _collected(gram(vectors))
        values, directions = np.linalg.eigh((g + g.T) / 2) if len(g) else (np.zeros(0), np.zeros((d, 0)))
        return directions[:, np.argsort(-values)[:dims]]
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(d, dims + 16))))[0]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(q)
        y = _collected(_summed(vectors, lambda x, shared=shared: x.T @ (x @ shared.value)))
        q, strengths, _ = np.linalg.svd(y, full_matrices=False)  # strongest first
    return q[:, :dims]


def reduced(vectors: DataFrame, dims: int, max_gram: int = MAX_GRAM) -> DataFrame:
    """The ``dims`` main directions of all vectors (not centred), rows of unit length; ``vectors`` should be a table."""
    return mapped(vectors, main_directions(vectors, dims, max_gram), normalize=True)


def hashed_encoder(dims: int = 64, seed: int = 0) -> Callable[[list[str]], list]:
    """A stand-in for a language model: the first 32 bits of each word's md5 give a place and a sign, and all are summed."""

    def encode(texts: list[str]):
        from collections import Counter
        from hashlib import md5

        import numpy as np

        out, known = np.zeros((len(texts), dims)), {}
        for i, text in enumerate(texts):
            for word, n in Counter((text or "").split(" ")).items():
                if word:
                    h = known.get(word)
                    if h is None:
                        h = known[word] = int.from_bytes(md5(f"{seed}:{word}".encode()).digest()[:4], "big")
                    out[i, h % dims] += n if h >> 31 else -n
        return out

    return encode


def encoded(texts: DataFrame, encoder: Callable, batch: int = 256) -> DataFrame:
    """``id, embedding`` of ``texts(id, content)``: ``encoder(list of str) -> array`` sees words parted by single spaces.

    A batch holds texts of one class of lengths, the longest less than twice the shortest, so that an encoder that fills
    them up to the longest wastes less than half. The result is written at once: each text is encoded once.
    """
    workers_find_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for rows in batches:
            kind = rows.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for i in (i for a, b in zip(edges, edges[1:]) for i in range(a, b, batch)):
                part = rows.slice(i, min(batch, next(e for e in edges if e > i) - i))
                found = encoder(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(float, v)) for v in found], pa.list_(pa.float64()))], names=["id", "embedding"])

    plain = texts.select("id", F.array_join(words(F.col("content")), " ").alias("content"))
    # Of 1 word of text, 2 to 3, 4 to 7, ...; sorted where they are, without a shuffle.
    sized = plain.select("id", F.floor(F.log2(F.length("content") + 1)).cast("int").alias("kind"), "content").sortWithinPartitions("kind")
    return written(sized.mapInArrow(run, "id long, embedding array<double>"))
