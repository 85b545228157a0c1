"""Operator 2, line dedup on levelled sorted runs of line hashes.

The store of line hashes is a set of runs, each a table bucketed and sorted by
hash. Batches of documents come in falling doc_id order. Each batch is reduced
to its own hashes and merge-joined with the live runs: hashes that no run holds
(the anti-join) are added with their largest doc_id as owner, the others only
add to the counts. Every ``fanout`` runs of a level are compacted to one of the
next level, again by a merge join of co-located buckets. The last run says how
many documents hold a line and which of them keeps it. The runs lie in the shared folder, beside
the other steps' tables, and are dropped at the end, also of a run that fails.

Defined results: a null or empty text is one empty line; documents with a null
doc_id keep all lines and count for none; rows with the same doc_id count as
documents of their own and all keep the lines that this doc_id owns; an empty
table gives an empty result; a long text is one row of its hashes; a line that stands
twice in the document that owns it stays twice; other columns are passed on, those
with the names of the added columns are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import delete
from .common import SPACES, Scratch, free_name, shuffle_partitions, slices

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines are hashed to 128 bits, held as two longs.
HASH_BYTES = 16


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its key's hash, or None where the key is too short to count."""
    import xxhash

    spaces, digest, out = SPACES.encode(), xxhash.xxh3_128_digest, []
    for line in (text or "").encode().lower().split(b"\n"):  # lower() of bytes is A-Z alone
        key = line.strip(spaces)
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(digest(key) if long_enough else None)
    return out


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {k for k in line_keys(text, min_chars) if k is not None}
                ids += [doc_id] * len(keys)
                found += keys
            pair = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))],
                names=["doc_id", "hi", "lo"],
            )

    return run


class LineRuns:
    """Levelled runs ``(hi, lo, n, top)`` as bucketed tables below a folder that all executors share; dropped on leaving."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.names: set[str] = set()

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *failure) -> None:
        for name in list(self.names):
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.folder}/{name}")
        self.names.discard(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.select("hi", "lo", "n", "top").repartition(self.buckets, "hi", "lo")
        self.names.add(name)
        rows.write.format("parquet").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def live(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add ``batch(hi, lo, n, top)``, one row a hash; later batches hold smaller doc_ids."""
        rows = batch
        for i, name in enumerate(self.live()):
            run = self.spark.table(name).select("hi", "lo", F.lit(True).alias(f"held{i}"))
            rows = rows.join(run, ["hi", "lo"], "left")
        held = F.coalesce(*[F.col(f"held{i}") for i in range(len(self.live()))], F.lit(False))
        rows = rows.select("hi", "lo", "n", F.when(~held, F.col("top")).alias("top"))
        self._push(0, self._write(rows))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            new = self.spark.table(name).select("hi", "lo", F.col("n").alias("n2"), F.col("top").alias("top2"))
            out = out.join(new, ["hi", "lo"], "full").select(
                "hi", "lo",
                (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"),
                F.greatest("top", "top2").alias("top"),
            )
        return out

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        name = self._write(self._merged(old))
        for x in old:
            self._drop(x)
        self._push(level + 1, name)

    def merged(self) -> DataFrame:
        """All runs as one; at most ``fanout`` for each level are live."""
        return self._merged(self.live())


def _drop_lines(min_chars: int, names: list[str], drop: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            columns = dict(zip(batch.schema.names, batch.columns))
            drops = columns[drop]
            pairs = drops.flatten()
            packed = np.stack([pairs.field(x).to_numpy(zero_copy_only=False) for x in ("hi", "lo")], 1).astype("<i8").tobytes()
            sizes = drops.value_lengths().fill_null(0).to_pylist()
            lines, dropped, kept, at = [], [], [], 0
            for text, n in zip(columns["text"].to_pylist(), sizes):
                parts = (text or "").split("\n")
                stay = parts
                if n:
                    gone = {packed[i : i + HASH_BYTES] for i in range(at, at + n * HASH_BYTES, HASH_BYTES)}
                    at += n * HASH_BYTES
                    stay = [p for p, k in zip(parts, line_keys(text, min_chars)) if k is None or k not in gone]
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
                kept.append("\n".join(stay))
            columns |= {"text": pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def dedup_lines(
    spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` without the lines it drops, with ``n_lines, n_dropped``; keys in ``min_docs`` documents stay in the largest doc_id alone."""
    scratch = Scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    own, drop = free_name(docs, "_id"), free_name(docs, "_drop")
    cuts = docs.select(F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)]).alias("cuts")).first()["cuts"] or []
    # The count of cuts below a doc_id; batch 0 holds the largest ids.
    batch = F.lit(len(set(cuts)))
    for cut in sorted(set(cuts)):
        batch = batch - (F.col("doc_id") > cut).cast("int")
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = hashed.mapInArrow(_hash_lines(min_chars), "doc_id long, hi long, lo long")
    lines = scratch.save(hashed.withColumn("batch", batch), "lines", "batch")
    with LineRuns(spark, scratch.root, fanout) as runs:
        for b in range(len(set(cuts)) + 1):
            new = lines.where(F.col("batch") == b).groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
            runs.add(new)
        common = scratch.save(runs.merged().where(F.col("n") >= min_docs).select("hi", "lo", "top"), "common")
    gone = lines.join(common, ["hi", "lo"]).where("doc_id <> top")
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias(drop)).withColumnRenamed("doc_id", own)
    # Only the short lists of hashes are hashed in memory; the texts are not sorted.
    joined = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left").drop(own)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_drop_lines(min_chars, schema.names, drop), schema)
