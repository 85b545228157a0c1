"""Texts through a user's model: resuming, retries, a second model for what failed.

Answers cost time or money, so they can be kept: with a ``path``, questions are asked in chunks,
and each chunk's answers are committed before the next is begun. What a run that broke off had committed is
not asked again. A chunk is a folder of answers, and counts once the manifest has its name,
so a half-written one is never read. Answers are kept by a hash of id and question: a text that
has changed is asked again, one that stands twice is asked once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PROMPTS, clean_answer, prompt
from ..storage import exists, new_folder, workers_find_package, written

#: Questions of a chunk: what is lost at most, and what the workers share among them.
CHUNK_ROWS = 100_000
#: Questions of a chunk that one task deals out; a chunk may be a large share of the table.
PART_ROWS = 10_000
#: Tasks that deal out questions, at most.
DEALERS = 10_000


def still_to_do(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id is not in the output yet."""
    return texts.join(done.select("id"), "id", "left_anti")


def _asking(model: Callable[[str], str], tries: int):
    """``key, answer, status`` of rows ``key, prompt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for question in batch.column(1).to_pylist():
                answer = None
                for _ in range(tries):
                    try:
                        answer = model(question)
                        break
                    except Exception:  # whatever a user's model raises counts as a failed try
                        continue
                answers.append(answer)
            status = ["error" if a is None else "ok" for a in answers]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(status, pa.string())], names=["key", "answer", "status"])

    return run


class AnswerStore:
    """Answers kept below ``path``: ``answers/chunk=...`` and ``manifest``, one row for each chunk that is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def manifest(self) -> DataFrame:
        """``chunk, rows, errors, at`` of the committed chunks; ``at`` counts them."""
        shape = "chunk string, rows long, errors long, at long"
        if not exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).json(f"{self.path}/manifest")

    def answers(self) -> DataFrame:
        """``key, answer, status`` of all committed chunks, the last good answer to a question or else its last error."""
        shape = "key string, answer string, status string, chunk string"
        if not exists(self.spark, f"{self.path}/answers"):
            return self.spark.createDataFrame([], "key string, answer string, status string")
        found = self.spark.read.schema(shape).parquet(f"{self.path}/answers").join(F.broadcast(self.manifest().select("chunk", "at")), "chunk")  # a row for each chunk
        best = found.groupBy("key").agg(F.max_by(F.struct("answer", "status"), F.struct(F.col("status") == "ok", "at")).alias("a"))
        return best.select("key", "a.answer", "a.status")

    def ask(
        self, questions: DataFrame, model: Callable[[str], str], tries: int, workers: int | None, chunk_rows: int, max_chunks: int | None, again: bool,
    ) -> None:
        """Ask those of ``questions(key, prompt)`` that have no answer yet, or with ``again`` no good one; ``max_chunks`` of them at most."""
        done = self.answers()
        done = done.where("status = 'ok'") if again else done
        todo = written(questions.dropDuplicates(["key"]).join(done.select("key"), "key", "left_anti"))
        chunks = -(-todo.count() // chunk_rows)
        if not chunks:
            return
        dealt = new_folder(self.spark, "chunks")
        # A chunk's questions lie together, so that its job reads no other's.
        h, parts = F.xxhash64("key"), -(-chunk_rows // PART_ROWS)
        rows = todo.withColumn("part", F.pmod(h, F.lit(chunks)).cast("int"))
        rows = rows.repartition(min(DEALERS, chunks * parts), "part", F.pmod(F.xxhash64(h), F.lit(parts)))
        rows.write.partitionBy("part").parquet(dealt)
        dealt = self.spark.read.schema("key string, prompt string, part int").parquet(dealt)
        at = self.manifest().count()
        for part in range(chunks if max_chunks is None else min(chunks, max_chunks)):
            rows = dealt.where(F.col("part") == part).select("key", "prompt")
            rows = rows.repartition(workers) if workers else rows.repartition("key")
            name = uuid.uuid4().hex
            rows.mapInArrow(_asking(model, tries), "key string, answer string, status string").write.parquet(f"{self.path}/answers/chunk={name}")
            here = self.spark.read.schema("key string, answer string, status string").parquet(f"{self.path}/answers/chunk={name}")
            told = here.agg(F.lit(name).alias("chunk"), F.count("*").alias("rows"), F.count_if(F.col("status") == "error").alias("errors"), F.lit(at + part).cast("long").alias("at"))
            told.coalesce(1).write.mode("append").json(f"{self.path}/manifest")


def enriched(
    texts: DataFrame, model: Callable[[str], str], kind: str = "distinct", tries: int = 5, workers: int | None = None, prompts: dict[str, str] = PROMPTS,
    path: str | None = None, chunk_rows: int = CHUNK_ROWS, max_chunks: int | None = None, again: bool = False,
) -> DataFrame:
    """``id, name, content, answer, status`` for ``texts(id, name, content)``.

    ``prompts[kind]`` is the question's template. ``model(prompt)`` may raise: it is tried
    again, then the row's status is ``error``. ``workers`` bounds the concurrent calls. The result is written at
    once, so that no later step calls the model again. With ``path`` answers are kept there, in any store that Spark reaches,
    chunk by chunk, and only questions without one are asked (with ``again`` also those that failed); after ``max_chunks``
    the run stops, and rows not asked yet have no status.
    """
    spark = texts.sparkSession
    workers_find_package(spark)
    asked = texts.select("id", "name", "content", prompt(F.col("name"), F.col("content"), kind, prompts).alias("prompt"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("prompt", F.lit(""))))
    if path is not None:
        asked = asked.withColumn("key", key)
        store = AnswerStore(spark, path)
        store.ask(asked.select("key", "prompt"), model, tries, workers, chunk_rows, max_chunks, again)
        out = asked.join(store.answers(), "key", "left")
    else:
        rows = asked.select(F.struct("id", "name", "content").alias("key"), "prompt")
        rows = rows.repartition(workers) if workers else rows
        shape = "key struct<id: long, name: string, content: string>, answer string, status string"
        out = rows.mapInArrow(_asking(model, tries), shape).select("key.id", "key.name", "key.content", "answer", "status")
    return written(out.select("id", "name", "content", clean_answer(F.col("answer")).alias("answer"), "status"))


def summarized(texts: DataFrame, model: Callable[[str], str], template: str = PROMPTS["summary"], **options) -> DataFrame:
    """``id, content, summary, status`` for ``texts(id, content)``: the template, then the text, is what the model is asked."""
    rows = texts.select("id", F.lit("").alias("name"), "content")
    return enriched(rows, model, "summary", prompts={"summary": template}, **options).select("id", "content", F.col("answer").alias("summary"), "status")


def with_fallback(texts: DataFrame, first: Callable, second: Callable, path: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """``id, name, content`` of all answers and what both models failed on: failed rows go once more, to ``second``.

    With ``path`` both models' answers are kept, each below a folder of its own.
    """
    own = lambda name: None if path is None else f"{path}/{name}"
    one = enriched(texts, first, path=own("first"), **options)
    again = one.where("status = 'error'").select("id", "name", "content")
    two = enriched(again, second, path=own("second"), **options)
    good = one.where("status = 'ok'").unionByName(two.where("status = 'ok'"))
    return good.select("id", "name", F.col("answer").alias("content")), two.where("status = 'error'").select("id", "name", "content")


def each_line(lines: DataFrame, function: Callable[[str], str], pack: int = 5000) -> DataFrame:
    """``pos, value`` with a user's function applied to every line, once, since the result is written; ``pos`` keeps the order."""
    workers_find_package(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, pack):
                part = batch.slice(i, pack)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([function(v) for v in part.column(1).to_pylist()], pa.string())], names=["pos", "value"])

    return written(lines.select("pos", "value").mapInArrow(run, "pos long, value string"))
