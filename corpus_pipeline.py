"""A corpus pipeline of five stages, each applying one operator to all that the stage before kept.

quality rules -> line dedup -> MinHash near-dedup -> mixing to target weights -> packing.
A stage's result is written as Parquet and read again as the next one's documents; what
the stage left behind is then removed.

Defined results, for every stage: null texts are empty ones; rows with a null or repeated
doc_id are documents of their own, and equal rows are told apart by nothing but their
number; a long text is one row's work; ties fall as each operator says; an empty table
gives an empty result; columns beside those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgalign.llm.common import Scratch
from kgalign.llm.line_dedup import dedup_lines
from kgalign.llm.mixing import mixed_documents
from kgalign.llm.near_dedup import without_near_duplicates
from kgalign.llm.packing import pack_documents
from kgalign.llm.quality import quality_rules
from kgalign.llm.queries import tokenizer_path
from kgalign.storage import temporary

#: SQL can't express shingle links, the schedule and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and short texts among them; the others lose the lines that fail."""
    return _documents(quality_rules(docs).where("kept").withColumn("text", F.col("clean_text")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the largest doc_id; a document that loses all its lines goes.

    A document without an id keeps its lines and counts for none, and all rows of a repeated id keep those it owns.
    """
    return _documents(dedup_lines(spark, docs).where("n_dropped < n_lines"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of near duplicates stays, one row also where ids are repeated or null.

    Documents without words are near nothing, and stay.
    """
    return _documents(without_near_duplicates(spark, docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last time cut after the words taken; those without words go.

    A null source is a source like others, the last.
    """
    return _documents(mixed_documents(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a repeated document is packed as often as it stands, a null text as its end token."""
    return pack_documents(spark, docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
