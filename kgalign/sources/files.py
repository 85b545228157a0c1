"""Triples, links, names, candidates and vectors from and to files.

Each reader of lines has a parser of its own, so that lines from any source can
be parsed. Parsers keep every line that fails in ``rejects``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PREFIXES, compress_uri, quote, stripped
from ..storage import workers_find_package

#: The object is more than the final dot.
N_TRIPLE = r"\A(\S+)\s+(\S+)\s+(?!\s*\.\s*\z)(.+?)\s*\.?\s*\z"
CANDIDATE = T.StructType([
    T.StructField("ref", T.LongType()), T.StructField("ground_rank", T.IntegerType()), T.StructField("candidates", T.ArrayType(T.LongType())),
    T.StructField("cand_sims", T.ArrayType(T.DoubleType())), T.StructField("difficulty", T.DoubleType()),
])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``value, pos`` of a file, or of all files below a folder, in the order of names."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    # Within a file, ids rise with the place of a line.
    return lines.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("pos"))


def _fit(parsed: DataFrame, good: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    keep = [c for c in ("pos",) if c in parsed.columns]
    good = F.coalesce(good, F.lit(False))
    return parsed.where(good).select(*columns, *keep), parsed.where(~good).select("value", *keep)


def parse_n_triples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``subj, pred, obj`` as written, and rejects; comment lines are neither."""
    rows = lines.where(~F.col("value").startswith("#"))
    parts = [F.regexp_extract("value", N_TRIPLE, i).alias(n) for i, n in enumerate(("subj", "pred", "obj"), 1)]
    return _fit(rows.select("*", *parts), F.col("value").rlike(N_TRIPLE), ["subj", "pred", "obj"])


def compressed(triples: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    return triples.withColumns({c: compress_uri(F.col(c), prefixes) for c in ("subj", "pred", "obj")})


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", F.split("value", "\t"))


def parse_relation_lines(lines: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> tuple[DataFrame, DataFrame]:
    rows = lines.withColumn("f", F.split(stripped(F.col("value")), "\t"))
    rows = rows.select("*", *[compress_uri(F.get("f", F.lit(i)), prefixes).alias(n) for i, n in enumerate(("subj", "pred", "obj"))])
    return _fit(rows, F.size("f") >= 3, ["subj", "pred", "obj"])


def parse_attribute_lines(lines: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> tuple[DataFrame, DataFrame]:
    rows = _fields(lines)
    value = quote(F.get("f", F.lit(2)))
    rows = rows.select(
        "*", compress_uri(F.get("f", F.lit(0)), prefixes).alias("subj"), compress_uri(F.get("f", F.lit(1)), prefixes).alias("pred"),
        compress_uri(value, prefixes).alias("obj"),
    )
    return _fit(rows, F.size("f") >= 3, ["subj", "pred", "obj"])


def parse_link_lines(lines: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> tuple[DataFrame, DataFrame]:
    rows = lines.withColumn("f", F.split(stripped(F.col("value")), "\t"))
    rows = rows.select("*", *[compress_uri(F.get("f", F.lit(i)), prefixes).alias(n) for i, n in enumerate(("src", "tgt"))])
    return _fit(rows, F.size("f") >= 2, ["src", "tgt"])


def parse_name_lines(lines: DataFrame, prefixes: tuple[str, ...] | None = PREFIXES) -> tuple[DataFrame, DataFrame]:
    """``id, name``: the first and last column; names as they are with ``prefixes=None``."""
    rows = lines.withColumn("f", F.split(stripped(F.col("value")), "\t"))
    last = F.element_at("f", -1)
    rows = rows.select("*", F.expr("try_cast(f[0] as bigint)").alias("id"), (compress_uri(last, prefixes) if prefixes is not None else last).alias("name"))
    return _fit(rows, F.col("id").isNotNull() & (F.size("f") >= 2), ["id", "name"])


def parse_id_triples(lines: DataFrame, order: str = "hrt") -> tuple[DataFrame, DataFrame]:
    """``h, r, t`` as numbers; ``order`` says how the columns stand in the file."""
    rows = _fields(lines)
    rows = rows.select("*", *[F.expr(f"try_cast(get(f, {i}) as bigint)").alias(n) for i, n in enumerate(order)])
    return _fit(rows, F.col("h").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull(), ["h", "r", "t"])


def _written_field(c: Column) -> Column:
    """Null as ``\\N``; a text that is backslashes and an ``N`` with one backslash more; any other text as it is."""
    return F.when(c.isNull(), F.lit("\\N")).when(c.rlike(r"\A\\+N\z"), F.concat(F.lit("\\"), c)).otherwise(c)


def _read_field(c: Column) -> Column:
    return F.when(c == "\\N", F.lit(None)).when(c.rlike(r"\A\\+N\z"), F.substring(c, F.lit(2), F.length(c))).otherwise(c)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, no quoting: a text without tabs and line feeds is written as it is. Null is ``\\N``, an empty text an empty field."""
    fields = [_written_field(F.col(c).cast("string")) for c in df.columns]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.option("lineSep", "\n").text(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines end in a line feed alone: a carriage return belongs to its text. Fields that are missing or don't fit their type are null."""
    fields = F.split("value", "\t")
    types = spark.createDataFrame([], schema).schema
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(*[_read_field(F.get(fields, F.lit(i))).try_cast(t.dataType).alias(t.name) for i, t in enumerate(types)])


def write_dictionary(names: DataFrame, path: str, name_first: bool = False) -> None:
    """``id, name`` as ``id <tab> name``, or the other way round."""
    write_tsv(names.select("name", "id") if name_first else names.select("id", "name"), path)


def read_dictionary(spark: SparkSession, path: str, name_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """``id, name`` as they are, of ``id <tab> name`` lines or of ``name <tab> id`` lines, and the lines that are neither."""
    rows = read_lines(spark, path).withColumn("f", F.split(F.regexp_replace("value", r"[\r\n]+\z", ""), "\t"))
    number, name = F.get("f", F.lit(1 if name_first else 0)), _read_field(F.get("f", F.lit(0 if name_first else 1)))
    rows = rows.select("*", number.try_cast("long").alias("id"), name.alias("name"))
    good, bad = _fit(rows, F.col("id").isNotNull() & (F.size("f") == 2), ["id", "name"])
    return good.drop("pos"), bad


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines: nested rows with their types."""
    df.write.json(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidate records as JSON lines, least difficulty first."""
    candidates.orderBy("difficulty").write.json(path)


def _as_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        if batch.num_rows:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("{" if first and not i else ", ") + x for i, x in enumerate(lines)])], names=["value"])
            first = False
    yield pa.RecordBatch.from_arrays([pa.array(["{}" if first else "}"])], names=["value"])


def write_json_objects(rows: DataFrame, path: str) -> None:
    """``key, value`` as one JSON object for each part of ``rows``, each in a file of its own."""
    workers_find_package(rows.sparkSession)
    # An object of one entry without its braces.
    entry = F.regexp_replace(F.to_json(F.create_map("key", "value")), r"(?s)\A\{(.*)\}\z", "$1")
    rows.select(entry.alias("value")).mapInArrow(_as_objects, "value string").write.text(path)


def read_json_map(spark: SparkSession, path: str, value: T.DataType = CANDIDATE, whole: bool = True) -> DataFrame:
    """JSON objects keyed by name or id, each a whole file, which must fit a row, or with ``whole=False`` a line: rows ``key, value``."""
    whole = spark.read.text(path, wholetext=whole)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``id, kg, embedding``, parted by graph."""
    vectors.select("id", "embedding", "kg").write.partitionBy("kg").parquet(path)


def read_vectors(spark: SparkSession, path: str, kg: int) -> DataFrame:
    """One graph's vectors: the other's files are not read."""
    return spark.read.parquet(path).where(F.col("kg") == kg).select("id", "embedding")
