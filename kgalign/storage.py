"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders made inside each ``temporary`` block that is open.
_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session in one process, as in local tests, may do without: a temporary folder stands in."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if (master := spark.sparkContext.master) != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the session's folder, for tables that steps leave behind."""
    path = f"{shared_folder(spark)}/kgalign/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table or folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What steps inside leave behind is removed at the end; the results must have been written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this session's steps have left behind."""
    delete(spark, f"{shared_folder(spark)}/kgalign/{spark.sparkContext.applicationId}")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_table(df: DataFrame) -> bool:
    """Whether ``df`` is a table of files as it stands: read again, it has the same rows in the same partitions."""
    return df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"


def is_view(df: DataFrame) -> bool:
    """Whether ``df`` is made of tables of files row by row, alike each time: read again, nothing is joined, grouped or shuffled."""

    def view(plan) -> bool:
        children = plan.children()
        row_by_row = plan.nodeName() in ("Project", "Filter", "Generate", "Union") and plan.deterministic()
        return plan.nodeName() == "LogicalRelation" or row_by_row and all(view(children.apply(i)) for i in range(children.size()))

    return view(df._jdf.queryExecution().analyzed())


def as_table(df: DataFrame) -> DataFrame:
    """``df`` if it is a table of files or made of some row by row, else written: for what is read several times."""
    return df if is_view(df) else written(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def workers_find_package(spark: SparkSession) -> None:
    """Python workers look for the package where the driver found it; a cluster may ship it by --py-files."""
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if home not in (known := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
