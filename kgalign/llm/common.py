"""What the operators share: scratch tables, word patterns, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import delete, new_folder, workers_find_package

#: White space of the contracts, as a character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE_CLASS}]+"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        workers_find_package(spark)
        self.root = new_folder(spark, name)
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read again."""
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.paths[-len(self.paths)] = path  # keeps names unique
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete(self.spark, self.paths[id(df)])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has it, or a column that starts with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def slices(batches, rows: int = 256):
    """Arrow batches cut to a few rows each: what a worker holds then follows the longest texts, not the batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(scratch: Scratch, df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before, within ``by``, in ``order``.

    No task sees a whole group: rows are dealt by range, summed for each range,
    and only these sums (one per range and group) are accumulated. ``by`` must
    hold no nulls and ``order`` should be close to unique. ``df`` is read twice
    and so should be a table.
    """
    n = 2 * shuffle_partitions(scratch.spark)
    dealt = scratch.save(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range", *by).agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    rows = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, ["_range", *by]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``.

    Alternating large-star and small-star steps, written between rounds, until every
    node hangs on one other that hangs on none: then all components are stars, and
    ``component`` is the smallest node reachable. The minima are tables of their own,
    so that the joins of a hub's many edges can be split. Nodes without an edge are not
    listed. The number of rounds grows with the logarithm of the longest chain.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = scratch.save(cur, "edges")
    while True:
        ends = cur.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.union(cur.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if ends.where("below > 1 or (below = 1 and above = 1)").isEmpty():
            break
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("a > m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        large = scratch.save(large, "large")
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for old in (low, large, least, cur):
            scratch.drop(old)
        cur = new
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
