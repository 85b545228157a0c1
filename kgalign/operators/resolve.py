"""Ids to names and names to ids, by equi joins; rows without a partner are rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def resolve_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``subj, pred, obj`` of id triples ``h, r, t``, and the id triples with an unknown id.

    Hubs make hot tails: the joins are plain equi joins, which adaptive execution splits.
    """
    e = lambda name, key: entities.select(F.col("id").alias(key), F.col("name").alias(name))
    r = relations.select(F.col("id").alias("r"), F.col("name").alias("pred"))
    rows = triples.join(r, "r", "left").join(e("subj", "h"), "h", "left").join(e("obj", "t"), "t", "left")
    whole = F.col("subj").isNotNull() & F.col("pred").isNotNull() & F.col("obj").isNotNull()
    rest = [c for c in triples.columns if c not in ("h", "r", "t")]
    return rows.where(whole).select("subj", "pred", "obj", *rest), rows.where(~whole).select(*triples.columns)


def resolve_links(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``src, tgt`` names of id links ``id1, id2`` through a dictionary for each side."""
    a = left.select(F.col("id").alias("id1"), F.col("name").alias("src"))
    b = right.select(F.col("id").alias("id2"), F.col("name").alias("tgt"))
    return links.join(a, "id1").join(b, "id2").drop("id1", "id2")


def link_ids(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``id1, id2`` of name links; the second graph's ids follow the first's."""
    shift = left.agg(F.count("*").alias("shift"))  # one row
    a = left.select(F.col("name").alias("src"), F.col("id").alias("id1"))
    b = right.crossJoin(F.broadcast(shift)).select(F.col("name").alias("tgt"), (F.col("id") + F.col("shift")).alias("id2"))
    return links.join(a, "src").join(b, "tgt").drop("src", "tgt")


def rebased(names: DataFrame) -> DataFrame:
    """Ids that start at 0."""
    least = names.agg(F.min("id").alias("_least"))  # one row
    return names.crossJoin(F.broadcast(least)).withColumn("id", F.col("id") - F.col("_least")).drop("_least")


def renamed(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with names replaced by ``names(name, new_name)``; names not listed stay."""
    for c in columns:
        new = names.select(F.col("name").alias(c), F.col("new_name").alias("_new"))
        rows = rows.join(new, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows


def attributes_of(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples whose subject is listed in ``entities(name)``."""
    return triples.join(entities.select(F.col("name").alias("subj")), "subj", "left_semi")


def relations_of(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples whose subject and object are both listed."""
    return attributes_of(triples, entities).join(entities.select(F.col("name").alias("obj")), "obj", "left_semi")


def cleaned_links(links: DataFrame, mode: str = "reference") -> DataFrame:
    """Links ``src, tgt, pos`` without those that clash.

    ``reference``: a link goes, with all links equal to it, if a later link has its
    head or its tail as head; so the last link of a head stays, exact copies go
    altogether, and repeated tails stay. ``one_to_one``: the first link of each
    head, then of these the first of each tail.
    """
    if mode == "one_to_one":
        first = links.groupBy("src").agg(F.min(F.struct("pos", "tgt")).alias("x")).select("src", "x.tgt", "x.pos")
        first = first.groupBy("tgt").agg(F.min(F.struct("pos", "src")).alias("x"))
        return first.select("x.src", "tgt", "x.pos")
    # A table of its own, so that the joins with a hot head or tail can be split.
    last = written(links.groupBy("src").agg(F.max("pos").alias("_last")))
    by_head = links.join(last, "src").where("pos < _last").select("src", "tgt")
    by_tail = links.join(last.withColumnRenamed("src", "tgt"), "tgt").where("pos < _last").select("src", "tgt")
    return links.join(by_head.unionByName(by_tail).distinct(), ["src", "tgt"], "left_anti")


def candidate_names(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """``candidates(key, ids)`` with ``names``, in the order of the list."""
    each = candidates.select("key", F.posexplode("ids").alias("at", "id")).join(names.select("id", "name"), "id")
    packed = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("x"))
    return packed.select("key", F.transform("x", lambda x: x["name"]).alias("names"))
