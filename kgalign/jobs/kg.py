"""The star schema as a knowledge graph, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T12 = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def _triples(df: DataFrame, *facts: tuple) -> DataFrame:
    """``subj, pred, obj, pos`` of one table, read once: each fact is ``(subject, predicate, object, position)`` of a row."""
    each = [F.struct(s.alias("subj"), F.lit(p).alias("pred"), o.alias("obj"), at.cast("long").alias("pos")) for s, p, o, at in facts]
    return df.select(F.inline(F.array(*each)))


def relation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subj, pred, obj, pos`` of orders, customers, suppliers, nations, regions and parts."""
    t = lambda name: table(spark, sf_dir, name)
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = [
        _triples(t("orders"), (_node("order", "o_orderkey"), "placed_by", _node("customer", "o_custkey"), F.col("o_orderkey"))),
        _triples(t("customer"), (_node("customer", "c_custkey"), "in_nation", _node("nation", "c_nationkey"), F.lit(T12) + F.col("c_custkey"))),
        _triples(t("supplier"), (_node("supplier", "s_suppkey"), "in_nation", _node("nation", "s_nationkey"), F.lit(2 * T12) + F.col("s_suppkey"))),
        _triples(t("nation"), (_node("nation", "n_nationkey"), "in_region", _node("region", "n_regionkey"), F.lit(3 * T12) + F.col("n_nationkey"))),
        _triples(
            t("lineitem"),
            (_node("order", "l_orderkey"), "contains", _node("part", "l_partkey"), F.lit(4 * T12) + line),
            (_node("part", "l_partkey"), "supplied_by", _node("supplier", "l_suppkey"), F.lit(5 * T12) + line),
        ),
    ]
    return reduce(DataFrame.unionByName, rows)


def attribute_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subj, pred, obj, pos`` with quoted values."""
    parts = [
        ("customer", "customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment"}, 0),
        ("part", "part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type"}, T12),
        ("orders", "order", "o_orderkey", {"priority": "o_orderpriority", "status": "o_orderstatus"}, 2 * T12),
    ]
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = [
        _triples(table(spark, sf_dir, t), *[(_node(kind, key), p, quoted(c), F.lit(base + i) + F.col(key) * 10) for i, (p, c) in enumerate(columns.items())])
        for t, kind, key, columns, base in parts
    ]
    return reduce(DataFrame.unionByName, rows)


REL = f"""rel AS (
SELECT 'order/'||o_orderkey AS subj, 'placed_by' AS pred, 'customer/'||o_custkey AS obj, CAST(o_orderkey AS BIGINT) AS pos FROM orders
UNION ALL SELECT 'customer/'||c_custkey, 'in_nation', 'nation/'||c_nationkey, {T12}+c_custkey FROM customer
UNION ALL SELECT 'supplier/'||s_suppkey, 'in_nation', 'nation/'||s_nationkey, {2 * T12}+s_suppkey FROM supplier
UNION ALL SELECT 'nation/'||n_nationkey, 'in_region', 'region/'||n_regionkey, {3 * T12}+n_nationkey FROM nation
UNION ALL SELECT 'order/'||l_orderkey, 'contains', 'part/'||l_partkey, {4 * T12}+l_orderkey*10+l_linenumber FROM lineitem
UNION ALL SELECT 'part/'||l_partkey, 'supplied_by', 'supplier/'||l_suppkey, {5 * T12}+l_orderkey*10+l_linenumber FROM lineitem)"""

_attribute = "SELECT '{kind}/'||{key} AS subj, '{p}' AS pred, '\"'||{c}||'\"' AS obj, CAST({base}+{key}*10 AS BIGINT) AS pos FROM {t}"
ATTR = "attr AS (" + "\nUNION ALL ".join(
    _attribute.format(kind=kind, key=key, p=p, c=c, base=base + i, t=t)
    for t, kind, key, columns, base in (
        ("customer", "customer", "c_custkey", (("name", "c_name"), ("segment", "c_mktsegment")), 0),
        ("part", "part", "p_partkey", (("name", "p_name"), ("brand", "p_brand"), ("type", "p_type")), T12),
        ("orders", "order", "o_orderkey", (("priority", "o_orderpriority"), ("status", "o_orderstatus")), 2 * T12),
    )
    for i, (p, c) in enumerate(columns)
) + ")"


def ordered(source: str, out: str) -> str:
    """SQL of ``ordered_facts`` over a common table expression."""
    return f"""{out}_func AS (SELECT pred, count(DISTINCT subj) / count(*) AS f, min(pos) AS pat FROM {source} GROUP BY pred),
{out}_obj AS (SELECT obj, min(pos) AS oat FROM {source} GROUP BY obj),
{out} AS (SELECT t.*, row_number() OVER (PARTITION BY subj ORDER BY f DESC, pat, pred, oat, obj, pos) AS rank
FROM {source} t JOIN {out}_func USING (pred) JOIN {out}_obj USING (obj))"""
