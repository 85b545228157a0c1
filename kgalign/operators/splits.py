"""Seeded choices with exact counts: the order is the md5 of seed and key, in any engine.

A share of the rows is cut off by selection, not by a sort of the table: a histogram of the order's leading number says
in which bucket each cut falls, and only the rows of these buckets are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import free_name, written
from .graph import dense_ids

#: Buckets of a histogram; a bucket of at most SMALL rows, or of equal numbers, is not refined.
BUCKETS, SMALL = 1 << 14, 100_000


def seeded(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def _histogram(rows: DataFrame, x: str, first: int) -> list[tuple]:
    """``(least, largest, first place, rows)`` of the buckets of ``x`` that have rows, in order; ``first`` is the place of the first row."""
    edge = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if edge["lo"] is None:
        return []
    # Infinite numbers, for missing ones, have buckets of their own; halves keep the width finite.
    low, high = (min(max(v, -1e300), 1e300) for v in (edge["lo"], edge["hi"]))
    place = F.floor((F.col(x) / 2 - F.lit(low / 2)) / F.lit(max(high / 2 - low / 2, 1e-300)) * BUCKETS)
    bucket = F.when(F.col(x) < low, -1).when(F.col(x) > high, BUCKETS + 1).otherwise(place)
    found, at = [], first
    counts = rows.groupBy(bucket.cast("long").alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    for r in sorted(counts.collect(), key=lambda r: r["b"]):  # BUCKETS + 3 rows at most
        found.append((r["lo"], r["hi"], at, r["n"]))
        at += r["n"]
    return found


def cut_rows(rows: DataFrame, number: Column, order: list, cuts: list[int], out: str) -> DataFrame:
    """``rows`` with ``out``: how many of ``cuts`` are at or below the row's place in ``order``, from 0.

    ``order`` must begin as ``number`` does, a double that is neither null nor NaN. ``rows`` are read for their
    bounds, for a histogram, and for the result, and so should be a table.
    """
    x, place = free_name(rows, "_x"), free_name(rows, "_place")
    rows = rows.withColumn(x, number.cast("double"))
    inside = lambda b: F.col(x).between(b[0], b[1])
    todo, done = _histogram(rows, x, 0), []
    while todo:
        lo, hi, at, n = bucket = todo.pop()
        parted = [] if n <= SMALL or lo == hi or not any(at < c < at + n for c in cuts) else _histogram(rows.where(inside(bucket)), x, at)
        if len(parted) > 1:
            todo += parted
        else:
            done.append(bucket)
    cut = [b for b in done if any(b[2] < c < b[2] + b[3] for c in cuts)]
    # Rows of other buckets lie on one side of each cut; where their number passes ``least[k]``, they are past k cuts.
    least = {}
    for lo, _, at, _ in sorted(b for b in done if b not in cut):
        least.setdefault(sum(c <= at for c in cuts), lo)
    past = F.lit(0)
    for k, lo in sorted(least.items()):
        past = F.when(F.col(x) >= lo, k).otherwise(past)
    rest = rows
    for b in cut:
        rest = rest.where(~inside(b))
    found = rest.withColumn(out, past.cast("int"))
    for b in cut:
        few = dense_ids(rows.where(inside(b)), order, place)
        few = few.withColumn(out, sum(((F.col(place) + b[2] >= c).cast("int") for c in cuts), F.lit(0)))
        found = found.unionByName(few.drop(place))
    return found.drop(x)


def _hashed(rows: DataFrame, seed: int, keys: list[str], counts, out: str) -> DataFrame:
    """``rows`` cut at ``counts(n)`` in the order of the md5 of seed and keys, then of the keys."""
    h = free_name(rows, "_h")
    n = rows.count()
    hashed = rows.withColumn(h, seeded(seed, *[F.col(k) for k in keys]))
    number = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")  # 52 bits are exact
    return cut_rows(hashed, number, [h, *keys], counts(n), out).drop(h)


def masked_names(names: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """``name, new_name`` for ``int(n * ratio)`` chosen entities: ``E`` and a code, unique and repeatable."""
    rows = written(names.select("name").distinct())
    n = rows.count()
    chosen = _hashed(rows, seed, ["name"], lambda n: [int(n * ratio)], "cut").where("cut = 0").select("name", seeded(seed, F.col("name")).alias("h"))
    code = F.concat(F.lit("E"), F.lpad(F.col("at").cast("string"), len(str(n)), "0"))
    return dense_ids(chosen, ["h", "name"], "at").select("name", code.alias("new_name"))


def sampled(rows: DataFrame, drop_ratio: float, keys: list[str], seed: int = 0) -> DataFrame:
    """``rows`` without exactly ``int(n * drop_ratio)`` of them; ``rows`` should be a table."""
    cut = free_name(rows, "_cut")
    return _hashed(rows, seed, keys, lambda n: [int(n * drop_ratio)], cut).where(F.col(cut) == 1).drop(cut)


def split_links(links: DataFrame, train: float = 0.2, valid: float = 0.1, seed: int = 0) -> DataFrame:
    """``src, tgt, part``: ``int(train * n)``, then ``int(valid * n)``, the rest for the test; ``links`` should be a table."""
    counts = lambda n: [int(train * n), int(train * n) + int(valid * n)]
    rows = _hashed(links.select("src", "tgt"), seed, ["src", "tgt"], counts, "cut")
    return rows.select("src", "tgt", F.element_at(F.array(*map(F.lit, ("train", "valid", "test"))), F.col("cut") + 1).alias("part"))


def given_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """A split that came with the data; nothing is left for validation."""
    return train.select("src", "tgt", F.lit("train").alias("part")).unionByName(test.select("src", "tgt", F.lit("test").alias("part")))


def hard_entities(difficulty: DataFrame, ratio: float, order: str = "hard", seed: int = 42) -> DataFrame:
    """``id, difficulty``: ``int(n * ratio)`` of the entities, ``hard`` or ``easy`` ones first, or at ``random``.

    A missing difficulty is less than any, NaN more. ``difficulty`` is computed once.
    """
    rows = written(difficulty)
    cut = free_name(rows, "_cut")
    counts = lambda n: [int(n * ratio)]
    if order == "random":
        found = _hashed(rows, seed, ["id"], counts, cut)
    else:
        d = F.when(F.isnan("difficulty"), float("inf")).otherwise(F.coalesce("difficulty", F.lit(float("-inf"))))
        number, first = {"hard": (-d, F.desc("difficulty")), "easy": (d, F.asc("difficulty"))}[order]
        found = cut_rows(rows, number, [first, "id"], counts(rows.count()), cut)
    return found.where(F.col(cut) == 0).drop(cut)


def shortest_texts(anchors: DataFrame, texts: DataFrame, ratio: float = 0.2) -> DataFrame:
    """``name`` of the ``int(n * ratio)`` anchors with the shortest text."""
    own = texts.join(anchors.select("name"), "name", "left_semi").select("name", F.length("content").alias("size"))
    found = cut_rows(written(own), F.coalesce("size", F.lit(-1)), ["size", "name"], [int(anchors.count() * ratio)], "cut")
    return found.where("cut = 0").select("name")
