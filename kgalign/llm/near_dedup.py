"""Operator 4, MinHash near-dedup with sequential Bayesian verification.

Texts are sets of 5-word shingles. Equal sets are one class, represented by its
smallest doc_id, and only representatives go on. Banded MinHash keys put them in
buckets. Candidate pairs first compare their signatures batch by batch and are
pruned once the posterior probability that their similarity reaches the
threshold falls below ``miss``; survivors are confirmed on their full sets.

Pairs of a bucket are not all made. First each member meets the bucket's centre; the
links found are contracted to components. Then the members outside a bucket's largest
component compare their signatures with all members of other components, in blocks,
and only survivors become rows. So every pair that shares a bucket is either compared
or already known to be connected, while a group of n near copies costs about n pairs,
also where a few strangers share its bucket.

A bucket of many members that are not near each other, such as texts made from one template, would be compared
pair by pair. Members of such a bucket, more than CROWD outside its largest component, meet by their rarest shingles instead: two sets at
the threshold share one of the first ``n - ceil(threshold * n) + 1`` shingles of either, in any order that is the
same for all; with the shingles that many of these members hold put last, a template's own are not among them. This
loses no pair, so the buckets stand for no more than they did.

With 64 bands of 6 rows a pair at 0.75 shares no bucket with probability 4e-6,
a pair at 0.8 with 4e-9.

Defined results: a null text, or one without words, has the empty set and links
with nothing; where a doc_id is repeated, each of its rows is compared by its own
text, and its component is named by the least doc_id in it; in ``near_duplicates``
a null doc_id links with nothing and is not kept (its component is null), in
``without_near_duplicates`` it is a document like others; a long text is hashed by
chunks, so that a worker holds 8 bytes for each of its words a few times, and its bytes;
equal sets share a class, and ties go to the smaller doc_id; an empty table gives an
empty result; columns other than doc_id and text are ignored, or passed on by
``without_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_of, components, free_name, shuffle_partitions, slices

THRESHOLD_PERCENT = 75
BANDS, ROWS = 64, 6
#: One-byte minima compared by the verification, in batches.
SIGNATURE, BATCH = 128, 32
MISS = 1e-6
#: Bits of the signatures that members of open buckets compare, in batches.
LONG_BITS, LONG_BATCH = 4096, 512
#: Rows of a bucket in one block of comparisons.
BLOCK_ROWS = 512
#: Rows of a bucket outside its largest component, beyond which they meet by rare shingles.
CROWD = 4096
#: Shingles that are counted as common, at most: 8 bytes each in every worker. Beyond, some count as rare, which costs time alone.
COMMON = 1 << 20
SEED = 11


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches out of ``n`` that keep a pair.

    From a uniform prior, the similarity after m matches of n is Beta(m + 1,
    n - m + 1); it reaches t with the probability that a Binomial(n + 1, t) is
    at most m.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        if tail >= miss:
            return m
    return n + 1


def _minima(sets: Iterator, count: int):
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(SEED))
    a = (rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    b = rng.integers(0, 2**32, count, dtype=np.uint32)[:, None]
    for s in sets:
        low = None
        h = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(h), 512):
            x = (a * h[i : i + 512] + b).min(axis=1)
            low = x if low is None else np.minimum(low, x)
        yield s, low


def _features(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        from .shingles import mix, shingle_sets

        place = np.random.Generator(np.random.PCG64(SEED + 1)).integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches):
            ids, texts = (batch.column(i).to_pylist() for i in range(2))
            sizes, keys, found, marks = [], [], [], []
            with np.errstate(over="ignore"):
                for s, low in _minima(shingle_sets(texts), bands * rows + SIGNATURE):
                    sizes.append(len(s))
                    if low is None:
                        keys.append(None), found.append(None), marks.append(None)
                        continue
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    wide = low[: bands * rows].reshape(bands, rows).astype(np.uint64)
                    found.append(mix((wide * place).sum(axis=1, dtype=np.uint64)).astype(np.int64))
                    marks.append((low[bands * rows :] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array(c, t) for c, t in zip((ids, sizes, keys, found, marks), types)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "bands", "marks"])

    return run


def _survivors(x, y, left, right, least: list[tuple[int, int]]):
    """Which of the pairs of rows ``left`` of ``x`` and ``right`` of ``y`` stay, batch by batch of their signatures."""
    import numpy as np

    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for n, m in least:
        cut = slice(n - BATCH, n)
        matches[alive] += (x[left[alive], cut] == y[right[alive], cut]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


def _least(threshold: float, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, threshold, miss)) for n in range(BATCH, SIGNATURE + 1, BATCH)]


def _marks(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE)


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        least = _least(threshold, miss)
        for batch in batches:
            if not batch.num_rows:
                continue
            every = np.arange(batch.num_rows)
            kept = pa.array(_survivors(_marks(batch.column(2)), _marks(batch.column(3)), every, every, least))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(kept) for i in (0, 1)], names=["a", "b"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long signatures, one bit of each of ``LONG_BITS`` minima, from sets: near-threshold pairs need a sharper test."""
    import numpy as np

    for batch in slices(batches):
        sets = (np.frombuffer(s, dtype=np.uint64) for s in batch.column(1).to_pylist())
        with np.errstate(over="ignore"):
            marks = [np.packbits((low * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)).tobytes() for _, low in _minima(sets, LONG_BITS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["rep", "marks"])


def _compare_blocks(percent: int, miss: float, once: bool = True):
    """Surviving pairs ``(a, b)``, a > b, of rows ``bucket, i, j, own, rep, component, n_shingles, marks, bands`` sorted by block.

    With ``once``, buckets are bands, and a pair is told by one of those it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # One bit agrees with probability (1 + similarity) / 2.
        least = [(n, least_matches(n, (1 + percent / 100) / 2, miss)) for n in range(LONG_BATCH, LONG_BITS + 1, LONG_BATCH)]
        held = None

        def survivors(marks, x, y):
            alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for n, m in least:
                cut = slice((n - LONG_BATCH) // 8, n // 8)
                matches[alive] += LONG_BATCH - np.bitwise_count(marks[x[alive], cut] ^ marks[y[alive], cut]).sum(axis=1, dtype=np.int64)
                alive = alive[matches[alive] >= m]
            return alive

        def compare(t: pa.Table):
            i, j, own, rep, part, size = (t.column(n).to_numpy() for n in ("i", "j", "own", "rep", "component", "n_shingles"))
            cut = np.flatnonzero(np.diff(t.column("bucket").to_numpy()) | np.diff(i) | np.diff(j)) + 1
            marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), dtype=np.uint8).reshape(-1, LONG_BITS // 8)
            bands = np.concatenate([c.flatten().to_numpy() for c in t.column("bands").chunks]).reshape(-1, BANDS)
            bucket = t.column("bucket").to_numpy()
            a, b = [], []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(rep)]):
                r, c, n, o = rep[lo:hi], part[lo:hi], size[lo:hi], own[lo:hi]
                ok = (r[:, None] > r[None, :]) & (c[:, None] != c[None, :])
                ok &= np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
                if 2 * i[lo] != j[lo]:  # two parts of a bucket: each part's own pairs meet in a block of their own
                    ok &= o[:, None] != o[None, :]
                x, y = np.nonzero(ok)
                kept = survivors(marks[lo:hi], x, y)
                x, y = x[kept], y[kept]
                # A pair that shares several buckets is told by the one of its first common band alone.
                if once and len(x):
                    first = (bands[lo:hi][x] == bands[lo:hi][y]).argmax(axis=1)
                    x, y = (side[bands[lo:hi][x, first] == bucket[lo]] for side in (x, y))
                a.append(r[x]), b.append(r[y])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            keys = np.stack([held.column(n).to_numpy() for n in ("bucket", "i", "j")])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            if len(other):  # the last block may go on in the next batch
                yield compare(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield compare(held)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .shingles import shingle_sets

    for batch in slices(batches):
        sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            ok = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                if 100 * both >= percent * ((len(x) + len(y)) // 8 - both):
                    ok.append(i)
            kept = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(kept) for i in (0, 1)], names=["a", "b"])

    return run


class NearPairs:
    """Candidate pairs of class representatives to confirmed links."""

    def __init__(self, scratch: Scratch, docs: DataFrame, reps: DataFrame, percent: int, miss: float):
        self.scratch, self.docs, self.reps, self.percent, self.miss = scratch, docs, reps, percent, miss

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that reach the threshold."""
        of = lambda side, mark: self.reps.select(F.col("rep").alias(side), F.col("marks").alias(mark))
        signed = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
        survivors = self.scratch.save(signed.mapInArrow(_prune(self.percent / 100, self.miss), "a long, b long"), "survivors")
        needed = survivors.select(F.col("a").alias("doc_id")).union(survivors.select(F.col("b").alias("doc_id"))).distinct()
        return self.confirmed(survivors, self.sets(needed))

    def sets(self, ids: DataFrame) -> DataFrame:
        """The sets ``doc_id, shingles`` of ``ids(doc_id)``."""
        texts = self.docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary")
        return self.scratch.save(texts, "sets")

    def confirmed(self, survivors: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the saved ``survivors(a, b)`` that reach the threshold on their full sets."""
        side = lambda name, column: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(column))
        full = survivors.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        return self.scratch.save(full.mapInArrow(_confirm(self.percent), "a long, b long"), "links")


def _stars(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a > b, of each row's rep and its bucket's centre: the rep that meets most others in its buckets.

    Near copies of one text resemble that text more than each other; it meets more
    of them than any of them does, and so becomes the centre wherever it is.
    """
    weight = scratch.save(rows.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("weight")), "weight")
    weighed = scratch.save(rows.select("bucket", "rep").join(weight, "rep"), "weighed")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("c"))
    centres = scratch.save(centres.select("bucket", (-F.col("c.rep")).alias("centre")), "centres")
    pairs = weighed.select("bucket", "rep").join(centres, "bucket").where("rep <> centre")
    return pairs.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()


def _open(scratch: Scratch, shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows ``bucket, rep, n_shingles, n, component`` of the buckets in which components still differ."""
    placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = scratch.save(placed.select("bucket", "rep", "n_shingles", "n", "component"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return scratch.save(placed.join(scratch.save(mixed, "mixed"), "bucket"), "open")


def _sizes(rows: DataFrame) -> DataFrame:
    """``bucket, n, top``: its rows, and the count and name of its largest component."""
    each = rows.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    return each.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top"))


def _common_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the shingles of sets, those of a few thousand sets at a time."""
    import numpy as np

    for batch in batches:
        found, counts = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], names=["shingle", "n"])


def _prefixes(percent: int, common):
    """``rep, bucket``: the shingles of each set by which it meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last = common.value  # sorted, with the place of each in the order from rare to common
        for batch in slices(batches):
            reps, found = [], []
            for rep, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(data, dtype=np.int64)
                n = len(s) - -(-percent * len(s) // 100) + 1
                place = np.zeros(len(s), dtype=np.int64)
                if len(last[0]):
                    at = np.minimum(np.searchsorted(last[0], s), len(last[0]) - 1)
                    place = np.where(last[0][at] == s, last[1][at], 0)
                first = s[np.lexsort((s, place))[:n]]
                reps.append(np.full(len(first), rep)), found.append(first)
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(found))], names=["rep", "bucket"])

    return run


def _crowded(scratch: Scratch, rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` without crowded buckets, and the members of these in buckets of their rarest shingles, where there are any."""
    import numpy as np

    crowds = scratch.save(_sizes(rows).where(F.col("n") - F.col("top.c") > CROWD).select("bucket"), "crowds")
    if crowds.isEmpty():
        return rows, None
    members = scratch.save(rows.join(crowds, "bucket", "left_semi").select("rep", "n_shingles", "component").distinct(), "members")
    own = scratch.save(sets.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "own")
    least = max(16, members.count() >> 10)
    counts = own.select("shingles").mapInArrow(_common_shingles, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    shingle = np.array([r["shingle"] for r in found], dtype=np.int64)
    by = np.argsort(shingle)
    common = scratch.spark.sparkContext.broadcast((shingle[by], (len(found) - np.arange(len(found)))[by]))
    met = scratch.save(own.mapInArrow(_prefixes(percent, common), "rep long, bucket long"), "prefixes")
    shared = scratch.save(met.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared_prefixes")
    placed = scratch.save(met.join(shared, "bucket").join(members, "rep"), "placed_prefixes")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(crowds, "bucket", "left_anti"), scratch.save(placed.join(scratch.save(mixed, "mixed"), "bucket"), "crowd")


def _across(scratch: Scratch, rows: DataFrame, marks: DataFrame, percent: int, miss: float, once: bool = True) -> DataFrame:
    """Pairs of a bucket's rows in different components that survive the comparison of signatures.

    Only rows outside a bucket's largest component meet others: each part of them meets
    itself and the later ones, and the parts of the largest component.
    """
    sizes, block = _sizes(rows), F.lit(BLOCK_ROWS)
    parts = scratch.save(sizes.select(
        "bucket", F.col("top.component").alias("largest"),
        F.ceil((F.col("n") - F.col("top.c")) / block).cast("int").alias("others"), F.ceil(F.col("top.c") / block).cast("int").alias("inside"),
    ), "parts")
    rows = rows.join(parts, "bucket").withColumn("of", F.when(F.col("component") == F.col("largest"), -F.col("inside")).otherwise(F.col("others")))
    # A part of the largest component has a number below 0.
    rows = rows.withColumn("own", F.expr("cast(if(of < 0, -1 - pmod(xxhash64(rep), -of), pmod(xxhash64(rep), of)) as int)"))
    at = F.expr(
        "explode(if(own < 0, transform(sequence(0, others - 1), q -> struct(q as i, -1 - 2 * own as j)), concat("
        "transform(sequence(0, others - 1), q -> struct(least(q, own) as i, 2 * greatest(q, own) as j)),"
        "transform(sequence(0, inside - 1), q -> struct(own as i, 2 * q + 1 as j)))))"
    )
    dealt = rows.select("bucket", "own", "rep", "component", "n_shingles", at.alias("at")).join(marks, "rep")
    dealt = dealt.select("bucket", "at.i", "at.j", "own", "rep", "component", "n_shingles", "marks", "bands")
    dealt = dealt.repartition(shuffle_partitions(scratch.spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_compare_blocks(percent, miss, once), "a long, b long")


FEATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>, marks binary"


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = THRESHOLD_PERCENT, miss: float = MISS) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept``, one for each document."""
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near(scratch, docs, _featured(scratch, docs), percent, miss)
    # Repeated ids: rows are compared by a number of their own, and components named at the end.
    rows = scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text")
    found = _near(scratch, keyed, _featured(scratch, keyed), percent, miss).withColumnsRenamed({"doc_id": "_row", "component_id": "_component"})
    found = scratch.save(found.drop("kept").join(rows.select("_row", "doc_id"), "_row", "left"), "rows_found")
    least = found.groupBy("_component").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "_component", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = THRESHOLD_PERCENT, miss: float = MISS) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, null last, then the least hash of the row.

    Rows without words are components of their own and all stay.
    """
    row = free_name(docs, "_row")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        kept = near_duplicates(spark, docs, percent, miss).where("kept").select(F.col("doc_id").alias(row))
        return docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col(row), "left_semi")
    scratch = Scratch(spark, "near")
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col(row).alias("doc_id"), "text")
    found = _near(scratch, keyed, _featured(scratch, keyed), percent, miss).select(F.col("doc_id").alias("at"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*columns_of(docs)), row)
    ranked = rows.select(F.col(row).alias("at"), order.alias("order")).join(found, "at")
    kept = ranked.groupBy("component_id").agg(F.min_by("at", "order").alias(row)).select(row)
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").drop(row)


def _featured(scratch: Scratch, docs: DataFrame) -> DataFrame:
    return scratch.save(docs.mapInArrow(_features(BANDS, ROWS), FEATURES), "features")


def _near(scratch: Scratch, docs: DataFrame, made: DataFrame, percent: int, miss: float) -> DataFrame:
    """``near_duplicates`` of documents whose ids differ, from their saved features."""
    usable = made.where("set_key is not null and doc_id is not null")
    classes = scratch.save(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    own = usable.select("set_key", F.col("doc_id").alias("rep"), "n_shingles", "bands", "marks").join(classes, ["set_key", "rep"])
    reps = scratch.save(own.drop("set_key"), "reps")

    rows = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    # A table of its own, so that the join with a hot bucket's rows can be split.
    sizes = scratch.save(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = scratch.save(rows.join(sizes, "bucket"), "shared")
    near = NearPairs(scratch, docs, reps.select("rep", "marks"), percent, miss)
    stars = scratch.save(_stars(scratch, shared), "stars")
    links = near.links(stars)
    found = scratch.save(components(scratch, links), "found")
    open_rows = _open(scratch, shared, found)
    sets = near.sets(open_rows.select(F.col("rep").alias("doc_id")).distinct())
    bits = scratch.save(sets.mapInArrow(_bits, "rep long, marks binary"), "bits")
    signed = bits.join(reps.select("rep", "bands"), "rep")
    open_rows, crowd = _crowded(scratch, open_rows, sets, percent)
    across = _across(scratch, open_rows, signed, percent, miss)
    if crowd is not None:
        across = across.unionByName(_across(scratch, crowd, signed, percent, miss, once=False))
    more = near.confirmed(scratch.save(across.distinct().join(stars, ["a", "b"], "left_anti"), "across"), sets)
    found = scratch.save(components(scratch, links.unionByName(more)), "found")

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = made.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
