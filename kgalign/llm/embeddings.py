"""Operator 8, embedding near-dedup: spherical k-means cells, blocked cosine products.

Equal vectors of a label are one class. A bounded sample of classes trains unit
centroids, at any table size; every class has a home cell, its nearest centroid, and
is a guest in the cells whose bisecting plane with its home is near enough. For two
vectors at homes A and B, the distances of the one beyond B's plane and of the other
beyond A's sum up to no more than the length of their difference along the planes'
normal; so one of the two is within half of it, and guests within half the chord
``sqrt(2 - 2 * threshold)`` find every pair: that is ``exact``. By default guests are
those within ``SPREAD`` standard deviations of that half, as far as it is less. How far a difference of
that length reaches along the normal of two centroids is taken from the data: the largest of its shares when
differences are spread as those within cells, as those of all rows of the sample, or alike in
all directions. So vectors of low rank, whose differences have few directions, are shown as in
``exact``. A pair at the threshold is missed where its difference lies more than ``SPREAD``
deviations along the normal; differences of quite another kind than these three (all along one
direction that the data hardly use) need ``exact``.

Where one level of centroids would be too many to broadcast, there are two: coarse
cells, then cells within each, trained and assigned where their rows are. The ``MAX_LENGTHS`` most frequent
lengths of vectors have broadcast centroids; those of any other length are one coarse cell. Cells are
cut in blocks; a block product yields counts of links and, instead of pairs, a
spanning set of links of its connected vectors, so that the output grows with the
vectors. A pair that meets in several cells counts in the least of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are kept; vectors of
different length are not compared, each length has cells of its own; repeated rows
are vectors of their own; a null vec_id links as any other but is never a component's
name or kept, and a group of nulls alone has a null component; an empty table gives
an empty result; other columns are ignored.

Documented bounds: SAMPLE rows of a length, or of a coarse cell, train its cells; MAX_CELLS centroids of a length, and MAX_NUMBERS
numbers in all of them, are broadcast (three times: as they are and in two scales); MAX_CELLS are also the most cells of a
coarse cell. Spreads are taken from d x d sums of MAX_SPREAD numbers in all; lengths beyond that are shown as in ``exact``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components

THRESHOLD = 0.98
CELL_ROWS = 2048
MAX_CELLS = 4096
MAX_LENGTHS = 64
#: Numbers in all broadcast centroids, and in the sums of products that tell how differences are spread.
MAX_NUMBERS, MAX_SPREAD = 1 << 21, 1 << 22
#: Bytes of vectors that a worker holds as a matrix.
PART_BYTES = 1 << 25
SAMPLE = 100_000
ROUNDS = 5
BLOCK_ROWS = 2048
#: Standard deviations of half a pair's difference along a direction, for the default margin.
SPREAD = 5.0


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    for batch in batches:
        ids, vectors, labels = (batch.column(i) for i in range(3))
        keys, units, sizes = [], [], []
        for vector, label in zip(vectors, labels.to_pylist()):
            raw = None
            if label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                raw = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
                norm = np.sqrt((raw * raw).sum()) if np.isfinite(raw).all() else 0.0
                if not np.isfinite(norm) or norm == 0:  # huge or tiny components: scale first
                    top = np.abs(raw).max() if np.isfinite(raw).all() else 0.0
                    raw = raw / top if top > 0 else None
                    norm = np.sqrt((raw * raw).sum()) if raw is not None else 0.0
            keys.append(xxhash.xxh3_128_digest(raw.tobytes()) if raw is not None else None)
            units.append((raw / norm).tobytes() if raw is not None else None)
            sizes.append(len(raw) if raw is not None else 0)
        columns = [ids, labels, pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "key", "unit"])


def _matrix(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _moved(centroids, total):
    """Centroids at the unit mean of their rows; one without rows stays."""
    import numpy as np

    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(norm > 0, total / np.where(norm > 0, norm, 1), centroids)


def _nearest(x, c):
    """The nearest centroid of each row, a few rows at a time."""
    import numpy as np

    rows = max(1, (1 << 21) // len(c))
    return np.concatenate([(x[i : i + rows] @ c.T).argmax(axis=1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, dtype=np.int64)


def _cell_sums(x, c):
    """The sum of the rows at each centroid, and their number."""
    import numpy as np

    at, total = _nearest(x, c), np.zeros_like(c)
    np.add.at(total, at, x)
    return total, np.bincount(at, minlength=len(c))


def scaled_centroids(c, products, totals, counts) -> list:
    """Centroids in scales in which the square of two ones' distance is the share of a difference's square along their normal, times their distance's.

    One scale is that of differences as between rows of a cell, one of those as between any rows.
    ``products`` is the sum of the rows' outer products, ``totals`` and ``counts`` are their sums and numbers by cell.
    """
    import numpy as np

    n, out = max(1, counts.sum()), []
    mean = totals.sum(axis=0) / n
    some = totals / np.sqrt(np.maximum(counts, 1))[:, None]
    for scatter in ((products - some.T @ some) / n, products / n - np.outer(mean, mean)):
        values, directions = np.linalg.eigh((scatter + scatter.T) / 2)
        values = np.maximum(values, 0)
        whole = values.sum()
        out.append(c @ (directions * np.sqrt(values / whole)) if whole > 1e-12 else c)
    return out


def train_cells(scratch: Scratch, classes: DataFrame, cells: dict[int, int], sample: int = SAMPLE, rounds: int = ROUNDS) -> dict:
    """Of each length of ``cells`` its unit centroids, ``cells[dim]`` at most, from a bounded sample of ``classes(dim, key, unit)``.

    ``dim -> [centroids, then these in two scales]``; a length too large for its spread has the centroids alone.
    """
    import numpy as np

    listed = classes.where(F.col("dim").isin(list(cells)))
    sizes = {r["dim"]: r["count"] for r in listed.groupBy("dim").count().collect()}  # one row for each length listed
    every = F.coalesce(*[F.when(F.col("dim") == d, -(-n // sample)) for d, n in sizes.items()], F.lit(1))
    drawn = listed.where(F.pmod(F.xxhash64("key"), every) == 0).select("dim", F.xxhash64("key", F.lit(3)).alias("h"), "unit")
    drawn = scratch.save(drawn, "sample")
    centroids = {}
    for dim in sizes:
        first = drawn.where(F.col("dim") == dim).orderBy("h", "unit").limit(cells[dim]).collect()
        centroids[dim] = np.array([np.frombuffer(r["unit"]) for r in first]).reshape(-1, dim)
    spread, room = set(), MAX_SPREAD
    for dim in sorted(sizes, key=lambda d: -sizes[d]):
        if dim * dim <= room:
            spread.add(dim)
            room -= dim * dim
    out = {}
    for last in [False] * rounds + [True]:
        now = scratch.spark.sparkContext.broadcast((centroids, spread if last else set()))

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            held, of_spread = now.value
            found = {dim: [np.zeros_like(c), np.zeros(len(c), dtype=np.int64)] for dim, c in held.items()}
            products = {dim: np.zeros((dim, dim)) for dim in of_spread}
            for batch in batches:
                dims = batch.column(0).to_numpy()
                for dim in np.unique(dims).tolist():
                    x = _matrix(batch.column(1).take(pa.array(np.flatnonzero(dims == dim))), dim)
                    for whole, part in zip(found[dim], _cell_sums(x, held[dim])):
                        whole += part
                    if dim in products:
                        products[dim] += x.T @ x
            for dim, (t, n) in found.items():
                at = np.flatnonzero(n)
                rows = [(dim, int(i), int(n[i]), t[i].tobytes()) for i in at]
                rows += [(dim, -1 - i, 0, v.tobytes()) for i, v in enumerate(products.get(dim, ()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["dim", "cell", "n", "total"])

        totals, counts = {d: np.zeros_like(c) for d, c in centroids.items()}, {d: np.zeros(len(c), dtype=np.int64) for d, c in centroids.items()}
        products = {d: np.zeros((d, d)) for d in spread}
        # As many rows as there are centroids and, in the last turn, directions, for each of 8 tasks.
        for row in drawn.select("dim", "unit").coalesce(8).mapInArrow(sums, "dim int, cell long, n long, total binary").toLocalIterator():
            dim, cell, part = row["dim"], row["cell"], np.frombuffer(row["total"])
            if cell < 0:
                products[dim][-1 - cell] += part
            else:
                totals[dim][cell] += part
                counts[dim][cell] += row["n"]
        if last:
            out = {d: [c, *(scaled_centroids(c, products[d], totals[d], counts[d]) if d in spread else [])] for d, c in centroids.items()}
        else:
            centroids = {d: _moved(c, totals[d]) for d, c in centroids.items()}
    return out


def cells_of(x, cells: list, threshold: float, exact: bool):
    """``row, cell, home``: each row of ``x`` in its home and in the cells it visits, by row, then cell; ``cells`` as of ``train_cells``."""
    import numpy as np

    half, (c, *scales) = (2 - 2 * threshold) / 4, cells  # the square of half the chord
    rows, at, homes = [], [], []
    for part in np.array_split(np.arange(len(x)), len(x) * len(c) // (1 << 20) + 1):
        p = x[part] @ c.T
        best = p.argmax(axis=1)
        short = p[np.arange(len(part)), best][:, None] - p
        home, of = np.unique(best, return_inverse=True)
        gap = np.maximum(2 - 2 * (c[home] @ c.T), 0)  # squares of distances between centroids
        reach = gap
        if not exact and scales:
            share = gap / x.shape[1]
            for s in scales:
                norm = (s * s).sum(axis=1)
                share = np.maximum(share, norm[home][:, None] + norm[None, :] - 2 * (s[home] @ s.T))
            reach = np.minimum(gap, SPREAD * SPREAD * share)
        near = short <= np.sqrt(half * reach)[of] + 1e-9
        near[np.arange(len(part)), best] = True
        r, k = np.nonzero(near)
        rows.append(part[r]), at.append(k), homes.append(best[r])
    return np.concatenate(rows), np.concatenate(at), np.concatenate(homes)


PLACED = "cid long, label string, dim int, m long, unit binary, coarse int, visits array<int>, fine int, home int, shown array<int>"


def _placed(columns: list, row, cell, home):
    """Rows of a batch in the cells found for them, each with its home and the list of all its cells."""
    import numpy as np

    at, cells = pa.array(row), pa.array(cell.astype(np.int32))
    lists = np.split(cell.astype(np.int32), np.flatnonzero(np.diff(row)) + 1) if len(row) else []
    shown = [x for x in lists for _ in range(len(x))]
    return [c.take(at) for c in columns], cells, pa.array(home.astype(np.int32)), pa.array(shown, pa.list_(pa.int32()))


def _assign(cells, threshold: float, exact: bool, coarse: set):
    """Rows ``cid, label, dim, m, unit`` in the cells of the broadcast centroids: coarse cells for lengths of ``coarse``, else the only ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                every = np.flatnonzero(dims == dim)
                rows = max(256, PART_BYTES // (8 * dim))
                for i in range(0, len(every), rows):
                    own = batch.take(pa.array(every[i : i + rows]))
                    found = cells_of(_matrix(own.column(4), dim), cells.value[dim], threshold, exact)
                    columns, cell, home, shown = _placed(own.columns, *found)
                    zero, one = pa.array(np.zeros(len(cell), np.int32)), pa.array([[0]] * len(cell), pa.list_(pa.int32()))
                    more = [cell, shown, zero, zero, one] if dim in coarse else [zero, one, cell, home, shown]
                    yield pa.RecordBatch.from_arrays([*columns, *more], names=[c.split(" ")[0] for c in PLACED.split(", ")])

    return run


def _train_fine(rounds: int):
    """Centroids of a coarse cell from its sample ``dim, coarse, cells, h, unit``: one row ``dim, coarse, centroids``, all scales after each other."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, coarse = (k.as_py() for k in key)
        table = table.sort_by([("h", "ascending"), ("unit", "ascending")])
        x = _matrix(table.column("unit"), dim)
        c = x[: table.column("cells")[0].as_py()]
        for _ in range(rounds):
            c = _moved(c, _cell_sums(x, c)[0])
        held = [c, *(scaled_centroids(c, x.T @ x, *_cell_sums(x, c)) if dim * dim <= MAX_SPREAD else [])]
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "coarse": pa.array([coarse], pa.int32()), "scales": pa.array([len(held)], pa.int32()),
            "centroids": pa.array([b"".join(v.tobytes() for v in held)], pa.binary()),
        })

    return run


def _assign_fine(threshold: float, exact: bool):
    def run(key: tuple, rows: pa.Table, centroids: pa.Table) -> pa.Table:
        import numpy as np

        dim = key[0].as_py()
        rows = rows.select([c.split(" ")[0] for c in PLACED.split(", ")]).combine_chunks()
        cells = np.split(_matrix(centroids.column("centroids"), dim), centroids.column("scales")[0].as_py())
        found = cells_of(_matrix(rows.column("unit"), dim), cells, threshold, exact)
        columns, cell, home, shown = _placed([c.combine_chunks() for c in rows.columns[:7]], *found)
        return pa.Table.from_arrays([*columns, cell, home, shown], names=rows.column_names)

    return run


def _fine_cells(scratch: Scratch, placed: DataFrame, threshold: float, exact: bool, cell_rows: int, max_cells: int) -> DataFrame:
    """Rows of coarse cells in cells of their own: centroids are trained and met where a coarse cell's rows are."""
    cell = ["dim", "coarse"]
    counts = placed.groupBy(*cell, "label").agg(F.count("*").alias("n")).groupBy(*cell).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    cells = F.least(F.ceil(F.col("most") / F.lit(cell_rows)), F.lit(max_cells)).cast("int").alias("cells")
    part_rows, sample = F.greatest(F.lit(256), F.floor(F.lit(PART_BYTES / 8) / F.col("dim"))), F.greatest(F.lit(256), F.least(F.lit(SAMPLE), F.floor(F.lit(4 * PART_BYTES / 8) / F.col("dim"))))
    counts = counts.select(*cell, cells, F.ceil(F.col("n") / sample).cast("long").alias("every"), F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    counts = scratch.save(counts, "coarse")
    drawn = placed.join(counts, cell).where("pmod(xxhash64(cid), every) = 0").select(*cell, "cells", F.xxhash64("cid", F.lit(3)).alias("h"), "unit")
    trained = drawn.groupBy(*cell).applyInArrow(_train_fine(ROUNDS), "dim int, coarse int, scales int, centroids binary")
    trained = scratch.save(trained, "fine")
    rows = placed.join(counts.select(*cell, "parts"), cell).withColumn("part", F.expr("pmod(xxhash64(cid, 5), parts)").cast("int"))
    each = trained.join(counts, cell).select(*cell, "scales", "centroids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.groupBy(*cell, "part").cogroup(each.groupBy(*cell, "part")).applyInArrow(_assign_fine(threshold, exact), PLACED)


def _least_common(lists: list, others: list):
    """For each pair of lists the least number that both hold, or -1."""
    import numpy as np

    out = np.full((len(lists), len(others)), -1, dtype=np.int64)
    mine, theirs = {}, {}
    for held, side in ((mine, lists), (theirs, others)):
        for i, x in enumerate(side):
            for v in x:
                held.setdefault(v, []).append(i)
    for v in sorted(mine.keys() & theirs.keys(), reverse=True):
        out[np.ix_(mine[v], theirs[v])] = v
    return out


def _block(threshold: float):
    """Links of the home rows of one part of a cell with all rows of another, or the same: ``cid, root, links``."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.combine_chunks()
        cid, m, side, home, fine, coarse = (table.column(n).to_numpy() for n in ("cid", "m", "side", "home", "fine", "coarse"))
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(len(cid), -1)
        # Side 0 is a part with itself, 1 the home rows, 2 those they meet.
        a, b = np.flatnonzero((home == fine) & (side != 2)), np.flatnonzero(side != 1)
        cosine = x[a] @ x[b].T
        i, j = np.nonzero(np.abs(cosine - threshold) < 1e-12)  # summed in one way in any block
        cosine[i, j] = (x[a[i]] * x[b[j]]).sum(axis=1)
        linked = (cosine >= threshold) & (cid[a][:, None] != cid[b][None, :])
        rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked, a, b = linked[np.ix_(rows, cols)], a[rows], b[cols]
        if len(a):
            visits, shown = (table.column(n).take(pa.array(np.concatenate((a, b)))).to_pylist() for n in ("visits", "shown"))
            # A pair counts in the least coarse cell, and there in the least home, where it meets.
            counted = linked & (_least_common(visits[: len(a)], visits[len(a) :]) == coarse[0])
            homes, of = np.unique(home[b], return_inverse=True)
            place = {h: k for k, h in enumerate(homes.tolist())}
            sees = np.zeros((len(a), len(homes)), dtype=bool)
            for r, cells in enumerate(shown[: len(a)]):
                sees[r, [place[c] for c in cells if c in place]] = True
            counted &= ~(sees[:, of] & (home[b] < fine[0])[None, :])
        else:
            counted = linked
        # A pair of two home rows is seen from both; a guest's links are counted here.
        links = (counted * m[b][None, :]).sum(axis=1)
        guest_links = np.where(home[b] == fine[b], 0, (counted * m[a][:, None]).sum(axis=0))
        # Least cid of each connected part of the block, by passing minima to and fro.
        left, right, top = cid[a], cid[b], np.iinfo(np.int64).max
        while len(a):
            new_right = np.minimum(right, np.where(linked, left[:, None], top).min(axis=0))
            new_left = np.minimum(left, np.where(linked, new_right[None, :], top).min(axis=1))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        return pa.table({"cid": np.concatenate((cid[a], cid[b])), "root": np.concatenate((left, right)), "links": np.concatenate((links, guest_links)).astype(np.int64)})

    return run


def near_vectors(
    spark: SparkSession, rows: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, exact: bool = False, max_cells: int = MAX_CELLS,
    max_lengths: int = MAX_LENGTHS,
) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept`` of ``rows(vec_id, embedding, label)``.

    ``exact`` shows vectors to all cells where a partner may be, at several times the copies.
    """
    scratch = Scratch(spark, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    made = scratch.save(rows.mapInArrow(_units, "vec_id long, label string, dim int, key binary, unit binary"), "units")
    usable = made.where("key is not null")
    classes = usable.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("unit").alias("unit"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Only rows of a label meet, so a label's largest count says how many cells are wanted.
    counts = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    first = scratch.save(counts, "lengths").orderBy(F.desc("n"), "dim").limit(max_lengths + 1).collect()
    listed, others = first[:max_lengths], len(first) > max_lengths
    wanted = {r["dim"]: min(r["n"], max(2, ceil(r["most"] / cell_rows))) for r in listed}
    held = {d: min(max_cells, max(2, MAX_NUMBERS // (d * len(listed)))) for d in wanted}
    coarse = {d for d, k in wanted.items() if k > held[d]}
    centroids = train_cells(scratch, classes, {d: min(held[d], max(2, ceil(sqrt(k)))) if d in coarse else k for d, k in wanted.items()}) if wanted else {}
    shared, five = spark.sparkContext.broadcast(centroids), ["cid", "label", "dim", "m", "unit"]
    known = F.col("dim").isin(list(wanted))
    placed = classes.where(known).select(*five).mapInArrow(_assign(shared, threshold, exact, coarse), PLACED)
    if others:
        zero, one = F.lit(0), F.array(F.lit(0))
        placed = placed.unionByName(classes.where(~known).select(*five, zero.alias("coarse"), one.alias("visits"), zero.alias("fine"), zero.alias("home"), one.alias("shown")))
    placed = scratch.save(placed, "placed")
    if coarse or others:
        single = F.col("dim").isin([d for d in wanted if d not in coarse])
        placed = scratch.save(placed.where(single).unionByName(_fine_cells(scratch, placed.where(~single), threshold, exact, cell_rows, max_cells)), "placed")
    cell = ["label", "dim", "coarse", "fine"]
    parts = placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    held = placed.join(scratch.save(parts, "parts"), cell).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # Each part of a cell meets itself; where there are more, its rows also meet the home rows of the others, block by block.
    meet = F.expr(
        "explode(concat(array(struct(own as i, own as j, 0 as side)),"
        " transform(filter(sequence(0, parts - 1), q -> q <> own), q -> struct(q as i, own as j, 2 as side)),"
        " transform(filter(sequence(0, parts - 1), q -> q <> own and home = fine), q -> struct(own as i, q as j, 1 as side))))"
    )
    dealt = held.select("cid", "m", "unit", "visits", "home", "shown", *cell, meet.alias("at")).select("*", "at.i", "at.j", "at.side").drop("at")
    blocks = dealt.groupBy(*cell, "i", "j").applyInArrow(_block(threshold), "cid long, root long, links long")
    found = scratch.save(blocks, "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts_of = components(scratch, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.join(parts_of.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = scratch.save(named.select("cid", "label", "dim", "key", "rep", "m", "component"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(scratch.save(least, "least"), "component").join(scratch.save(links, "links"), "cid", "left")
    named = named.select("label", "dim", "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = made.select("vec_id", "label", "dim", "key").join(scratch.save(named, "named"), ["label", "dim", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
