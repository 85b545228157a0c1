"""Operator 11, k-means on integer vectors with ball trees over parts of the rows.

Where the rows are, they are put in metric trees of at most TREE_ROWS rows, once: a node
is a ball with its radius, its number of rows and their integer sum; a leaf has a few
rows. In a round every tree is walked from its root with the broadcast centroids. By the
triangle inequality a centroid is out of question for a ball where another is nearer to
all of it; a ball with one centroid left gives it its count and sum as a whole, others
are opened, and the rows of leaves meet the centroids that are left, in integers. What
leaves a task is one sum for each centroid. Rows are never shuffled, so no group is hot.

The bounds are floating-point numbers with a margin for rounding, so they only exclude
what is farther for certain; ties are settled by integers, and results don't depend on
the trees.

Defined results: vectors that are null, have another length, or hold null or non-finite
components are not kept, and give no row; nor do vectors with a component whose integer is beyond
+-2**27, for their squared distances need not fit a long; a null vec_id is hashed as an empty one; repeated rows
are vectors of their own, and equal hashes are taken in the order of the vectors; with
fewer vectors than centroids there are as many centroids as vectors; sums that exceed a long are null; an
empty table gives no rows; other columns are ignored, whatever their names. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
TREE_ROWS, LEAF_ROWS = 8192, 32
#: The largest integer of a component: a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Sums of squares below this are exact as floating-point numbers.
_EXACT = 1 << 53
_TREE = "ids binary, missing binary, points binary, start binary, stop binary, child binary, radius binary, total binary"
_NODES = {"start": "<i8", "stop": "<i8", "child": "<i8", "radius": "<f8", "total": "<i8"}


def squared(x, c):
    """Squared distances of integer rows ``x`` and ``c``, exact."""
    import numpy as np

    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for i, row in enumerate(c):
        d = x - row
        out[:, i] = (d * d).sum(1)
    return out


def ball_tree(points, leaf_rows: int) -> tuple:
    """The order of the rows of ``points`` in the tree, and its nodes: rows ``start`` to ``stop``, first ``child`` (the second follows it; 0: a leaf), ``radius``, ``total``."""
    import numpy as np

    order, x = np.arange(len(points)), points.astype(np.float64)
    nodes = {n: [] for n in _NODES}

    def ball(start: int, stop: int):
        rows = order[start:stop]
        total = points[rows].sum(axis=0)
        far = ((x[rows] - total / len(rows)) ** 2).sum(axis=1)
        for n, v in zip(_NODES, (start, stop, 0, np.sqrt(far.max()), total)):
            nodes[n].append(v)
        return far

    todo = [(0, ball(0, len(points)))]
    while todo:
        node, far = todo.pop()
        start, stop = nodes["start"][node], nodes["stop"][node]
        if stop - start <= leaf_rows or not far.max():
            continue
        rows = order[start:stop]
        # Along the line between a row that is far out and the row farthest from it, cut at the median.
        one = x[rows[far.argmax()]]
        other = x[rows[((x[rows] - one) ** 2).sum(axis=1).argmax()]]
        half = (stop - start) // 2
        order[start:stop] = rows[np.argpartition(x[rows] @ (other - one), half)]
        nodes["child"][node] = len(nodes["start"])
        for a, b in ((start, start + half), (start + half, stop)):
            todo.append((len(nodes["start"]), ball(a, b)))
    return order, {n: np.array(v, dtype=kind) for (n, kind), v in zip(_NODES.items(), nodes.values())}


def _plant(dims: int, scale: float, tree_rows: int, leaf_rows: int):
    """Trees of the rows ``vec_id, embedding`` that are kept, each a row of _TREE."""

    def tree(ids: list, points: list):
        import numpy as np

        points = np.concatenate(points)
        order, nodes = ball_tree(points, leaf_rows)
        ids = [ids[i] for i in order.tolist()]
        data = [np.array([i or 0 for i in ids], dtype="<i8"), np.array([i is None for i in ids], dtype=np.uint8), points[order].astype("<i4"), *nodes.values()]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in data], names=[c.split(" ")[0] for c in _TREE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, points = [], []
        for batch in batches:
            vectors = batch.column(1)
            fits = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
            flat = vectors.take(pa.array(fits)).flatten()
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) * scale)  # a null is no number
                good = (np.abs(x) <= LARGEST).all(axis=1)
            ids += batch.column(0).take(pa.array(fits[good])).to_pylist()
            points.append(x[good].astype(np.int64))
            while len(ids) >= tree_rows:
                held = np.concatenate(points)
                yield tree(ids[:tree_rows], [held[:tree_rows]])
                ids, points = ids[tree_rows:], [held[tree_rows:]]
        if ids:
            yield tree(ids, points)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dims: int):
    import numpy as np

    kinds = ["<i8", np.uint8, "<i4", *_NODES.values()]
    for batch in batches:
        for i in range(batch.num_rows):
            ids, missing, points, *nodes = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=kind) for k, kind in enumerate(kinds))
            nodes = dict(zip(_NODES, nodes))
            yield ids, missing, points.reshape(-1, dims).astype(np.int64), nodes | {"total": nodes["total"].reshape(-1, dims)}


def walk(points, nodes: dict, centroids):
    """Balls taken whole and rows assigned one by one: ``(nodes, their clusters), (rows, their clusters)``."""
    import numpy as np

    c = centroids.astype(np.float64)
    sizes = nodes["stop"] - nodes["start"]
    centre = nodes["total"] / sizes[:, None]
    far = np.stack([np.sqrt(((centre - row) ** 2).sum(axis=1)) for row in c], axis=1)
    radius = nodes["radius"] * (1 + 1e-9) + 1e-9
    slack = far * 1e-9 + 1e-9
    # Centroids that may be nearest to some row of the ball: none has all rows nearer for certain.
    least = (far + slack).min(axis=1) + radius
    may = far - slack - radius[:, None] <= least[:, None]
    balls, ball_of, rows, row_of = [], [], [], []
    front, left = np.zeros(1, dtype=np.int64), np.ones((1, len(c)), dtype=bool)
    while len(front):
        left = left & may[front]
        one = left.sum(axis=1) == 1
        balls.append(front[one]), ball_of.append(left[one].argmax(axis=1))
        front, left = front[~one], left[~one]
        leaf = nodes["child"][front] == 0
        at = front[leaf]
        if len(at):
            inside = np.repeat(nodes["start"][at] - np.concatenate(([0], np.cumsum(sizes[at])[:-1])), sizes[at]) + np.arange(sizes[at].sum())
            open_ = np.repeat(left[leaf], sizes[at], axis=0)
            rows.append(inside)
            row_of.append(np.where(open_, squared(points[inside], centroids), np.iinfo(np.int64).max).argmin(axis=1))  # the first of equal ones
        child = nodes["child"][front[~leaf]]
        front, left = np.concatenate((child, child + 1)), np.concatenate((left[~leaf], left[~leaf]))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return (join(balls), join(ball_of)), (join(rows), join(row_of))


def _sums(centroids, dims: int):
    """For each task the count and sum of each cluster: ``cluster, place, total``, place -1 for the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = centroids.value
        total, count = np.zeros(c.shape, dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for _, _, points, nodes in _trees(batches, dims):
            (balls, ball_of), (rows, row_of) = walk(points, nodes, c)
            np.add.at(total, ball_of, nodes["total"][balls]), np.add.at(count, ball_of, (nodes["stop"] - nodes["start"])[balls])
            np.add.at(total, row_of, points[rows]), np.add.at(count, row_of, 1)
        some = np.flatnonzero(count)
        place = np.tile(np.arange(-1, dims, dtype=np.int32), len(some))
        both = np.concatenate((count[some, None], total[some]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.astype(np.int32), dims + 1)), pa.array(place), pa.array(both.ravel())], names=["cluster", "place", "total"])

    return run


def _assign(centroids, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = centroids.value
        for ids, missing, points, nodes in _trees(batches, dims):
            (balls, ball_of), (rows, row_of) = walk(points, nodes, c)
            cluster = np.empty(len(points), dtype=np.int32)
            for ball, k in zip(balls.tolist(), ball_of.tolist()):
                cluster[nodes["start"][ball] : nodes["stop"][ball]] = k
            cluster[rows] = row_of
            d = points - c[cluster]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing.astype(bool)), pa.array(cluster), pa.array((d * d).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(
    spark: SparkSession, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED,
    tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Rows ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the kept ones of ``vectors(vec_id, embedding)``.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:vec_id``.
    """
    import numpy as np

    scratch = Scratch(spark, "clusters")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    trees = scratch.save(rows.mapInArrow(_plant(dims, scale, tree_rows, leaf_rows), _TREE), "trees")
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))))
    in_bounds = lambda x: F.coalesce((x * F.lit(float(scale)) >= -LARGEST) & (x * F.lit(float(scale)) < LARGEST + 1), F.lit(False))
    usable = (F.size("embedding") == dims) & F.forall("embedding", in_bounds)  # NaN is larger than any number
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.where(usable).select(rank.alias("rank"), whole.alias("q")).orderBy("rank", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(spark.sparkContext.broadcast(centroids), dims), "cluster int, place int, total long")
        # k * (dims + 1) rows. Sums are decimals, for they may exceed a long.
        found = {(r["cluster"], r["place"]): int(r["total"]) for r in sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        moved = centroids.copy()
        for c in {c for c, _ in found}:
            moved[c] = [found[c, place] // found[c, -1] for place in range(dims)]
        centroids = moved
    placed = scratch.save(trees.mapInArrow(_assign(spark.sparkContext.broadcast(centroids), dims), "vec_id long, cluster int, distance long"), "placed")
    by = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row for each cluster
    fits = lambda n: n if n < 1 << 63 else None
    inertia, digest = sum(int(r["s"]) for r in by), lambda c: sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    known = spark.createDataFrame(
        [(r["cluster"], fits(int(r["s"])), fits(inertia), digest(r["cluster"])) for r in by], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
