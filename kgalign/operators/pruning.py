"""The best targets of each source without comparing all blocks of vectors, exactly.

Vectors are put in cells, by the nearest of some pivots, and a cell's vectors are packed in blocks, each with
its centre and radius. Two blocks' centres and radii bound every similarity between their vectors. First each
source block meets the few target blocks with the highest bounds, which gives each of its rows k values; a
target block whose bound is below the least k-th value of the rows of a source block cannot change them and is never
multiplied. For these first pairs, centres of blocks are packed again, so that tables of blocks, not of pairs of rows,
are crossed. Then bundles of blocks are crossed, each with its blocks' centres and radii, and a task takes the bounds of
two bundles' blocks as it meets them, against the best values it has by then: no pair of blocks is a row, and none is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import workers_find_package, written
from .matching import BLOCK_ROWS, Best, _cell, best_rows, crossed

#: Pivots are broadcast: at most so many vectors.
MAX_PIVOTS = 4096
#: Blocks of which one task bounds all pairs.
SUMMARIES = 1024
#: Bounds are floating-point numbers; what is within this of a row's k-th value is compared.
SLACK = 1e-9
_SUMMARY = "block long, rows long, centre binary, radius double, zero boolean, least_r double"


def _shaped(x, metric: str):
    """Vectors in the space in which centres and radii are taken."""
    import numpy as np

    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def upper_bounds(a: dict, b: dict, metric: str):
    """For each pair of blocks, of ``centre, radius, zero``, a similarity that no pair of their vectors exceeds."""
    import numpy as np

    (x, r), (y, q) = ((s["centre"], s["radius"]) for s in (a, b))
    if metric == "manhattan":
        far = np.stack([np.abs(y - row).sum(axis=1) for row in x])
        return 1 - np.maximum(far - r[:, None] - q[None, :], 0)
    far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))
    length, other = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(y, axis=1)[None, :]
    apart = np.maximum(far - r[:, None] - q[None, :] - 1e-7 * (length + other), 0)  # distances of nearby centres lose digits
    if metric == "euclidean":
        return 1 - apart
    inner = x @ y.T + length * q[None, :] + r[:, None] * other + r[:, None] * q[None, :] + 1e-12 * length * other
    if metric == "cosine":  # of unit vectors also by their distance
        return np.where(a["zero"][:, None] | b["zero"][None, :], inner, np.minimum(inner, 1 - apart**2 / 2))
    return inner


def _placed(pivots, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        p = _shaped(pivots.value, metric)
        half = (p * p).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows:
                x = _shaped(np.array(batch.column(1).to_pylist(), dtype=np.float64), metric)
                rows = max(1, (1 << 21) // len(p))
                cell = np.concatenate([(half - x[i : i + rows] @ p.T).argmin(axis=1) for i in range(0, len(x), rows)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _pack(rows: int, metric: str):
    """Blocks of rows ``id, embedding, r, cell`` sorted by cell, with their summaries."""

    def block(number: int, part: pa.Table) -> tuple:
        import numpy as np

        m = np.array(part.column("embedding").to_pylist(), dtype=np.float64)
        shaped = _shaped(m, metric)
        centre = shaped.mean(axis=0)
        away = np.abs(shaped - centre).sum(axis=1) if metric == "manhattan" else np.sqrt(((shaped - centre) ** 2).sum(axis=1))
        r = part.column("r").to_pylist()
        return number, len(m), centre.tobytes(), float(away.max()) * (1 + 1e-12) + 1e-12, bool((m == 0).all(axis=1).any()), float(min(r)), part.column("id").to_pylist(), m.tobytes(), r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, None
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.bool_(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()))
        names = [c.split(" ")[0] for c in _SUMMARY.split(", ")] + ["ids", "m", "rs"]
        for batch in chain(batches, [None]):
            now = [] if batch is None else [pa.Table.from_batches([batch])]
            held = pa.concat_tables(([held] if held is not None else []) + now) if held is not None or now else None
            while held is not None and held.num_rows:
                cells = held.column("cell").to_numpy()
                n = min(rows, int((cells == cells[0]).sum()))
                if n == held.num_rows and n < rows and batch is not None:
                    break  # the cell may go on in the next batch
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block(number, held.slice(0, n)), kinds)], names=names)
                number, held = number + 1, held.slice(n)

    return run


def packed_by_cell(vectors: DataFrame, pivots, metric: str, block_rows: int) -> DataFrame:
    """Blocks with their summaries: ``block, rows, centre, radius, zero, least_r, ids, m, rs``."""
    rows = vectors.select("id", "embedding", (F.col("r") if "r" in vectors.columns else F.lit(0.0)).cast("double").alias("r"))
    kind = dict(rows.dtypes)["embedding"]
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    placed = rows.mapInArrow(_placed(shared, metric), f"id long, embedding {kind}, r double, cell int")
    # By range of cell and id, so that a cell with most of the vectors is dealt over many tasks.
    sorted_rows = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    return written(sorted_rows.mapInArrow(_pack(block_rows, metric), _SUMMARY + ", ids array<long>, m binary, rs array<double>"))


def _bounded(blocks: DataFrame, name: str) -> DataFrame:
    """Summaries of some SUMMARIES blocks a row, for crossing."""
    columns = [c.split(" ")[0] for c in _SUMMARY.split(", ")]
    rows = blocks.select(*columns).withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // SUMMARIES)))))
    packs = rows.groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias(name))  # SUMMARIES summaries on average
    return packs.select(name)


def _first_pairs(a: DataFrame, b: DataFrame, k: int, metric: str, csls: bool) -> DataFrame:
    """``a, b, bound, rows`` of pairs of blocks: of each source block the best-bounded targets with k rows in each pack of targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def side(rows: list) -> dict:
            out = {c: np.array([r[c] for r in rows]) for c in rows[0] if c != "centre"}
            return out | {"centre": np.stack([np.frombuffer(r["centre"]) for r in rows])}

        for batch in batches:
            for at in range(batch.num_rows):
                x, y = (side(batch.column(c)[at].as_py()) for c in (0, 1))
                bound = upper_bounds(x, y, metric)
                if csls:
                    bound = 2 * bound - x["least_r"][:, None] - y["least_r"][None, :]
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(y["rows"][order], axis=1) - y["rows"][order]
                i, at = np.nonzero(before < k)
                j = order[i, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["block"][i], pa.int64()), pa.array(y["block"][j], pa.int64()), pa.array(bound[i, j], pa.float64()), pa.array(y["rows"][j], pa.int64())], names=["a", "b", "bound", "rows"]
                )

    return _bounded(a, "x").crossJoin(_bounded(b, "y")).mapInArrow(run, "a long, b long, bound double, rows long")  # of summaries of blocks


def _multiplied(pairs: DataFrame, source: DataFrame, target: DataFrame, k: int, metric: str, csls: bool) -> DataFrame:
    """``block, src, tgt, sim``: the k best of each source row in each target block of ``pairs``, which are a few for each source block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: _cell(batch, name, row)  # noqa: B023, E731
                a, b = cell("x_ids"), cell("y_ids")
                best = Best(a, cell("x_m").reshape(len(a), -1), cell("x_rs") if csls else None, k, metric)
                best.meet(b, cell("y_m").reshape(len(b), -1), cell("y_rs") if csls else None)
                found = best.found()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, cell("a"))), *found.columns], names=["block", *found.schema.names])

    left = source.select(F.col("block").alias("a"), *[F.col(c).alias(f"x_{c}") for c in ("ids", "m", "rs")])
    right = target.select(F.col("block").alias("b"), *[F.col(c).alias(f"y_{c}") for c in ("ids", "m", "rs")])
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "block long, src long, tgt long, sim double")


_BUNDLE = "sizes array<long>, centre binary, radius array<double>, zero array<boolean>, least_r array<double>, least array<double>, ids array<long>, m binary, rs array<double>"


def _bundles(blocks: DataFrame) -> DataFrame:
    """Blocks, in the order of a task, by BLOCK_ROWS rows: their rows one after the other, and lists of what sums them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lists = {"sizes": "rows", "radius": "radius", "zero": "zero", "least_r": "least_r", "least": "least"}

        def bundle(rows: list[dict]) -> pa.RecordBatch:
            found = {name: [r[of] for r in rows] for name, of in lists.items()}
            found |= {name: b"".join(r[name] for r in rows) for name in ("centre", "m")}
            found |= {name: np.concatenate([r[name] for r in rows]) for name in ("ids", "rs")}
            names = [c.split(" ")[0] for c in _BUNDLE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([found[n]]) for n in names], names=names)

        held, n = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(i)[row].as_py() if c in ("centre", "m") else _cell(batch, c, row) for i, c in enumerate(batch.schema.names)}
                if held and n + one["rows"] > BLOCK_ROWS:
                    yield bundle(held)
                    held, n = [], 0
                held.append(one | {c: one[c].copy() for c in ("ids", "rs")})
                n += one["rows"]
        if held:
            yield bundle(held)

    out = blocks if "least" in blocks.columns else blocks.withColumn("least", F.lit(float("-inf")))
    out = out.select("rows", "radius", "zero", "least_r", "least", "centre", "m", "ids", "rs")
    return written(out.mapInArrow(run, _BUNDLE).withColumn("block", F.monotonically_increasing_id()))


def _best_of_bundles(k: int, metric: str, csls: bool, told):
    """``src, tgt, sim`` of crossed bundles: of each source row the k best among the target blocks that may hold them; ``told`` counts those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def side(batch: pa.RecordBatch, row: int, s: str) -> dict:
            out = {c: _cell(batch, f"{s}_{c}", row) for c in ("block", "sizes", "centre", "radius", "zero", "least_r", "least", "ids", "m", "rs")}
            n = len(out["sizes"])
            return out | {"centre": out["centre"].reshape(n, -1), "m": out["m"].reshape(len(out["ids"]), -1), "ends": np.cumsum(out["sizes"])}

        a, best = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                if a is None or _cell(batch, "a_block", row) != a["block"]:
                    for each in best:
                        yield each.found()
                    a = {c: v.copy() if isinstance(v, np.ndarray) else v for c, v in side(batch, row, "a").items()}
                    cuts = [slice(e - n, e) for e, n in zip(a["ends"], a["sizes"])]
                    best = [Best(a["ids"][c], a["m"][c], a["rs"][c] if csls else None, k, metric, least) for c, least in zip(cuts, a["least"])]
                b = side(batch, row, "b")
                bound = upper_bounds(a, b, metric)
                if csls:
                    bound = 2 * bound - a["least_r"][:, None] - b["least_r"][None, :]
                # A number that is none bounds nothing.
                live = ~(bound < np.array([each.kth.min() for each in best])[:, None] - SLACK)
                told.add(int(live.sum()))
                for each, some in zip(best, live):
                    if some.all():
                        each.meet(b["ids"], b["m"], b["rs"] if csls else None)
                    elif some.any():
                        rows = np.repeat(some, b["sizes"])
                        each.meet(b["ids"][rows], b["m"][rows], b["rs"][rows] if csls else None)
        for each in best:
            yield each.found()

    return run


def pruned_candidates(
    source: DataFrame, target: DataFrame, k: int, metric: str = "inner", block_rows: int = BLOCK_ROWS, csls_k: int = 0, counts: dict | None = None,
) -> DataFrame:
    """``src, tgt, sim, place``, the rows of ``matching.top_candidates``; ``counts``, if given, is told how many block pairs there are and were multiplied.

    ``source`` and ``target`` are ``id, embedding`` and should be tables.
    """
    import numpy as np

    spark = source.sparkSession
    workers_find_package(spark)
    if csls_k:
        source, target = (_with_means(a, b, csls_k, metric, block_rows) for a, b in ((source, target), (target, source)))
    n = max(1, min(MAX_PIVOTS, -(-target.count() // block_rows)))
    first = target.select(F.xxhash64("id").alias("h"), "id", "embedding").orderBy("h", "id").limit(n).collect()  # at most MAX_PIVOTS vectors
    if not first:
        return spark.createDataFrame([], "src long, tgt long, sim double, place int")
    pivots = np.array([r["embedding"] for r in first], dtype=np.float64)
    a, b = packed_by_cell(source, pivots, metric, block_rows), packed_by_cell(target, pivots, metric, block_rows)
    best = _first_pairs(a, b, k, metric, bool(csls_k))
    # Over all packs of targets, again the best-bounded ones with k rows.
    order = Window.partitionBy("a").orderBy(F.desc("bound"), "b")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = written(best.withColumn("before", before).where(F.col("before") < k).select("a", "b"))
    found = _multiplied(one, a, b, k, metric, bool(csls_k))
    place = F.row_number().over(Window.partitionBy("block", "src").orderBy(F.desc("sim"), "tgt"))
    # A row with fewer than k values yet may take any target.
    rows = found.withColumn("place", place).where(F.col("place") <= k).groupBy("block", "src").agg(F.count("*").alias("n"), F.min("sim").alias("kth"))
    least = rows.groupBy("block").agg(F.min(F.when(F.col("n") >= k, F.col("kth")).otherwise(float("-inf"))).alias("least"))
    told = spark.sparkContext.accumulator(0)
    pairs = crossed(_bundles(a.join(written(least), "block")), _bundles(b))
    every = pairs.mapInArrow(_best_of_bundles(k, metric, bool(csls_k), told), "src long, tgt long, sim double")
    if counts is not None:
        every = written(every)
        counts |= {"pairs": a.count() * b.count(), "multiplied": one.count() + told.value}
    return best_rows(every, k)


def _with_means(rows: DataFrame, others: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """``rows`` with ``r``: the mean of their k largest similarities."""
    means = pruned_candidates(rows, others, k, metric, block_rows).groupBy(F.col("src").alias("id")).agg(F.avg("sim").alias("r"))
    return rows.join(written(means), "id").select(*rows.columns, "r")
