"""All source vectors against all target vectors, block by block, and what comes of it.

Vectors are ``id, embedding``. They are packed in blocks of rows; each pair of
blocks is one matrix product in numpy, reduced at once to what the caller needs: a
few values for each row. The matrix itself is never stored. A task meets a block of sources
with many blocks of targets one after the other and keeps its best so far, so that what is shuffled
is a few rows for each source and ``CROSS_BYTES`` of targets, not for each pair of blocks. Similarities are
computed in double precision and rounded to 12 places, so that equal ones stay
equal in any block; ties go to the smaller target id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import workers_find_package, written

BLOCK_ROWS = 1024
PLACES = 12
#: Bytes of the differences of vectors near each other that are held at once.
NEAR_BYTES = 1 << 24
#: Bytes of target blocks that one task meets a block of sources with.
CROSS_BYTES = 1 << 27
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def similarity(x, y, metric: str = "inner"):
    """The matrix of ``inner``, ``cosine``, ``euclidean`` (1 - distance) or ``manhattan`` (1 - distance)."""
    import numpy as np

    if metric == "inner":
        return x @ y.T
    if metric == "cosine":
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
        return unit(x) @ unit(y).T
    if metric == "euclidean":
        # From their middle on, fewer vectors seem near each other.
        middle = y.mean(axis=0) if len(y) else 0.0
        p, q = x - middle, y - middle
        both = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :]
        square = np.maximum(both - 2 * (p @ q.T), 0)
        # Where little is left of the sum, it is made of the differences themselves: equal vectors have distance 0.
        i, j = np.nonzero(square < both / 64)
        rows = max(1, NEAR_BYTES // (8 * max(1, x.shape[1])))
        for at in range(0, len(i), rows):
            a, b = i[at : at + rows], j[at : at + rows]
            square[a, b] = ((x[a] - y[b]) ** 2).sum(1)
        return 1 - np.sqrt(square)
    if metric == "manhattan":
        return 1 - np.stack([np.abs(y - row).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)))
    raise ValueError(f"unknown metric {metric}")


def pair_similarity(x, y, metric: str = "inner"):
    """``similarity`` of each row of ``x`` with the same row of ``y``."""
    import numpy as np

    if metric == "inner":
        return (x * y).sum(1)
    if metric == "cosine":
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
        return (unit(x) * unit(y)).sum(1)
    if metric == "euclidean":
        return 1 - np.sqrt(((x - y) ** 2).sum(1))
    if metric == "manhattan":
        return 1 - np.abs(x - y).sum(1)
    raise ValueError(f"unknown metric {metric}")


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                extra = [part.column(k).to_pylist() for k in range(2, part.num_columns)]
                matrix = np.array(part.column(1).to_pylist(), dtype=np.float64)
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())]
                columns += [pa.array([e], pa.list_(t.type)) for e, t in zip(extra, part.columns[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "m", *part.schema.names[2:]])

    return run


def packed(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks ``ids, m``, an array for each further column of ``vectors``, and a number ``block``."""
    workers_find_package(vectors.sparkSession)
    more = "".join(f", {n} array<{t}>" for n, t in vectors.dtypes[2:])
    return written(vectors.mapInArrow(_pack(block_rows), "ids array<long>, m binary" + more).withColumn("block", F.monotonically_increasing_id()))


def crossed(source: DataFrame, target: DataFrame) -> DataFrame:
    """All pairs of blocks of two tables with ``m``, columns named ``a_`` and ``b_``; a task has some source blocks and ``CROSS_BYTES`` of target blocks.

    The blocks are dealt anew, since a small file of vectors is one partition however many pairs it makes.
    """
    told = target.agg(F.count("*").alias("n"), F.sum(F.length("m")).alias("bytes")).first()
    parts = max(1, min(told["n"], -(-(told["bytes"] or 0) // CROSS_BYTES)))
    tasks = max(1, min(source.count(), 4 * source.sparkSession.sparkContext.defaultParallelism))
    left = source.repartition(tasks).select([F.col(c).alias(f"a_{c}") for c in source.columns])
    right = written(target.repartition(parts)).select([F.col(c).alias(f"b_{c}") for c in target.columns])
    return left.crossJoin(right.hint("shuffle_replicate_nl"))  # of blocks, not rows; a source block's pairs follow each other


def _cell(batch: pa.RecordBatch, name: str, row: int):
    """A value of a batch, vectors and lists without a copy: a batch of pairs holds the same blocks many times."""
    import numpy as np

    value = batch.column(batch.schema.get_field_index(name))[row]
    if isinstance(value, pa.BinaryScalar):
        return np.frombuffer(value.as_buffer())
    return value.values.to_numpy(zero_copy_only=False) if isinstance(value, pa.ListScalar) else value.as_py()


def blockwise(source: DataFrame, target: DataFrame, reduce: Callable, schema: str, metric: str = "inner") -> DataFrame:
    """``reduce(sims, source block, target block) -> dict of columns`` for each pair of packed blocks."""
    shape = pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                a, b = ({k[2:]: _cell(batch, k, row) for k in batch.schema.names if k[:2] == side} for side in ("a_", "b_"))
                x, y = (s["m"].reshape(len(s["ids"]), -1) for s in (a, b))
                yield pa.RecordBatch.from_pydict(reduce(np.round(similarity(x, y, metric), PLACES), a, b), schema=shape)

    return crossed(source, target).mapInArrow(run, schema)


def _rough(x, y, metric: str):
    """A matrix near the similarities and how far off it may be: 0 but for ``manhattan``, which is summed in single precision first."""
    import numpy as np

    if metric != "manhattan":
        return similarity(x, y, metric), 0.0
    size = max((np.abs(m).sum(axis=1).max() for m in (x, y) if len(m)), default=0.0)
    if not size < 1e30:  # also where it is no number
        return similarity(x, y, metric), 0.0
    p, q = x.astype(np.float32), np.ascontiguousarray(y.T.astype(np.float32))
    far = np.zeros((len(x), len(y)), np.float32)
    for i in range(0, len(x), 64):  # what is added up stays in a processor's cache
        part, one = far[i : i + 64], np.empty((len(p[i : i + 64]), len(y)), np.float32)
        for d in range(x.shape[1]):
            np.subtract(p[i : i + 64, d, None], q[d], out=one)
            np.abs(one, out=one)
            part += one
    return np.subtract(1, far, out=far), float((x.shape[1] + 4) * 2.0**-22 * (2 * size + 1))


class Best:
    """The ``k`` best targets so far of each source row of a block; rows below ``least`` are of no use.

    New values are compared with a row's k-th first, and only those that may pass it are rounded and put in order.
    """

    def __init__(self, ids, x, r, k: int, metric: str, least: float = float("-inf")):
        import numpy as np

        self.ids, self.x, self.r, self.k, self.metric = ids, x, r, k, metric
        self.row, self.sim, self.tgt = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.kth, self.new = np.full(len(ids), least), []

    def meet(self, ids, y, r) -> None:
        import numpy as np

        raw, off = _rough(self.x, y, self.metric)
        rough, off = (raw, off) if self.r is None else (2 * raw - self.r[:, None] - r[None, :], 2 * off)
        if not np.isfinite(rough.sum(dtype=np.float64)):
            i, j = np.indices(rough.shape).reshape(2, -1)
        else:
            least, n = self.kth, rough.shape[1]
            if n > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(rough, n - self.k, axis=1)[:, n - self.k])
            least = least - (2 * off + 1e-11 + 1e-12 * np.abs(least))
            i, j = np.nonzero(rough >= least.astype(rough.dtype)[:, None])
        if not len(i):
            return
        if self.metric == "manhattan":
            rows = max(1, NEAR_BYTES // (8 * max(1, y.shape[1])))
            sims = np.concatenate([pair_similarity(self.x[i[at : at + rows]], y[j[at : at + rows]], "manhattan") for at in range(0, len(i), rows)])
        else:
            sims = raw[i, j]
        sims = np.round(sims, PLACES)
        if self.r is not None:
            sims = np.round(2 * sims - self.r[i] - r[j], PLACES)
        self.new.append((i, sims, ids[j]))
        if sum(len(new[0]) for new in self.new) >= len(self.ids):
            self.settle()

    def settle(self) -> None:
        """Put what is new in its place; a value that is no number comes first, as in a sort of Spark's."""
        import numpy as np

        row, sim, tgt = (np.concatenate(c) for c in zip((self.row, self.sim, self.tgt), *self.new))
        order = np.lexsort((tgt, -sim, ~np.isnan(sim), row))
        row, first = row[order], np.zeros(len(self.ids) + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=len(self.ids)), out=first[1:])
        kept = np.arange(len(row)) - first[row] < self.k
        self.row, self.sim, self.tgt, self.new = row[kept], sim[order][kept], tgt[order][kept], []
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.kth[full] = sim[order][first[full] + self.k - 1]

    def found(self) -> pa.RecordBatch:
        if self.new:
            self.settle()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.tgt), pa.array(self.sim)], names=["src", "tgt", "sim"])


def best_of_pairs(k: int, metric: str, csls: bool):
    """``src, tgt, sim`` of rows of ``crossed``: the ``k`` best of each source row among the target blocks that a task meets it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: _cell(batch, name, row)  # noqa: B023, E731
                if best is None or cell("a_block") != block:
                    if best is not None:
                        yield best.found()
                    block, own = cell("a_block"), cell("a_ids").copy()
                    best = Best(own, cell("a_m").reshape(len(own), -1).copy(), cell("a_r").copy() if csls else None, k, metric)
                ids = cell("b_ids")
                best.meet(ids, cell("b_m").reshape(len(ids), -1), cell("b_r") if csls else None)
        if best is not None:
            yield best.found()

    return run


def best_rows(some: DataFrame, k: int) -> DataFrame:
    """``src, tgt, sim, place`` of ``some(src, tgt, sim)``: each source's ``k`` best, ties to the smaller target."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "tgt"))
    return some.withColumn("place", place).where(F.col("place") <= k)


def _best_of_packed(source: DataFrame, target: DataFrame, k: int, metric: str, csls: bool = False) -> DataFrame:
    return best_rows(crossed(source, target).mapInArrow(best_of_pairs(k, metric, csls), "src long, tgt long, sim double"), k)


def top_candidates(source: DataFrame, target: DataFrame, k: int, metric: str = "inner", block_rows: int = BLOCK_ROWS, csls_k: int = 0) -> DataFrame:
    """``src, tgt, sim, place``: the ``k`` best targets of each source, place from 1."""
    if csls_k:
        source, target = with_neighbourhood(source, target, csls_k, metric, block_rows)
    return _best_of_packed(packed(source, block_rows), packed(target, block_rows), k, metric, bool(csls_k))


def greedy_matches(source: DataFrame, target: DataFrame, metric: str = "inner", block_rows: int = BLOCK_ROWS, csls_k: int = 0) -> DataFrame:
    """``src, tgt, sim``: the best target of each source."""
    return top_candidates(source, target, 1, metric, block_rows, csls_k).drop("place")


def with_neighbourhood(source: DataFrame, target: DataFrame, k: int, metric: str = "inner", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``r``: the mean of the ``k`` largest similarities of a row, and of a column."""
    a, b = packed(source, block_rows), packed(target, block_rows)

    def means(rows: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
        r = written(_best_of_packed(x, y, k, metric).groupBy(F.col("src").alias("id")).agg(F.avg("sim").alias("r")))
        return rows.join(r, "id").select(*rows.columns, "r")

    return means(source, a, b), means(target, b, a)


def gold_ranks(source: DataFrame, target: DataFrame, gold: DataFrame, metric: str = "inner", block_rows: int = BLOCK_ROWS, csls_k: int = 0) -> DataFrame:
    """``src, tgt, ground_rank`` of ``gold(src, tgt)``: how many targets come before the gold one, by counting, without a sort.

    The gold similarities come from joins of the two vectors; one pass over all pairs counts.
    """
    import numpy as np

    left, right = source, target
    if csls_k:
        left, right = with_neighbourhood(source, target, csls_k, metric, block_rows)
    aimed = left.join(gold.select(F.col("src").alias("id"), F.col("tgt").alias("gold")), "id").select(*left.columns, "gold")

    def corrected(sims, a, b):
        return np.round(2 * sims - a["r"][:, None] - b["r"][None, :], PLACES) if csls_k else sims

    def of_gold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(k).to_pylist(), dtype=np.float64) for k in (2, 3))
                s = np.round(pair_similarity(x, y, metric), PLACES)
                if csls_k:
                    s = np.round(2 * s - batch.column(4).to_numpy() - batch.column(5).to_numpy(), PLACES)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["id", "gold", "s"])

    aims = right.select(F.col("id").alias("gold"), F.col("embedding").alias("aim"), *([F.col("r").alias("aim_r")] if csls_k else []))
    pairs = aimed.join(aims, "gold").select("id", "gold", "embedding", "aim", *(["r", "aim_r"] if csls_k else []))
    own = pairs.mapInArrow(of_gold, "id long, gold long, s double")
    scored = aimed.join(own, ["id", "gold"]).select(*aimed.columns, "s")
    targets = packed(right, block_rows)

    def count(sims, a, b):
        sims, s = corrected(sims, a, b), a["s"][:, None]
        before = (sims > s) | ((sims == s) & (b["ids"][None, :] < a["gold"][:, None]))
        return {"src": a["ids"], "n": (before & (b["ids"][None, :] != a["gold"][:, None])).sum(1)}

    counts = blockwise(packed(scored, block_rows), targets, count, "src long, n long", metric).groupBy("src").agg(F.sum("n").alias("ground_rank"))
    return gold.select("src", "tgt").join(counts, "src")


def ranking_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: Hits@k in percent, mean rank, mean reciprocal rank times 100, from ``ground_rank``."""
    rank = F.col("ground_rank") + 1
    hits = [F.round(F.avg((rank <= k).cast("double")) * 100, 2).alias(f"hits_{k}") for k in ks]
    return ranks.agg(*hits, F.avg(rank).alias("mr"), (F.avg(1 / rank) * 100).alias("mrr"))


def binary_metrics(rows: DataFrame, output: str, target: str) -> DataFrame:
    """One row: counts, accuracy, precision and recall in percent, F1; null where a division has no sense."""
    o, t = F.col(output) == 1, F.col(target) == 1
    counted = rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("tp", o & t), ("tn", ~o & ~t), ("fp", o & ~t), ("fn", ~o & t))])
    share = lambda a, b: F.try_divide(100.0 * a, b)
    out = counted.withColumns({
        "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def candidate_lists(top: DataFrame) -> DataFrame:
    """``src, candidates, cand_sims`` in order of place."""
    lists = top.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("place", "tgt", "sim"))).alias("x"))
    return lists.select("src", F.transform("x", lambda x: x["tgt"]).alias("candidates"), F.transform("x", lambda x: x["sim"]).alias("cand_sims"))


def scaled(sims: str = "cand_sims"):
    """A list between 0 and 1; 0 where all are equal."""
    low, high = F.array_min(sims), F.array_max(sims)
    return F.transform(sims, lambda s: F.when(high == low, 0.0).otherwise((s - low) / F.nullif(high - low, F.lit(0.0))))


def difficulty(sims: str = "cand_sims"):
    """Of a list of similarities: last less first, plus 10 by one and the weighted steps between neighbours."""
    steps = F.expr(f"aggregate(sequence(1, greatest(size({sims}) - 1, 1)), 0D, (a, i) -> a + coalesce(abs(get({sims}, i - 1) - get({sims}, i)), 0D) / i)")
    return F.element_at(sims, -1) - F.element_at(sims, 1) + 10 / (1 + steps)
