"""Operators 11 to 13 against brute force in plain Python: odd rows, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgalign.llm import clusters, filter_audit, lm_scoring
from kgalign.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- clusters ------------------------------------------------------------------------------------


def _brute_clusters(rows, k, rounds, dims):
    """``(vec_id, vector) -> (cluster, distance, cluster inertia, inertia, hash)`` as a list in the order of ``kept``."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(math.floor(64 * x)) <= 2**27 for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    square = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min((square(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            c[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [near(v) for _, v in kept]
    by = Counter()
    for d, j in found:
        by[j] += d
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return Counter((i, j, d, by[j], sum(by.values()), digest[j]) for (i, _), (d, j) in zip(kept, found))


@pytest.mark.parametrize("trees", [{}, {"tree_rows": 50, "leaf_rows": 3}, {"tree_rows": 7, "leaf_rows": 1}])
def test_clusters(spark, trees):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 4))
    rows = [(i, [float(x) for x in middle[i % 5] + rng.normal(size=4) * 0.1]) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(120)]  # a third of all rows are equal
    rows += [(1, rows[0][1]), (1, [1.0, 2.0, 3.0, 4.0]), (None, rows[3][1]), (None, rows[4][1]), (500, [1e6, -1e6, 0.0, 2e6]), (501, [-0.0, 1e-300, -1e-300, 0.0])]
    odd = [(600, None), (601, []), (602, [1.0] * 3), (603, [1.0, None, 1.0, 1.0]), (604, [float("nan"), 1.0, 1.0, 1.0]), (605, [float("inf"), 1.0, 1.0, 1.0]), (606, [-1e300, 1.0, 1.0, 1.0]), (607, [1e9, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "ids": F.lit(1)}).repartition(3)
    got = Counter(tuple(r) for r in clusters.centroid_clusters(spark, df, k=6, dims=4, **trees).collect())
    assert got == _brute_clusters(rows + odd, 6, 3, 4)


def test_clusters_of_few_vectors_and_of_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in clusters.centroid_clusters(spark, df, k=16, dims=2).collect()) == _brute_clusters(rows, 16, 3, 2)
    none = clusters.centroid_clusters(spark, df.limit(0), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ball_trees_are_whole_and_balls_go_as_a_whole():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.integers(-20, 20, (500, 8)) + 1000 * i for i in range(4)])
    order, nodes = clusters.ball_tree(points, 16)
    assert sorted(order.tolist()) == list(range(2000))
    points = points[order]
    for i in range(len(nodes["start"])):
        inside = points[nodes["start"][i] : nodes["stop"][i]]
        assert (nodes["total"][i] == inside.sum(axis=0)).all()
        assert np.sqrt(((inside - inside.mean(axis=0)) ** 2).sum(axis=1)).max() <= nodes["radius"][i] + 1e-6
        if nodes["child"][i]:
            a, b = nodes["child"][i], nodes["child"][i] + 1
            assert (nodes["start"][a], nodes["stop"][a], nodes["stop"][b]) == (nodes["start"][i], nodes["start"][b], nodes["stop"][i])
    c = np.array([[1000 * i] * 8 for i in range(4)])
    (balls, ball_of), (rows, row_of) = clusters.walk(points, nodes, c)
    taken = sum((nodes["stop"] - nodes["start"])[balls])
    assert taken + len(rows) == 2000 and taken == 2000 and len(balls) < 40  # four groups far from each other
    c = rng.integers(0, 3000, (5, 8))
    c[3] = c[1]  # a tie goes to the smaller number
    (balls, ball_of), (rows, row_of) = clusters.walk(points, nodes, c)
    found = np.full(2000, -1)
    for ball, k in zip(balls, ball_of):
        found[nodes["start"][ball] : nodes["stop"][ball]] = k
    found[rows] = row_of
    assert (found == ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_squares_are_exact():
    x, c = np.array([[2**27, -(2**27)], [1, 2]]), np.array([[-(2**27), 2**27 - 1]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, c[0]))] for row in x]
    assert clusters.squared(x, c).tolist() == want


# --- language model --------------------------------------------------------------------------------


def _tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def _level(count):
    return int(np.searchsorted(lm_scoring.thresholds(lm_scoring.BASE), count, side="right"))


def _brute_scores(rows, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, words = [Counter() for _ in range(order)], Counter()
    padded = lambda t: ["<start>"] * (order - 1) + _tokens(t)
    for i, t in rows:
        if not held(i):
            seq = padded(t)
            words.update(_tokens(t))
            for at in range(order - 2 if order > 1 else 0, len(seq)):
                for m in range(1, order + (at >= order - 1)):
                    counts[m - 1][tuple(seq[at - m + 1 : at + 1])] += 1
    n, v, expected = sum(words.values()), len(words), lm_scoring.expected_counts(lm_scoring.BASE)
    count = lambda gram: expected[_level(counts[len(gram) - 1][gram])] if counts[len(gram) - 1][gram] else 0.0
    for i, t in rows:
        seq, score, tokens = padded(t), 0.0, _tokens(t)
        for at in range(order - 1, len(seq)):
            p = (count((seq[at],)) + 0.5) / (n + 0.5 * (v + 1))
            for m in range(2, order + 1):
                context = count(tuple(seq[at - m + 1 : at]))
                p = (min(count(tuple(seq[at - m + 1 : at + 1])), context) + lm_scoring.STRENGTH * p) / (context + lm_scoring.STRENGTH)
            score += math.log10(p)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        yield i, held(i), len(tokens), sum(words[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)


def _texts(n=60):
    rng = random.Random(4)
    words = ["the", "The", "cat", "dog", "épée", "ÉPÉE", "sat", "on", "mat.", "日本"]
    rows = [(i, " ".join(rng.choices(words, [9, 3, 2, 2, 1, 1, 2, 2, 1, 1], k=rng.randint(0, 40)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "the cat"), (None, None), (7, "the\x0bcat\x0csat"), (7, "the\x0bcat\x0csat"), (103, "a b   c"), (104, "x" * 3000 + " " + "the " * 5000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"order": 1}, {"order": 3, "part_bytes": 500}, {"order": 3, "part_bytes": 500, "max_broadcast": 0}, {"piece": 7, "part_bytes": 5000}, {"piece": 7, "order": 3, "max_broadcast": 0}])
def test_scores(spark, options):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"held_out": F.lit("clash"), "score": F.lit(1)}).repartition(3)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.score_texts(spark, df, bits_each=64, **options).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = list(_brute_scores(rows, options.get("order", lm_scoring.ORDER)))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def test_scores_are_the_same_by_broadcast_and_by_shuffle(spark):
    df = spark.createDataFrame(_texts(200), "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    one, two = (sorted(lm_scoring.score_texts(spark, df, part_bytes=1000, max_broadcast=b).collect(), key=key) for b in (1 << 26, 0))
    assert len(one) == len(two) == 209
    for a, b in zip(one, two):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-8 and abs(a.score - b.score) < 1e-8


def test_scores_of_no_texts_and_without_training(spark):
    none = lm_scoring.score_texts(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for bound in (0, 1 << 26):
        r = lm_scoring.score_texts(spark, only, held=F.lit(True), max_broadcast=bound).first()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0.0)


def test_levels_of_the_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    counts = np.maximum(1, (rng.pareto(1.0, 20_000) * 3).astype(np.int64))
    levels = np.searchsorted(lm_scoring.thresholds(lm_scoring.BASE), counts, side="right")
    bits, size, top = lm_scoring.build_filter(keys, levels)
    found = lm_scoring.probe(np.frombuffer(bits, dtype=np.uint8), size, top, keys)
    absent = lm_scoring.probe(np.frombuffer(bits, dtype=np.uint8), size, top, rng.integers(0, 2**64, 50_000, dtype=np.uint64))
    assert (found >= levels).all() and (found > levels).mean() < 0.006 and (absent > 0).mean() < 0.006
    expected = lm_scoring.expected_counts(lm_scoring.BASE)[levels]
    assert (expected[counts <= 4] == counts[counts <= 4]).mean() > 0.8 and (np.abs(expected - counts) <= counts / 3).all()


def test_model_fits_held_out_texts_better_than_its_base(spark):
    rng = random.Random(1)
    follows = {i: rng.sample(range(200), 4) for i in range(200)}

    def text():
        out = [rng.randrange(200)]
        for _ in range(40):
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(f"w{i}" for i in out)

    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    r = lm_scoring.score_texts(spark, df).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert r[1] / r[2] > 0.55 * r[0] / r[2]  # log 4 of log 200 would be 0.26; the base has no order


def test_what_is_learned_grows_with_the_texts(spark):
    sizes = []
    for n in (50, 500):
        df = spark.range(n).select(F.concat_ws(" ", *[F.md5(F.concat_ws(":", "id", F.lit(k))) for k in range(20)]).alias("text"))
        model, parts = lm_scoring.learn(Scratch(spark, "lm"), df, part_bytes=20_000)
        row = model.agg(F.sum(F.length("bits")).alias("bits"), F.max(F.length("bits")).alias("most"), F.sum("tokens").alias("tokens")).first()
        sizes.append((parts, row.bits, row.most))
        assert row.tokens == 21 * n
    assert sizes[1][0] >= 8 * sizes[0][0] and sizes[1][1] > 9 * sizes[0][1] and sizes[1][2] < 2 * sizes[0][2]


# --- audit of filters ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_every_order_is_met_by_swaps_of_neighbours(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in filter_audit.transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def _fails(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        a, b = len(w) < 50, 100 * len(set(w)) < 65 * len(w)
        c, d = 100 * sum("A" <= ch <= "Z" for ch in t) > 5 * len(t), any(ch in "#$%&*|" for ch in t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append(dict(zip("ABCDE", (a, b, c, d, e))))
    return out


def _brute_audit(rows, good, toxic, names="ABCDE"):
    fails, removed = _fails(rows), Counter()
    found = []
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        for order in permutations(names):
            left = own
            for k, f in enumerate(order):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                failing = sum(x[f] for _, x in own)
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                removed[part, f] += len(gone)
                found.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
    return Counter((*row[:-1], removed[row[0], row[-1]]) for row in found)


def test_audit(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)] + ["Upper", "CASE", "x#y", "é"]
    rows = []
    for i in range(90):
        text = " ".join(rng.choices(words if i % 3 else words[:20], k=rng.choice([5, 60, 70])))
        rows.append((i, text + rng.choice(["", "", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]), rng.choice(["a", "b", None, ""])))
    rows += [(200 + i, "the same text in many rows", "a") for i in range(60)] + [(300 + i, rows[i][1], "b") for i in range(20)]
    rows += [(1, rows[1][1], "c"), (1, rows[1][1], "c"), (None, rows[2][1], "c"), (None, rows[2][1], "c"), (400, None, "c"), (401, "", "c"), (402, "\t\n ", None), (403, "long " * 20_000, "a")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)] + [(3, None, 1), (3, 1, None), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("clash"), "mask": F.lit(1), "key": F.lit("k")}).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = filter_audit.audit_filters(spark, docs, known)
    assert Counter(tuple(r) for r in got.collect()) == _brute_audit(rows, good, toxic)
    assert filter_audit.audit_filters(spark, docs.limit(0), known).count() == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", m % 8, m % 2, 0) for m in range(50)], "part string, mask int, good long, toxic long")
    got = filter_audit.audit(rows, "XYZ").collect()
    assert len(got) == 18 and sum(r.removed for r in got if r.filter_order == "ZXY") == sum(m % 8 > 0 for m in range(50))
    by = {r.filter_order[r.step - 1]: r.shapley for r in got}
    assert sum(by.values()) == 6 * sum(m % 8 > 0 for m in range(50))
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "AA")
