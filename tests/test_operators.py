"""Operators on small frames, worked out by hand or against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgalign import storage
from kgalign.jobs import queries
from kgalign.operators import enrich, graph, matching, pruning, resolve, splits, texts, tokens, vectors


def test_functionality_and_order(spark):
    t = spark.createDataFrame([("a", "p", "x", 0), ("a", "p", "x", 1), ("a", "q", "y", 2), ("b", "q", "x", 3)], "subj string, pred string, obj string, pos long")
    assert {r.pred: r.functionality for r in graph.functionality(t).collect()} == {"p": 0.5, "q": 1.0}
    ranked = {(r.subj, r.pred, r.pos): r["rank"] for r in graph.ordered_facts(t).collect()}
    assert ranked == {("a", "q", 2): 1, ("a", "p", 0): 2, ("a", "p", 1): 3, ("b", "q", 3): 1}
    names = graph.dictionary(graph.entity_names(t, t))
    assert [r.name for r in names.orderBy("id").collect()] == ["a", "b", "x", "y"]


def test_dense_ids_do_not_depend_on_partitions(spark):
    for n in (1, 3, 7):
        rows = graph.dense_ids(spark.range(100).repartition(n), ["id"], "n").collect()
        assert sorted((r.id, r.n) for r in rows) == [(i, i) for i in range(100)]


@pytest.mark.parametrize("n", [7, 8, 9])
def test_eight_properties_at_most(spark, n):
    rows = [("e", f"p{i}", f'"v{i}"', i) for i in range(n)]
    t = spark.createDataFrame(rows, "subj string, pred string, obj string, pos long")
    ents = spark.createDataFrame([("e",), ("alone",)], "name string")
    got = {r.name: r.content for r in texts.attribute_text(ents, t).collect()}
    assert got["e"] == '"e" has the following attributes: ' + ", ".join(f"p{i}: v{i}" for i in range(min(n, 8))) + ". "
    assert got["alone"] == "alone. "


def test_long_values_and_digits(spark):
    many = [("e", "p", f'"{"x" * 21}"', 0)] + [("e", "q", f'"{i}23456789"', i + 1) for i in range(10)]
    t = spark.createDataFrame(many, "subj string, pred string, obj string, pos long")
    got = texts.attribute_text(spark.createDataFrame([("e",)], "name string"), t).first().content
    assert got == '"e" has the following attributes: p: . Besides, "e" has other attributes such as q. '


def test_relation_text(spark):
    t = spark.createDataFrame([("a", "r", "b", 0), ("c", "r", "b", 1), ("d", "r", "b", 2), ("e", "r", "b", 3)], "subj string, pred string, obj string, pos long")
    got = {r.name: r.content for r in texts.relation_text(spark.createDataFrame([("a",), ("b",), ("z",)], "name string"), t).collect()}
    opening = '" has some relations with other terms/entities: '
    assert got == {"a": f'"a{opening}its r is b. ', "b": f'"b{opening}a and c and d\'s r are "b". ', "z": "z."}


def test_relation_table_leaves_nothing_out(spark):
    t = spark.createDataFrame([(x, "r", "hub", i) for i, x in enumerate("dcba")] + [("a", "q", "z", 9)], "subj string, pred string, obj string, pos long")
    got = {(r.subj, r.pred, r.direction, r.key_rank, r.place): (r.obj, r.n) for r in graph.relation_table(t).collect()}
    want = {("hub", "r-inv", "in", 1, i + 1): (x, 4) for i, x in enumerate("dcba")} | {("z", "q-inv", "in", 1, 1): ("a", 1)}
    want |= {(x, "r", "out", 1, 1): ("hub", 1) for x in "dcba"} | {("a", "q", "out", 2, 1): ("z", 1)}
    assert got == want


def test_property_table_of_all_entities(spark):
    t = spark.createDataFrame([("a", "p", '"1"', 0), ("a", "p", '"2"', 1), ("a", "q", '"3"', 2)], "subj string, pred string, obj string, pos long")
    ents = spark.createDataFrame([(0, "a"), (1, "alone")], "id long, name string")
    got = [tuple(r) for r in graph.property_table(t, entities=ents).orderBy("ent_id", "key_rank").collect()]
    assert got == [(0, "a", "q", 1, ["3"], 1), (0, "a", "p", 2, ["1", "2"], 2), (1, "alone", None, None, None, None)]
    assert [tuple(r) for r in graph.property_header(t).orderBy("id").collect()] == [(0, "p"), (1, "q")]
    assert [tuple(r) for r in graph.property_header(t, 0.9).collect()] == [(1, "q")]


def test_neighbours_with_attributes_first(spark):
    rel = [("e", f"r{i}", f"n{i}", i) for i in range(5)] + [("x", "back", "e", 9)]
    rel = spark.createDataFrame(rel, "subj string, pred string, obj string, pos long")
    attr = spark.createDataFrame([("n4", "p", '"it\'s"', 0), ("x", "p", '"w"', 1)], "subj string, pred string, obj string, pos long")
    ents = spark.createDataFrame([("e",)], "name string")
    text = lambda **o: texts.attribute_relation_text(ents, attr, rel, **o).first().content
    assert text() == "Entity [e]\\nRelations: \\n-> r0 -> n0\\n-> r1 -> n1\\n-> r2 -> n2\\n-> r3 -> n3\\n"
    assert text(prefer_attributed=True) == "Entity [e]\\nRelations: \\n-> r4 -> n4 ({'p': \"it's\"})\\n<- back <- x ({'p': 'w'})\\n-> r0 -> n0\\n-> r1 -> n1\\n"


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_texts_read_their_triples_a_few_times(spark):
    t = spark.createDataFrame([("a", "r", "b", 0)], "subj string, pred string, obj string, pos long")
    ents = storage.written(t.select(F.col("subj").alias("name")))
    assert _scans(texts.relation_text(ents, t)) <= 12 and _scans(texts.attribute_relation_text(ents, t, t)) <= 20


def test_tables_are_not_written_again(spark):
    rel = storage.written(spark.createDataFrame([("a", "r", "b", 0)], "subj string, pred string, obj string, pos long"))
    assert storage.as_table(rel) is rel and storage.as_table(rel.where("pos = 0")) is not rel


def test_what_steps_leave_can_be_removed(spark):
    import os

    root = f"{storage.shared_folder(spark)}/kgalign/{spark.sparkContext.applicationId}"
    kept = storage.written(spark.range(3))
    with storage.temporary(spark):
        gone = storage.written(spark.range(5))
        before = set(os.listdir(root))
        assert gone.count() == 5
    assert len(before - set(os.listdir(root))) == 1 and kept.count() == 3


def test_links(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("c", "z"), ("d", "b"), ("b", "w")]
    links = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(rows)], "src string, tgt string, pos long")
    bad = {rows[i] for j in range(len(rows)) for i in range(j) if rows[i][0] == rows[j][0] or rows[i][1] == rows[j][0]}
    want = sorted(r for r in rows if r not in bad)
    assert sorted((r.src, r.tgt) for r in resolve.cleaned_links(links).collect()) == want
    one = resolve.cleaned_links(links, "one_to_one").collect()
    assert sorted((r.src, r.tgt) for r in one) == [("a", "x"), ("c", "z"), ("d", "b")]


@pytest.mark.parametrize("n", [0, 1, 9, 10])
@pytest.mark.parametrize("ratio", [0, 0.05, 0.4, 1])
def test_exact_counts(spark, n, ratio):
    rows = spark.range(n).select(F.col("id").cast("string").alias("name"))
    assert splits.sampled(rows, ratio, ["name"]).count() == n - int(n * ratio)
    masked = splits.masked_names(rows, ratio).collect()
    assert len({r.new_name for r in masked}) == len(masked) == int(n * ratio)


def test_split_is_whole(spark):
    links = spark.range(5919).selectExpr("concat('s', id) AS src", "concat('t', id) AS tgt")
    parts = {r.part: r["count"] for r in splits.split_links(links).groupBy("part").count().collect()}
    assert parts == {"train": 1183, "valid": 591, "test": 4145}


def _vectors(spark, x, start):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean", "manhattan"])
@pytest.mark.parametrize("csls", [0, 3])
def test_matching_against_numpy(spark, metric, csls):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-2, 3, (12, 4)).astype(float), rng.integers(-2, 3, (11, 4)).astype(float)
    x[0] = 0
    s = np.round(matching.similarity(x, y, metric), 12)
    if csls:
        top = lambda m: np.sort(m, axis=1)[:, -csls:].mean(axis=1)
        s = np.round(2 * s - top(s)[:, None] - top(s.T)[None, :], 12)
    a, b = _vectors(spark, x, 0), _vectors(spark, y, 100)
    for block in (3, 64):
        got = matching.top_candidates(a, b, 5, metric, block, csls).collect()
        want = {(i, p + 1): 100 + j for i in range(12) for p, j in enumerate(np.lexsort((np.arange(11), -s[i]))[:5])}
        assert {(r.src, r.place): r.tgt for r in got} == want
        gold = spark.createDataFrame([(i, 100 + i) for i in range(11)], "src long, tgt long")
        ranks = {r.src: r.ground_rank for r in matching.gold_ranks(a, b, gold, metric, block, csls).collect()}
        assert ranks == {i: int(((s[i] > s[i, i]) | ((s[i] == s[i, i]) & (np.arange(11) < i))).sum()) for i in range(11)}


def test_equal_vectors_have_euclidean_similarity_one_in_any_block(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.concatenate((x, x[::-1], x + 1e-7))
    whole = matching.similarity(x, y, "euclidean")
    assert (whole[np.arange(40), np.arange(40)] == 1).all() and (whole[np.arange(40), 79 - np.arange(40)] == 1).all()
    exact = 1 - np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert np.abs(whole - exact).max() < 1e-14
    for n in (1, 7):
        parts = np.concatenate([matching.similarity(x[i : i + n], y, "euclidean") for i in range(0, 40, n)])
        assert (np.round(parts, 12) == np.round(whole, 12)).mean() > 0.999 and (parts[whole > 0.9] == whole[whole > 0.9]).all()
    got = matching.top_candidates(_vectors(spark, x, 0), _vectors(spark, y[:80], 100), 2, "euclidean", 7).collect()
    assert {(r.src, r.place): (r.tgt, r.sim) for r in got} == {(i, p): (t, 1.0) for i in range(40) for p, t in ((1, 100 + i), (2, 179 - i))}
    for metric in ("inner", "cosine", "euclidean", "manhattan"):
        assert np.allclose(matching.pair_similarity(x, y[:40], metric), np.diag(matching.similarity(x, y[:40], metric)), atol=1e-14)


def test_metrics_and_lists(spark):
    ranks = spark.createDataFrame([(0,), (4,), (9,), (20,)], "ground_rank long")
    m = matching.ranking_metrics(ranks).first()
    assert (m.hits_1, m.hits_5, m.hits_10, m.mr) == (25.0, 50.0, 75.0, 9.25)
    lists = spark.createDataFrame([([0.9, 0.5, 0.5],), ([0.3, 0.3],)], "cand_sims array<double>")
    rows = lists.select(matching.difficulty().alias("d"), matching.scaled().alias("z")).collect()
    assert rows[0].d == pytest.approx(-0.4 + 10 / 1.4) and rows[1].z == [0.0, 0.0]
    b = spark.createDataFrame([(1, 0), (1, 0)], "o int, t int")
    assert matching.binary_metrics(b, "o", "t").first().recall is None


def test_vectors(spark):
    x = np.random.default_rng(2).normal(size=(20, 6))
    x[:, 3:] = x[:, :3]  # rank 3
    x[5] = 0
    got = {r.id: np.array(r.embedding) for r in vectors.reduced(_vectors(spark, x, 0), 4).collect()}
    z = np.stack([got[i] for i in range(20)])
    parts = {r.row: np.frombuffer(r.vals) for r in vectors.gram(_vectors(spark, x, 0)).collect()}
    assert np.allclose(np.stack([parts[i] for i in range(6)]), x.T @ x)
    both = vectors.stacked(_vectors(spark, x[:2], 0), _vectors(spark, x[:3], 0))
    assert {r.kg: r["count"] for r in both.groupBy("kg").count().collect()} == {1: 2, 2: 3}
    _, d = np.linalg.eigh(x.T @ x)
    w = x @ d[:, ::-1][:, :4]
    w = w / np.where((n := np.linalg.norm(w, axis=1, keepdims=True)) > 1e-9, n, 1)
    assert z.shape == (20, 4) and np.allclose(np.delete(z @ z.T, 5, 0), np.delete(w @ w.T, 5, 0), atol=1e-6)


def test_tokens(spark):
    t = spark.createDataFrame([(1, "b a b"), (2, None)], "id long, content string")
    assert [(r.token, r.n) for r in tokens.token_frequencies(t).collect()] == [("b", 2), ("a", 1)]
    v = spark.createDataFrame([(0, "a"), (1, "b")], "id long, name string")
    assert {r.id: r.token_ids for r in tokens.token_ids(t, v).collect()} == {1: [1, 0, 1], 2: []}


@pytest.mark.parametrize("bundle_bytes", [1, 1 << 20])
def test_token_ids_by_bundles(spark, bundle_bytes):
    """A bundle asks for a token once, however often it stands there; unknown tokens are left out, names in the vocabulary twice give both ids."""
    said = [(7, "b a b"), (-3, None), (5, ""), (2, "c x a " + "b " * 500), (9, "x")] + [(100 + i, "a b c " * 40) for i in range(60)]
    t = spark.createDataFrame(said, "id long, content string").coalesce(1)
    bundles = tokens.bundled(t, bundle_bytes=bundle_bytes)
    assert bundles.count() == (1 if bundle_bytes > 1 else -(-len(said) // 16))
    names = tokens.names_of(bundles)
    assert names.count() <= 4 * bundles.count()  # 7,708 tokens
    assert {(r.name, r.pos.id, r.pos["at"]) for r in names.groupBy("name").agg(F.min("pos").alias("pos")).collect()} == {("c", 2, 0), ("x", 2, 1), ("a", 2, 2), ("b", 2, 3)}
    v = spark.createDataFrame([(0, "a"), (1, "b"), (3, "c"), (2, "c"), (4, "no")], "id int, name string")
    known = {"a": [0], "b": [1], "c": [2, 3]}
    want = {i: [n for w in (c or "").split() for n in known.get(w, [])] for i, c in said}
    got = tokens.ids_of_bundles(bundles, v)
    assert got.dtypes == [("id", "bigint"), ("token_ids", "array<bigint>")] and {r.id: r.token_ids for r in got.collect()} == want
    assert {r.token_ids == [] for r in tokens.ids_of_bundles(bundles, v.where("id = 4")).collect()} == {True}
    assert tokens.token_ids(t.where("id = 0"), v).count() == 0
    # Ids of another type, equal and missing ones, and a tokenizer that gives nulls.
    odd = spark.createDataFrame([("y", "b"), ("x", "c b"), ("x", "b"), (None, "a")], "id string, content string").coalesce(1)
    cut = tokens.bundled(odd, lambda c: F.when(c != "a", F.split(F.concat(c, F.lit(" ?")), " ")))
    assert {(r.name, r.pos.id, r.pos["at"]) for r in tokens.names_of(cut).collect()} == {("b", "x", 0), ("c", "x", 0), ("?", "x", 1)}
    assert sorted((r.id or "", r.token_ids) for r in tokens.ids_of_bundles(cut, v).collect()) == [("", []), ("x", [1]), ("x", [2, 3, 1]), ("y", [1])]
    nulls = tokens.token_ids(odd, v, lambda c: F.array(F.lit(None).cast("string"), c))
    assert sorted((r.id or "", r.token_ids) for r in nulls.collect()) == [("", [0]), ("x", []), ("x", [1]), ("y", [1])]


def _records_shuffled(spark, f):
    """Rows that the stages of ``f()`` write for shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    last = max(stages(), default=-1)
    f()
    return sum(n for stage, n in stages().items() if stage > last)


def test_token_ids_shuffle_no_row_for_each_place(spark, tmp_path):
    """A row for each place of a token went through the joins and the grouping by text; now one for each bundle and token does."""
    at = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: ((F.col("id") * 7 + i * i) % 90).cast("string"))
    spark.range(200).select(F.col("id").alias("doc_id"), F.array_join(at, " ").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got, old = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with a vocabulary too large to broadcast
    try:
        moved = _records_shuffled(spark, lambda: got.extend(queries.queries()["token_ids"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(len(r.token_ids.split(" ")) for r in got) == [500] * 200
    assert 0 < moved < 2000  # 100,000 tokens, 90 of them distinct


def test_enrichment(spark):
    def _fails_on_x(question):
        if "x" in question.split("Details:")[-1]:
            raise RuntimeError("no")
        return "fine\n"

    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, content string")
    good, bad = enrich.with_fallback(t, _fails_on_x, lambda q: "second", kind="simple")
    assert {r.id: r.content for r in good.collect()} == {1: "second", 2: "fine"} and bad.count() == 0
    assert [r.id for r in enrich.still_to_do(t, good.where("id = 1")).collect()] == [2]
    rows = enrich.summarized(t.select("id", "content"), lambda q: q.upper() if q.endswith("y") else _fails_on_x("Details:x"), template="Say: ", tries=2)
    assert {r.id: (r.content, r.summary, r.status) for r in rows.collect()} == {1: ("x", None, "error"), 2: ("y", "SAY: Y", "ok")}
    assert [r.value for r in enrich.each_line(t.selectExpr("id as pos", "name as value"), str.upper).orderBy("pos").collect()] == ["A", "B"]


@pytest.mark.parametrize("order", ["hard", "easy", "random"])
def test_shares_of_rows_pass_no_single_task(spark, order):
    rows = spark.range(100).select("id", (F.col("id") % 7 / 7).alias("difficulty"))
    got = splits.hard_entities(rows, 0.3, order)
    first = {"hard": lambda r: (-r.difficulty, r.id), "easy": lambda r: (r.difficulty, r.id)}.get(order)
    assert got.count() == 30 and got.columns == ["id", "difficulty"]
    assert not first or {r.id for r in got.collect()} == {r.id for r in sorted(rows.collect(), key=first)[:30]}
    texts_ = spark.range(50).select(F.col("id").cast("string").alias("name"), F.expr("repeat('x', cast(id % 9 as int))").alias("content"))
    short = splits.shortest_texts(texts_.select("name"), texts_, 0.2)
    want = sorted(texts_.collect(), key=lambda r: (len(r.content), r.name))[:10]
    assert {r.name for r in short.collect()} == {r.name for r in want}
    assert all("Limit" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (got, short))


def _hub(spark, n=3000):
    """A subject with many facts over several predicates, spread over files, and its in-edges."""
    rel = [("hub", f"r{i % 12}", f"o{i * 7 % n}", i) for i in range(n)] + [(f"s{i}", f"q{i % 12}", "hub", n + i) for i in range(n)] + [("s1", "r3", "o5", 9 * n)]
    return spark.createDataFrame(rel, "subj string, pred string, obj string, pos long").repartition(7)


def _plans(build):
    """The text of all plans that ran while ``build`` made and wrote its result."""
    from kgalign import storage as st

    plans, old = [], st.written

    def told(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return old(df)

    for module in (graph, texts):
        module.written = told
    try:
        told(build())
    finally:
        for module in (graph, texts):
            module.written = old
    return plans


def test_no_window_takes_all_facts_of_a_subject(spark):
    """Texts are made of first keys and first values; what is cut is cut in each task before it is shuffled."""
    rel = storage.written(_hub(spark))
    attr = storage.written(rel.select("subj", "pred", F.concat(F.lit('"'), "obj", F.lit('"')).alias("obj"), "pos"))
    ents = rel.select(F.col("subj").alias("name")).distinct()
    for build in (lambda: texts.attribute_text(ents, attr), lambda: texts.relation_text(ents, rel), lambda: texts.attribute_relation_text(ents, attr, rel)):
        plans = _plans(build)
        for plan in plans:
            for line in plan.splitlines():
                if "Window [" in line:
                    by = line.split("windowspecdefinition(")[1].split("ASC")[0]
                    assert "subj#" in by and "pred#" in by, line
    plan = "".join(plans)
    assert plan.count("WindowGroupLimit") >= 3 and "Partial" in plan


def test_first_values_of_a_hub(spark):
    rel = _hub(spark)
    rows = rel.collect()
    first = {}
    for r in rows:
        first[r.obj] = min(first.get(r.obj, 10**9), r.pos)
    for most in (None, 2):
        got = {(r.pred): (r.key_rank, r.vals, r.n) for r in graph.keyed(rel, 8, most).where("subj = 'hub'").collect()}
        of = lambda p: [r for r in rows if r.subj == "hub" and r.pred == p]
        f = {p: len({r.subj for r in rows if r.pred == p}) / len([r for r in rows if r.pred == p]) for p in {r.pred for r in rows}}
        preds = sorted({r.pred for r in rows if r.subj == "hub"}, key=lambda p: (-f[p], min(r.pos for r in rows if r.pred == p), p))[:8]
        want = {p: (k + 1, [r.obj for r in sorted(of(p), key=lambda r: (first[r.obj], r.obj, r.pos))][:most], len(of(p))) for k, p in enumerate(preds)}
        assert got == want
    back = {r.pred: (r.key_rank, r.vals, r.n) for r in graph.in_keys(rel, 8, 3).where("subj = 'hub'").collect()}
    into = lambda p: sorted((r.pos, r.subj) for r in rows if r.obj == "hub" and r.pred == p)
    preds = sorted({r.pred for r in rows if r.obj == "hub"}, key=lambda p: (into(p)[0][0], p))[:8]
    assert back == {p: (k + 1, [s for _, s in into(p)[:3]], len(into(p))) for k, p in enumerate(preds)}


def test_facts_of_hubs_are_ranked_by_range(spark, monkeypatch):
    rel = storage.written(_hub(spark, 400))
    key = lambda r: (r.subj, r.pred, r.obj, r.pos)
    want = {key(r): r["rank"] for r in graph.ordered_facts(rel).collect()}
    assert {key(r): r["rank"] for r in graph.ordered_facts(rel, hub_facts=300).collect()} == want
    assert {key(r): r["rank"] for r in graph.ordered_facts(rel, hub_facts=1).collect()} == want and len(want) == 801
    table = [tuple(r) for r in graph.relation_table(rel).collect()]
    old = graph.ordered_facts
    monkeypatch.setattr(graph, "ordered_facts", lambda t: old(t, 300))
    assert sorted(map(repr, table)) == sorted(repr(tuple(r)) for r in graph.relation_table(rel).collect())


def _as_literals(rel):
    return rel.select("subj", "pred", F.concat(F.lit('"'), "obj", F.lit('"')).alias("obj"), "pos")


def test_hubs_have_the_texts_that_packed_subjects_have(spark, monkeypatch):
    rel = storage.written(_hub(spark, 60).unionByName(spark.createDataFrame([("o5", "back", "s1", 7), ("o6", "back", "hub", 8)], "subj string, pred string, obj string, pos long")))
    attr = storage.written(_as_literals(rel.where("subj <> 's7'")).unionByName(spark.createDataFrame([("hub", "long", '"' + "x" * 30 + '"', 5), ("o5", "p", '"v"', 6)], "subj string, pred string, obj string, pos long")))
    ents = rel.select(F.explode(F.array("subj", "obj")).alias("name")).distinct()
    build = (
        lambda: texts.attribute_text(ents, attr), lambda: texts.relation_text(ents, rel, 2), lambda: texts.attribute_relation_text(ents, attr, rel, True),
        lambda: graph.keyed(rel, least_functionality=0.9),
    )
    some = []
    for most in (1 << 11, 1):
        monkeypatch.setattr(graph, "PACKED_FACTS", most)
        some.append([sorted(map(str, f().collect())) for f in build])
    assert some[0] == some[1] and len(some[0][1]) == 121
    table = sorted(map(str, graph.relation_table(rel).collect()))
    assert table == sorted(map(str, graph.relation_table(rel, hub_facts=20).collect()))


def test_facts_are_not_written(spark, monkeypatch):
    """Triples made of a table row by row are made again where they are read, and no step writes a row for each fact."""
    kept = storage.written(spark.createDataFrame([(f"e{i % 9}", f"r{i % 3}", f"e{i % 7}", i) for i in range(400)], "s string, p string, o string, at long"))
    rel = kept.select(F.col("s").alias("subj"), F.col("p").alias("pred"), F.col("o").alias("obj"), F.col("at").alias("pos"))
    assert storage.as_table(rel) is rel and storage.as_table(rel.distinct()) is not rel
    ents, attr, sizes, old = rel.select(F.col("subj").alias("name")).distinct(), _as_literals(rel), [], storage.written
    for module in (graph, texts, storage):
        monkeypatch.setattr(module, "written", lambda df: sizes.append(df.count()) or old(df))
    for df in (texts.relation_text(ents, rel), texts.attribute_relation_text(ents, attr, rel), texts.attribute_relation_text(ents, attr, rel, True), graph.relation_table(rel)):
        df.collect()
    assert len(sizes) > 4 and max(sizes) < 100


def _asked(folder):
    from collections import Counter

    return Counter(line for f in folder.iterdir() for line in f.read_text().splitlines())


def _told(folder):
    """A model that writes down each question, and kills its worker at the question that holds ``stop``, unless told not to."""
    path = str(folder)

    def model(question):
        import os

        last = question.rsplit(" ", 1)[-1]
        if last == "stop" and not os.path.exists(path + "-go"):
            os._exit(1)
        with open(f"{path}/{os.getpid()}", "a") as f:
            f.write(last + "\n")
        if last.startswith("bad"):
            raise RuntimeError("no")
        return f"answer {last}"

    return model


def test_answers_of_whole_chunks_survive_a_crash(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    rows = [(i, f"n{i}", f"t{i}") for i in range(90)] + [(91, "n91", "bad1"), (1, "n1", "t1"), (None, "null", "t0"), (93, "n93", None)]
    # The question that kills its worker is in the third chunk of five.
    key = F.md5(F.concat_ws(":", "id", F.concat(F.lit("Say n"), "id", F.lit(": stop"))))
    stop = spark.range(100, 200).where(F.pmod(F.xxhash64(key), F.lit(5)) == 2).first().id
    rows.append((stop, f"n{stop}", "stop"))
    t = spark.createDataFrame(rows, "id long, name string, content string")
    path, options = str(tmp_path / "store"), {"kind": "simple", "prompts": {"simple": "Say {name}: "}, "tries": 1, "chunk_rows": 20, "workers": 2}
    store = enrich.AnswerStore(spark, path)
    with pytest.raises(Exception):  # noqa: B017
        enrich.enriched(t, _told(folder), path=path, **options)
    kept, before = {r.key: r.answer for r in store.answers().collect()}, _asked(folder)
    chunks = store.manifest().collect()
    assert len(chunks) == 2 and 0 < len(kept) < 92 and len(kept) == sum(r["rows"] for r in chunks)
    # Half-written answers, as a run may leave them, are not read.
    spark.createDataFrame([("k", "half", "ok")], "key string, answer string, status string").write.parquet(f"{path}/answers/chunk=half")
    assert store.answers().count() == len(kept)
    (tmp_path / "asked-go").touch()
    got = enrich.enriched(t, _told(folder), path=path, **options).collect()
    after = _asked(folder)
    assert len(got) == len(rows) and sorted(r.content or "" for r in got) == sorted(r[2] or "" for r in rows)
    assert all((r.status, r.answer) == (("error", None) if r.content == "bad1" else ("ok", f"answer {r.content}" if r.content else "answer")) for r in got)
    # Of the chunk that broke, some questions are asked again; those of committed chunks are not, nor is a row that stands twice.
    again = {q for q in after if after[q] > 1} - {"t0"}
    assert {r.key: r.answer for r in store.answers().collect()}.items() >= kept.items()
    assert sum(after.values()) - sum(before.values()) == 94 - len(kept) and len(again) <= 20 + 1
    total = sum(after.values())
    enrich.enriched(t, _told(folder), path=path, **options)
    assert sum(_asked(folder).values()) == total  # nothing is left to ask
    enrich.enriched(t, _told(folder), path=path, again=True, **options)
    assert sum(_asked(folder).values()) == total + 1  # what failed
    changed = t.where("id = 5").withColumn("content", F.lit("new"))
    assert [r.answer for r in enrich.enriched(changed, _told(folder), path=path, **options).collect()] == ["answer new"]
    assert sum(_asked(folder).values()) == total + 2


def test_a_run_may_stop_after_some_chunks(spark, tmp_path):
    t = spark.range(50).selectExpr("id", "concat('n', id) AS name", "'x' AS content")
    path = str(tmp_path / "store")
    got = enrich.enriched(t, str.upper, path=path, chunk_rows=20, max_chunks=1, tries=1)
    n = got.where("status = 'ok'").count()
    assert 0 < n < 50 and got.count() == 50 and got.where("status is null").count() == 50 - n
    good, bad = enrich.with_fallback(t, str.upper, str.lower, str(tmp_path / "both"), chunk_rows=20, tries=1)
    assert good.count() == 50 and bad.count() == 0
    assert enrich.enriched(t.limit(0), str.upper, path=str(tmp_path / "none")).count() == 0


def test_texts_are_encoded_once_and_by_classes_of_length(spark, tmp_path):
    folder = str(tmp_path)

    def encoder(batch):
        import os
        import uuid

        import numpy as np

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(batch))
        return np.array([[len(t), 1.0] for t in batch])

    t = spark.range(200).select("id", F.expr("trim(repeat('ab ', cast(id % 40 as int)))").alias("content")).repartition(3)
    v = vectors.reduced(vectors.encoded(t, encoder, batch=8), 2)
    assert v.count() == 200 and v.count() == 200
    batches = [f.read_text().split("\n") for f in tmp_path.iterdir()]
    assert sum(map(len, batches)) == 200 and all(len(b) <= 8 and max(map(len, b)) + 1 < 2 * (min(map(len, b)) + 1) for b in batches)


@pytest.mark.parametrize("small", [0, 100_000])
def test_selection_equals_a_sort(spark, small, monkeypatch):
    monkeypatch.setattr(splits, "SMALL", small)
    monkeypatch.setattr(splits, "BUCKETS", 8)
    rng = np.random.default_rng(3)
    number = [float(x) for x in np.round(rng.pareto(0.5, 300), 2)] + [7.0] * 100 + [float("-inf"), float("inf"), 1e308, -1e308, 5e-324, 0.0, -0.0]
    rows = [(i, x) for i, x in enumerate(number)]
    df = spark.createDataFrame(rows, "id long, _x double")
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    for cuts in ([], [0], [1], [50], [150, 151], [200, 250], [406, 407], [407], [3, 100, 300]):
        got = {r.id: r.past for r in splits.cut_rows(df, F.col("_x"), ["_x", "id"], cuts, "past").collect()}
        assert got == {i: sum(c <= at for c in cuts) for at, i in enumerate(order)}
    assert splits.cut_rows(df.limit(0), F.col("_x"), ["_x", "id"], [0], "past").count() == 0


def test_choices_keep_columns_of_any_name(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("name"), *[F.lit(c).alias(c) for c in ("_at", "_h", "_m", "_p", "_n", "_cut", "_x", "_place")])
    got = splits.sampled(df, 0.4, ["name"]).collect()
    assert len(got) == 18 and all(r[c] == c for r in got for c in df.columns[1:])
    missing = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, 0.9)], "id long, difficulty double")
    assert [r.id for r in splits.hard_entities(missing, 0.5).orderBy("id").collect()] == [2, 4]
    assert [r.id for r in splits.hard_entities(missing, 0.5, "easy").orderBy("id").collect()] == [1, 3]


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean", "manhattan"])
def test_pruned_candidates_are_exact_with_few_products(spark, metric):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 16)) * 4
    x = np.concatenate([m + rng.normal(size=(20, 16)) * 0.1 for m in middle] + [middle[:1]] * 9 + [np.zeros((1, 16))])
    y = np.concatenate([m + rng.normal(size=(25, 16)) * 0.1 for m in middle] + [middle[:1]] * 40)
    a, b = storage.written(_vectors(spark, x, 0)), storage.written(_vectors(spark, y, 1000))
    counts = {}
    got = {(r.src, r.place): (r.tgt, round(r.sim, 9)) for r in pruning.pruned_candidates(a, b, 5, metric, 25, counts=counts).collect()}
    want = {(r.src, r.place): (r.tgt, round(r.sim, 9)) for r in matching.top_candidates(a, b, 5, metric).collect()}
    assert got == want and len(got) == 5 * len(x)
    assert counts["multiplied"] < 0.5 * counts["pairs"] and counts["pairs"] >= 100
    for k, csls in ((400, 0), (1, 3)):  # more than there are targets; corrected by the neighbourhood
        got = {(r.src, r.place): r.sim for r in pruning.pruned_candidates(a, b, k, metric, 64, csls).collect()}
        want = {(r.src, r.place): r.sim for r in matching.top_candidates(a, b, k, metric, csls_k=csls).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert pruning.pruned_candidates(a, b.limit(0), 5, metric).count() == pruning.pruned_candidates(a.limit(0), b, 5, metric).count() == 0


def test_a_common_predicate_is_not_brought_to_one_task(spark, monkeypatch):
    rows = [(f"s{i % 40}", "common" if i % 10 else f"rare{i % 3}", f"o{i % 7}", i) for i in range(400)]
    t = storage.written(spark.createDataFrame(rows, "subj string, pred string, obj string, pos long"))
    every = lambda: [sorted(map(tuple, f(t).collect()), key=str) for f in (lambda t: graph.functional(t, 0.05), graph.ordered_facts, graph.first_keys)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for f in (lambda t: graph.functional(t, 0.05), graph.ordered_facts, graph.first_keys):
            assert "hashpartitioning(pred" not in f(t)._jdf.queryExecution().executedPlan().toString()
        few = every()
        monkeypatch.setattr(graph, "MAX_PREDICATES", 0)  # as with more predicates than are broadcast
        assert every() == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_large_chunk_of_questions_is_dealt_by_many_tasks(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(enrich, "PART_ROWS", 20)
    monkeypatch.setattr(enrich, "new_folder", lambda s, n: made.append(storage.new_folder(s, n)) or made[-1])
    docs = spark.createDataFrame([(i, f"n{i}", f"c{i}") for i in range(300)], "id long, name string, content string")
    out = enrich.enriched(docs, lambda q: q[-4:], "short", path=str(tmp_path / "a"), chunk_rows=150)
    assert out.where("status = 'ok'").count() == 300
    sizes = [spark.read.parquet(f"{made[0]}/part={k}").rdd.glom().map(len).sum() for k in (0, 1)]
    files_ = [len(spark.read.parquet(f"{made[0]}/part={k}").inputFiles()) for k in (0, 1)]
    assert sum(sizes) == 300 and min(files_) > 2


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean", "manhattan"])
def test_a_source_keeps_its_best_over_many_blocks(spark, metric):
    """What leaves a task is k rows for each source, not for each pair of blocks; no pair of blocks is shuffled where nothing can be pruned."""
    rng = np.random.default_rng(9)
    x, y = np.round(rng.normal(size=(90, 6)), 1), np.round(rng.normal(size=(210, 6)), 1)  # with ties
    a, b = storage.written(_vectors(spark, x, 0)), storage.written(_vectors(spark, y, 1000))
    few = matching.crossed(matching.packed(a, 16), matching.packed(b, 16)).mapInArrow(matching.best_of_pairs(4, metric, False), "src long, tgt long, sim double")
    assert few.count() == 90 * 4
    sims = np.round(matching.similarity(x, y, metric), matching.PLACES)
    want = {(i, n + 1): 1000 + j for i in range(90) for n, j in enumerate(sorted(range(210), key=lambda j: (-sims[i, j], j))[:4])}
    assert {(r.src, r.place): r.tgt for r in matching.top_candidates(a, b, 4, metric, 16).collect()} == want
    pruned = pruning.pruned_candidates(a, b, 4, metric, 16)
    assert {(r.src, r.place): r.tgt for r in pruned.collect()} == want
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "x_m" not in plan


def test_values_that_are_no_numbers_come_first(spark):
    """As in a sort, in one block or in several."""
    y = np.array([[1.0, 0], [float("nan"), 0], [3, 0], [2, 0], [float("inf"), 0], [4, 0]])
    a, b = storage.written(_vectors(spark, np.array([[1.0, 1]]), 0)), storage.written(_vectors(spark, y, 10))
    for rows in (2, 1024):
        assert [r.tgt for r in matching.top_candidates(a, b, 4, "inner", rows).orderBy("place").collect()] == [11, 14, 15, 12]


def test_main_directions_without_the_whole_sum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5)) * [9, 5, 3, 1, 0.2] @ np.linalg.qr(rng.normal(size=(30, 5)))[0].T
    v = storage.written(_vectors(spark, x, 0))
    one, two = (vectors.main_directions(v, 3, max_gram=m) for m in (64, 8))
    assert np.allclose(one @ one.T, two @ two.T, atol=1e-8)
    old = vectors.FAN_IN
    assert old ** 2 >= 100_000 and vectors.main_directions(v.limit(0), 3).shape == (0, 0)


@pytest.mark.parametrize("indent", [None, 2])
def test_large_json_objects_are_read_by_ranges(spark, tmp_path, indent):
    import json
    import random

    from pyspark.sql import types as T

    from kgalign.sources import files, json_object

    rng = random.Random(5)
    odd = ['a"b', "c\\", '},"x": {', "{[", "é\n\t", "", "\\\\\"}", "日本,", " ,", "]}"]
    lists = {f"{rng.choice(odd)}{i}": {"ref": i, "ground_rank": i % 7, "candidates": [i, i + 1], "cand_sims": [0.5, 0.25], "difficulty": i / 4} for i in range(400)}
    texts_ = {f"{i}{rng.choice(odd)}": rng.choice(odd) * rng.randint(0, 9) for i in range(400)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b"), spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name, objects, kind in (("lists", [lists, {"only": lists[next(iter(lists))]}, {}], files.CANDIDATE), ("texts", [texts_], T.StringType())):
            (tmp_path / name).mkdir()
            for i, x in enumerate(objects):
                (tmp_path / name / f"{i}.json").write_text(json.dumps(x, indent=indent, ensure_ascii=bool(i)) + "\n" * i, encoding="utf-8")
            path = str(tmp_path / name)
            got = sorted(((r.key, r.value) for r in json_object.read_json_object(spark, path, kind).collect()), key=repr)
            want = sorted(((r.key, r.value) for r in files.read_json_map(spark, path, kind).collect()), key=repr)
            assert got == want and len(got) == sum(map(len, objects))
            assert spark.read.option("lineSep", "}" if name == "lists" else ",").text(path).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0]), spark.conf.set("spark.sql.files.openCostInBytes", old[1])
