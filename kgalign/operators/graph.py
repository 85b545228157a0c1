"""Triples ``subj, pred, obj, pos``: ids, functionality, adjacency, blocks, facts in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unquote, words
from ..storage import as_table, free_name, written


#: Facts of a subject that one task ranks; a subject with more is a hub.
HUB_FACTS = 1 << 20
#: Facts of a subject that are packed in one row, for texts and lists of values.
PACKED_FACTS = 1 << 11
#: Predicates, hubs and objects that are broadcast, at most; a few hundred bytes each.
MAX_PREDICATES = 1 << 16
#: Objects for each shuffle partition whose first positions a task holds in a hash table.
HELD_OBJECTS = 1 << 19


def _by_predicate(rows: DataFrame, preds: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with figures of predicates, without bringing all rows of a common predicate to one task."""
    preds = written(preds)
    return rows.join(F.broadcast(preds) if preds.count() <= MAX_PREDICATES else preds, "pred", how)


def _facts_by_key(triples: DataFrame) -> DataFrame:
    """``subj, pred, n``."""
    return written(triples.groupBy("subj", "pred").agg(F.count("*").alias("n")))


def _predicates(each: DataFrame, triples: DataFrame) -> DataFrame:
    """``pred, k, f``: predicates numbered in the order of facts, with their functionality as a negative number; ``each`` as of ``_facts_by_key``."""
    figures = each.groupBy("pred").agg((-F.count("*") / F.sum("n")).alias("f"))
    figures, order = written(figures.join(triples.groupBy("pred").agg(F.min("pos").alias("pred_at")), "pred")), ["f", "pred_at", "pred"]
    if figures.count() > MAX_PREDICATES:
        return dense_ids(figures, order, "k").select("pred", F.col("k").cast("int").alias("k"), "f")
    listed = figures.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("p"))
    return listed.select(F.posexplode("p").alias("k", "x")).select("x.pred", "k", "x.f")


def _hubs(each: DataFrame, most: int, by: str = "subj") -> DataFrame:
    """The names ``subj`` with more than ``most`` facts."""
    return written(each.groupBy(by).agg(F.sum("n").alias("n")).where(F.col("n") > most).select(F.col(by).alias("subj")))


def _parted(rows: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of other subjects, and those of hubs, if there are any."""
    if not (n := hubs.count()):
        return rows, None
    hubs = F.broadcast(hubs) if n <= MAX_PREDICATES else hubs
    return rows.join(hubs, "subj", "left_anti"), rows.join(hubs, "subj", "left_semi")


def _with_objects(rows: DataFrame, objs: DataFrame, by: str = "obj") -> DataFrame:
    """``rows`` joined with a table of figures of objects. Both sides have plain exchanges, so that a hub's many rows can be split; rows are not sorted."""
    n, parts = objs.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(F.broadcast(objs) if n <= MAX_PREDICATES else objs.hint("shuffle_hash") if n <= HELD_OBJECTS * parts else objs, by)


def _in_counts(relations: DataFrame) -> DataFrame:
    """``obj, pred, n, first`` of in-edges: their number and first position."""
    return written(relations.groupBy("obj", "pred").agg(F.count("*").alias("n"), F.min("pos").alias("first")))


def _first_of_objects(counts: DataFrame) -> DataFrame:
    """``obj, obj_at`` from ``_in_counts``."""
    return written(counts.groupBy("obj").agg(F.min("first").alias("obj_at")))


def functionality(triples: DataFrame) -> DataFrame:
    """``pred, functionality``: distinct subjects by triples; two stages, so that a common predicate is no hot group."""
    each = triples.groupBy("pred", "subj").agg(F.count("*").alias("n"))
    return each.groupBy("pred").agg((F.count("*") / F.sum("n")).alias("functionality"))


def functional(triples: DataFrame, least: float = 0.9) -> DataFrame:
    """The triples of predicates with a functionality over ``least``."""
    kept = functionality(triples).where(F.col("functionality") > least).select("pred")
    return _by_predicate(triples, kept, "left_semi")


def dense_ids(rows: DataFrame, order: list, out: str = "id") -> DataFrame:
    """``rows`` with a gapless number from 0 in ``order``: sorted by range, then counts of the ranges before."""
    m, p, n = (free_name(rows, c) for c in ("_m", "_p", "_n"))
    ordered = written(rows.orderBy(*order).withColumn(m, F.monotonically_increasing_id()))
    ranges = ordered.groupBy(F.shiftright(m, 33).alias(p)).agg(F.count("*").alias(n))
    before = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ranges = ranges.select(p, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n))
    numbered = ordered.withColumn(p, F.shiftright(m, 33)).join(ranges, p)
    return numbered.withColumn(out, (F.col(n) + F.col(m).bitwiseAND((1 << 33) - 1)).cast("long")).drop(m, p, n)


def dictionary(names: DataFrame) -> DataFrame:
    """``id, name`` from ``name, pos``: ids by first appearance."""
    first = names.groupBy("name").agg(F.min("pos").alias("pos"))
    return dense_ids(first, ["pos", "name"]).select("id", "name")


def entity_names(attributes: DataFrame, relations: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``name, pos`` of entities in the order of a given list, attribute subjects, then relation subjects and objects."""
    sides = [(given, "name"), (attributes, "subj"), (relations, "subj"), (relations, "obj")]
    stage = {0: 0, 1: 1, 2: 2, 3: 2}
    parts = [
        df.select(F.col(c).alias("name"), F.struct(F.lit(stage[i]).alias("stage"), F.col("pos").cast("long").alias("at"), F.lit(i).alias("side")).alias("pos"))
        for i, (df, c) in enumerate(sides) if df is not None
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjacency(relations: DataFrame) -> DataFrame:
    """Every triple and its reverse, whose predicate ends in ``-inv``."""
    back = relations.select(F.col("obj").alias("subj"), F.concat("pred", F.lit("-inv")).alias("pred"), F.col("subj").alias("obj"), "pos", F.lit("in").alias("direction"))
    return relations.select("subj", "pred", "obj", "pos", F.lit("out").alias("direction")).unionByName(back)


def literal_blocks(attributes: DataFrame) -> DataFrame:
    """``literal, entity``, each pair once: the block of a literal in long form."""
    return attributes.select(F.col("obj").alias("literal"), F.col("subj").alias("entity")).distinct()


def word_blocks(attributes: DataFrame, max_block_size: int | None = None) -> DataFrame:
    """``word, entity``, each pair once; optionally without words that more entities share."""
    pairs = attributes.select(F.explode(F.array_distinct(words(unquote(F.col("obj"))))).alias("word"), F.col("subj").alias("entity")).distinct()
    if max_block_size is None:
        return pairs
    kept = pairs.groupBy("word").count().where(F.col("count") <= max_block_size).select("word")
    return pairs.join(kept, "word", "left_semi")


def blocks(pairs: DataFrame, key: str) -> DataFrame:
    """A block's entities as a sorted array; for keys whose blocks fit a row."""
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def ordered_facts(triples: DataFrame, hub_facts: int = HUB_FACTS) -> DataFrame:
    """``triples`` with ``rank`` within the subject: functionality descending, then predicate and object by first appearance.

    Facts of a subject are ranked in one task, up to ``hub_facts`` of them; those of hubs, with more, are numbered by range.
    """
    triples = as_table(triples)
    each = _facts_by_key(triples)
    objs, preds = written(triples.groupBy("obj").agg(F.min("pos").alias("obj_at"))), _predicates(each, triples)
    order = ["k", "obj_at", "obj", "pos"]
    known = _by_predicate(_with_objects(triples, objs), preds.withColumn("functionality", -F.col("f")).drop("f"))
    near, far = _parted(known, _hubs(each, hub_facts))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("subj").orderBy(*order)))
    if far is not None:
        far = dense_ids(far, ["subj", *order], "_fact")
        far = far.join(written(far.groupBy("subj").agg(F.min("_fact").alias("_start"))), "subj")
        near = near.unionByName(far.withColumn("rank", (F.col("_fact") - F.col("_start") + 1).cast("int")).drop("_fact", "_start"))
    return near.drop("k", "obj_at")


def _first_keys(each: DataFrame, preds: DataFrame, max_keys: int | None, least_functionality: float | None) -> DataFrame:
    key = F.struct("k", "pred", "n")
    if least_functionality is not None:
        key = F.when(F.col("f") < -least_functionality, key)
    packed = _by_predicate(each, preds).groupBy("subj").agg(F.sort_array(F.collect_list(key)).alias("k"), F.sum("n").alias("total"))
    first = F.col("k") if max_keys is None else F.slice("k", 1, max_keys)
    return packed.select("subj", "total", "k", F.posexplode(first).alias("at", "x")).select(
        "subj", "x.pred", (F.col("at") + 1).alias("key_rank"), "x.n", F.expr("aggregate(slice(k, 1, at), 0L, (a, y) -> a + y.n)").alias("before"), "total"
    )


def first_keys(triples: DataFrame, max_keys: int | None = None, least_functionality: float | None = None) -> DataFrame:
    """``subj, pred, key_rank, n, before, total``: a subject's predicates in the order of facts, ``max_keys`` at most; ``n`` facts of ``total``, after ``before`` of others.

    The order of facts is that of their predicates first, so no fact is ranked: counts by subject and predicate, combined before
    they are shuffled, say it all, and a subject has as many rows as predicates.
    """
    triples = as_table(triples)
    each = _facts_by_key(triples)
    return _first_keys(each, _predicates(each, triples), max_keys, least_functionality)


def _keys_of_hubs(
    far: DataFrame, each: DataFrame, preds: DataFrame, max_keys: int | None, max_values: int | None, short: bool = False,
    least_functionality: float | None = None, many: int = 10, longest: int = 20,
) -> DataFrame:
    """``subj, pred, key_rank, vals, n, some`` of hubs' facts ``subj, pred, obj_at, obj`` and perhaps ``some``; of values that are cut each task shuffles the first ones alone."""
    # Tables of their own, so that the joins with a hub's many facts can be split.
    keys = written(_first_keys(each, preds, max_keys, least_functionality))
    with_some = written(far.groupBy("subj", "pred").agg(F.max("some").alias("some"))) if (some := "some" in far.columns) else None
    value = unquote(F.col("obj")) if short else F.col("obj")
    cut = F.length(value) > longest if short else F.lit(False)
    far = far.select("subj", "pred", "obj_at", "obj")
    if max_values is not None:
        # Of long and of short values, as it is not known here which will do.
        first = F.row_number().over(Window.partitionBy("subj", "pred", cut).orderBy("obj_at", "obj"))
        far = far.withColumn("place", first).where(F.col("place") <= max_values)
    entry = F.struct("obj_at", "obj")
    entry = F.when(~(cut & (F.col("total") > many)), entry) if short else entry
    rows = far.join(keys, ["subj", "pred"])
    rows = rows.groupBy("subj", "pred").agg(F.sort_array(F.collect_list(entry)).alias("v"), F.first("key_rank").alias("key_rank"), F.first("n").alias("n"))
    rows = rows.join(with_some, ["subj", "pred"]) if some else rows.withColumn("some", F.lit(False))
    vals = F.transform("v" if max_values is None else F.slice("v", 1, max_values), lambda x: unquote(x["obj"]) if short else x["obj"])
    return rows.select("subj", "pred", "key_rank", vals.alias("vals"), (F.size("v").cast("long") if max_values is None else F.col("n")).alias("n"), "some")


def _keys_and_hubs(
    triples: DataFrame, max_keys: int | None, max_values: int | None, short: bool, least_functionality: float | None, many: int, longest: int,
    objs: DataFrame | None, known: DataFrame | None,
) -> tuple[DataFrame, DataFrame | None]:
    """``subj, keys`` with ``pred, vals, n, some`` of each key, and the keys of hubs, if there are any: ``subj, pred, key_rank, vals, n, some``.

    A fact is shuffled to its object, whose first position it takes along, and back to its subject, as few columns; a subject with
    over ``PACKED_FACTS`` facts is a hub, of whose values each task shuffles the first ones alone.
    """
    triples = as_table(triples)
    each = _facts_by_key(triples)
    preds = _predicates(each, triples)
    if objs is None:
        objs = written(triples.groupBy("obj").agg(F.min("pos").alias("obj_at")))
    if known is not None:
        objs = written(objs.join(known.withColumn("some", F.lit(True)), "obj", "left").fillna(False, "some"))
    facts = _by_predicate(_with_objects(triples.select("subj", "pred", "obj"), objs), preds)
    value = (lambda c: unquote(c)) if short else (lambda c: c)
    long = (lambda c: F.length(value(c)) > longest) if short else (lambda c: F.lit(False))
    some = [] if known is None else ["some"]
    near, far = _parted(facts, hubs := _hubs(each, PACKED_FACTS))

    # Facts of other predicates count, but are no keys.
    k = F.col("k") if least_functionality is None else F.when(F.col("f") < -least_functionality, F.col("k"))
    near = near.select("subj", k.alias("k"), "obj_at", "obj", "pred", *some).repartition("subj")
    near = near.groupBy("subj").agg(F.sort_array(F.collect_list(F.struct("k", "obj_at", "obj", "pred", *some))).alias("v"))
    ks = F.array_compact(F.array_distinct(F.transform("v", lambda x: x["k"])))
    ks = ks if max_keys is None else F.slice(ks, 1, max_keys)
    near = near.select("subj", F.size("v").alias("total"), F.transform(ks, lambda k: F.filter("v", lambda x: x["k"] == k)).alias("g"))
    shown = lambda v: F.filter(v, lambda x: ~(long(x["obj"]) & (F.col("total") > many))) if short else v
    vals = lambda v: F.transform(shown(v) if max_values is None else F.slice(shown(v), 1, max_values), lambda x: value(x["obj"]))
    n = lambda v: F.size(shown(v) if max_values is None else v).cast("long")
    any_some = lambda v: F.exists(v, lambda x: x["some"]) if some else F.lit(False)
    keys = F.transform("g", lambda v: F.struct(v[0]["pred"].alias("pred"), vals(v).alias("vals"), n(v).alias("n"), any_some(v).alias("some")))
    near = near.select("subj", keys.alias("keys")).where(F.size("keys") > 0)
    if far is None:
        return near, None
    return near, _keys_of_hubs(far, _parted(each, hubs)[1], preds, max_keys, max_values, short, least_functionality, many, longest)


def _in_rows(keys: DataFrame) -> DataFrame:
    """``subj, keys``: keys in their order, in one row."""
    packed = keys.groupBy("subj").agg(F.sort_array(F.collect_list(F.struct("key_rank", "pred", "vals", "n", "some"))).alias("v"))
    return packed.select("subj", F.transform("v", lambda x: F.struct(x["pred"].alias("pred"), x["vals"].alias("vals"), x["n"].alias("n"), x["some"].alias("some"))).alias("keys"))


def packed(
    triples: DataFrame, max_keys: int | None = None, max_values: int | None = None, short: bool = False, least_functionality: float | None = None,
    many: int = 10, longest: int = 20, objs: DataFrame | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """``subj, keys``: as ``keyed``, one row for each subject, whose keys must fit it. With ``known(obj)``, ``some`` tells of each key whether any of its objects is there."""
    near, far = _keys_and_hubs(triples, max_keys, max_values, short, least_functionality, many, longest, objs, known)
    return near if far is None else near.unionByName(_in_rows(far))


def keyed(
    triples: DataFrame, max_keys: int | None = None, max_values: int | None = None, short: bool = False, least_functionality: float | None = None,
    many: int = 10, longest: int = 20,
) -> DataFrame:
    """``subj, pred, key_rank, vals, n``: the first keys of each subject with their values, both in the order of facts.

    With ``max_values`` only the first ones of a key are given; ``n`` counts all. With ``short``, values are
    literals, and those over ``longest`` characters are left out where the subject has more than ``many`` facts; their keys stay.
    """
    near, far = _keys_and_hubs(triples, max_keys, max_values, short, least_functionality, many, longest, None, None)
    near = near.select("subj", F.posexplode("keys").alias("at", "x")).select("subj", "x.pred", (F.col("at") + 1).alias("key_rank"), "x.vals", "x.n")
    return near if far is None else near.unionByName(far.drop("some"))


def in_keys(relations: DataFrame, max_keys: int | None = None, max_values: int = 3, counts: DataFrame | None = None) -> DataFrame:
    """``subj, pred, key_rank, vals, n`` of in-edges in file order: each entity's first relations, with the first neighbours of each; ``n`` counts all.

    Of a hub's edges each task shuffles the first ones of a relation alone.
    """
    edges = relations.select(F.col("obj").alias("subj"), "pred", F.col("subj").alias("obj"), "pos")
    counts = (_in_counts(relations) if counts is None else counts).withColumnRenamed("obj", "subj")
    listed = counts.groupBy("subj").agg(F.sort_array(F.collect_list(F.struct("first", "pred", "n"))).alias("k"))
    first = F.col("k") if max_keys is None else F.slice("k", 1, max_keys)
    keys = listed.select("subj", F.posexplode(first).alias("at", "k")).select("subj", "k.pred", (F.col("at") + 1).alias("key_rank"), "k.n")
    place = F.row_number().over(Window.partitionBy("subj", "pred").orderBy("pos", "obj"))
    some = edges.withColumn("place", place).where(F.col("place") <= max_values).join(keys, ["subj", "pred"])
    lists = some.groupBy("subj", "pred").agg(F.sort_array(F.collect_list(F.struct("pos", "obj"))).alias("v"), F.first("key_rank").alias("key_rank"), F.first("n").alias("n"))
    return lists.select("subj", "pred", "key_rank", F.transform("v", lambda x: x["obj"]).alias("vals"), "n")


def neighbourhoods(relations: DataFrame, max_keys: int | None = None, max_values: int | None = None, max_neighbours: int = 3, known: DataFrame | None = None) -> DataFrame:
    """``subj, out, back``: each entity's first keys as of ``keyed`` and as of ``in_keys``, arrays of ``pred, vals, n, some``.

    With ``known(obj)``, ``some`` tells whether any neighbour of the key is there. Facts meet once at their object, whose first position
    they take along to their subject; the object's first neighbours go to its name in the same shuffle. Entities with over
    ``PACKED_FACTS`` facts or in-edges are hubs: of those, each task shuffles the first values of a key alone.
    """
    relations = as_table(relations)
    each, counts = _facts_by_key(relations), _in_counts(relations)
    preds, objs = _predicates(each, relations).drop("f"), counts.groupBy("obj").agg(F.min("first").alias("obj_at"))
    edges = relations.select(F.col("obj").alias("subj"), "pred", F.col("subj").alias("near"), "pos")
    if known is None:
        objs, near_some = objs.withColumn("some", F.lit(False)), F.lit(False)
    else:
        objs, near_some = objs.join(known.withColumn("some", F.lit(True)), "obj", "left").fillna(False, "some"), F.col("near_some")
    objs = written(objs.withColumnRenamed("obj", "subj"))
    own_hubs, in_hubs = _hubs(each, PACKED_FACTS), _hubs(counts, PACKED_FACTS, "obj")
    key = Window.partitionBy("subj", "pred")
    near, far = _parted(edges, in_hubs)
    if known is not None:
        marked = known.select(F.col("obj").alias("near"), F.lit(True).alias("near_some"))
        near = near.join(marked, "near", "left").fillna(False, "near_some")
    near = _with_objects(near, objs, "subj").withColumn("place", F.row_number().over(key.orderBy("pos", "near")))
    near = near.withColumns({"n": F.count("*").over(key), "first": F.min("pos").over(key), "near_some": F.max(near_some).over(key)})
    pos, none = relations.schema["pos"].dataType, F.lit(None)
    names = ("subj", "side", "k", "first", "pred", "at", "value", "n", "some")
    out = F.struct(*[c.alias(n) for c, n in zip((F.col("near"), F.lit(0), F.col("k"), none.cast(pos), F.col("pred"), F.col("obj_at"), F.col("subj"), none.cast("long"), F.col("some")), names)])
    back = F.struct(*[c.alias(n) for c, n in zip((F.col("subj"), F.lit(1), none.cast("int"), F.col("first"), F.col("pred"), F.col("pos"), F.col("near"), F.col("n"), F.col("near_some")), names)])
    rows = _by_predicate(near, preds).select(F.inline(F.array_compact(F.array(out, F.when(F.col("place") <= max_neighbours, back)))))
    if far is not None:
        rows = rows.unionByName(_by_predicate(_with_objects(far, _parted(objs, in_hubs)[1], "subj"), preds).select(out.alias("x")).select("x.*"))
    packs = []
    if (hub_facts := _parted(relations, own_hubs)[1]) is not None:
        listed = own_hubs.withColumn("side", F.lit(0))
        rows = rows.join(F.broadcast(listed) if listed.count() <= MAX_PREDICATES else listed, ["subj", "side"], "left_anti")
        facts = _with_objects(hub_facts.select("subj", "pred", "obj"), objs.withColumnRenamed("subj", "obj"))
        packs.append(("far_out", _in_rows(_keys_of_hubs(facts, _parted(each, own_hubs)[1], preds, max_keys, max_values))))
    if far is not None:
        keys = in_keys(far.select(F.col("near").alias("subj"), "pred", F.col("subj").alias("obj"), "pos"), max_keys, max_neighbours, counts)
        if known is None:
            keys = keys.withColumn("some", F.lit(False))
        else:
            some = written(far.join(marked, "near", "left_semi").groupBy("subj", "pred").agg(F.lit(True).alias("some")))
            keys = keys.join(some, ["subj", "pred"], "left").fillna(False, "some")
        packs.append(("far_back", _in_rows(keys)))
    for name, pack in packs:
        rows = rows.unionByName(pack.withColumnRenamed("keys", name), allowMissingColumns=True)
    wholes = [F.first(name, True).alias(name) for name, _ in packs]
    rows = rows.repartition("subj").groupBy("subj").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("v"), *wholes)

    def keys_of(side: int, by: str, vals, n):
        v = F.filter("v", lambda x: x["side"] == side)
        ks = F.array_distinct(F.transform(v, lambda x: x[by]))
        ks = ks if max_keys is None else F.slice(ks, 1, max_keys)
        each_key = F.transform(ks, lambda k: F.filter("v", lambda x: (x["side"] == side) & (x[by] == k)))
        some = lambda v: F.exists(v, lambda x: x["some"])
        return F.transform(each_key, lambda v: F.struct(v[0]["pred"].alias("pred"), F.transform(vals(v), lambda x: x["value"]).alias("vals"), n(v).alias("n"), some(v).alias("some")))

    out = keys_of(0, "k", lambda v: v if max_values is None else F.slice(v, 1, max_values), lambda v: F.size(v).cast("long"))
    back = keys_of(1, "pred", lambda v: v, lambda v: v[0]["n"])
    had = [name for name, _ in packs]
    return rows.select(
        "subj", F.coalesce("far_out", out).alias("out") if "far_out" in had else out.alias("out"), F.coalesce("far_back", back).alias("back") if "far_back" in had else back.alias("back")
    )


def property_table(attributes: DataFrame, least_functionality: float | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Attributes by entity and property, in order: ``subj, pred, key_rank, vals, n``.

    With ``entities(id, name)`` also ``ent_id``, and a row without a property for each entity that has none.
    """
    table = keyed(attributes, short=True, least_functionality=least_functionality)
    if entities is None:
        return table
    names = entities.select(F.col("id").alias("ent_id"), F.col("name").alias("subj"))
    return names.join(table, "subj", "left").select("ent_id", "subj", "pred", "key_rank", "vals", "n")


def property_header(attributes: DataFrame, least_functionality: float | None = None) -> DataFrame:
    """``id, name`` of the properties, by first appearance; those at or below ``least_functionality`` are left out."""
    names = dictionary(attributes.select(F.col("pred").alias("name"), "pos"))
    if least_functionality is None:
        return names
    kept = functionality(attributes).where(F.col("functionality") > least_functionality).select(F.col("pred").alias("name"))
    return names.join(kept, "name", "left_semi").select("id", "name")


def _table_side(rows: DataFrame, hubs: DataFrame, first: str) -> DataFrame:
    """``subj, pred, key_rank, place, obj, n`` from ``subj, pred, obj, at``: keys by their least ``first``, values by ``at``."""
    near, far = _parted(rows, hubs)
    key, of_subj = Window.partitionBy("subj", "pred"), Window.partitionBy("subj")
    near = near.repartition("subj").withColumn("place", F.row_number().over(key.orderBy("at", "obj")))
    near = near.withColumns({"n": F.count("*").over(key), "_first": F.min(first).over(key)})
    near = near.withColumn("key_rank", F.dense_rank().over(of_subj.orderBy("_first", "pred")))
    names = ["subj", "pred", "key_rank", "place", "obj", "n"]
    if far is None:
        return near.select(*names)
    far = dense_ids(far, ["subj", "pred", "at", "obj"], "_at")
    keys = far.groupBy("subj", "pred").agg(F.count("*").alias("n"), F.min("_at").alias("_start"), F.min(first).alias("_first"))
    keys = written(keys.withColumn("key_rank", F.row_number().over(of_subj.orderBy("_first", "pred"))))
    far = far.join(keys, ["subj", "pred"]).withColumn("place", (F.col("_at") - F.col("_start") + 1).cast("int"))
    return near.select(*names).unionByName(far.select(*names))


def relation_table(relations: DataFrame, hub_facts: int = HUB_FACTS) -> DataFrame:
    """Neighbours by entity and relation: ``subj, pred, direction, key_rank, place, obj, n``, one row for each.

    Out-edges in the order of facts, in-edges (``-inv``) in file order, none left out. Edges of a hub, with over ``hub_facts`` on
    that side, are numbered by range, so that they pass no single task; they stay rows, for a hub's list fits none.
    """
    relations = as_table(relations)
    each, counts = _facts_by_key(relations), _in_counts(relations)
    out = _by_predicate(_with_objects(relations.select("subj", "pred", "obj"), _first_of_objects(counts)), _predicates(each, relations).drop("f"))
    out = _table_side(out.withColumnRenamed("obj_at", "at"), _hubs(each, hub_facts), "k").withColumn("direction", F.lit("out"))
    back = relations.select(F.col("obj").alias("subj"), F.concat("pred", F.lit("-inv")).alias("pred"), F.col("subj").alias("obj"), F.col("pos").alias("at"))
    back = _table_side(back, _hubs(counts, hub_facts, "obj"), "at").withColumn("direction", F.lit("in"))
    names = ["subj", "pred", "direction", "key_rank", "place", "obj", "n"]
    return out.select(*names).unionByName(back.select(*names))
