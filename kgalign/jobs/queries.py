"""One query for each operator, over whole tables, with its SQL; results are long rows or joined strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import enrich, graph, matching, pruning, resolve, splits, texts, tokens, vectors
from ..sources import files, json_object
from ..storage import new_folder, written
from .kg import ATTR, REL, attribute_triples, ordered, relation_triples, table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- sources and strings -------------------------------------------------------------------

_HOST = "http://data.example.org/"


@_query("n_triples", f"""SELECT doc_id AS pos, '{_HOST}doc/'||doc_id AS subj, '{_HOST}source' AS pred, '"'||source||'"' AS obj, 'kept' AS kind FROM documents
UNION ALL SELECT doc_id, '{_HOST}doc/'||doc_id, '{_HOST}lang', '{_HOST}lang/'||lang, 'kept' FROM documents
UNION ALL SELECT doc_id, NULL, NULL, unnest(['<only> two', '<no> <object> .', '<no> <object>  . ']), 'reject' FROM documents""")
def n_triples(spark, d):
    docs, p = table(spark, d, "documents"), F.col("doc_id").cast("string")
    lines = docs.select(F.col("doc_id").alias("pos"), F.explode(F.array(
        F.concat(F.lit(f"<{_HOST}doc/"), p, F.lit(f'> <{_HOST}source> "'), "source", F.lit('"@en .')),
        F.concat(F.lit(f"<{_HOST}doc/"), p, F.lit(f"> <{_HOST}lang> <{_HOST}lang/"), "lang", F.lit("> . ")),
        F.concat(F.lit("# comment "), p), F.lit("<only> two"), F.lit("<no> <object> ."), F.lit("<no> <object>  . "),
    )).alias("value"))
    good, bad = files.parse_n_triples(lines)
    good = files.compressed(good, ())
    nothing = F.lit(None).cast("string")
    return good.select("pos", "subj", "pred", "obj", F.lit("kept").alias("kind")).unionByName(
        bad.select("pos", nothing.alias("subj"), nothing.alias("pred"), F.col("value").alias("obj"), F.lit("reject").alias("kind"))
    )


@_query("relation_lines", f"""WITH {REL} SELECT subj, pred, replace(obj, '_', ' ') AS obj, pos, 'kept' AS kind FROM rel
UNION ALL SELECT subj||chr(9)||pred||chr(9)||' ', NULL, NULL, pos, 'reject' FROM rel WHERE pred = 'in_nation'""")
def relation_lines(spark, d):
    rel = relation_triples(spark, d)
    line = F.concat(F.lit(f"\t<{_HOST}"), "subj", F.lit(">\t"), "pred", F.lit(f"\t{_HOST}"), "obj", F.lit(" \t\r"))
    # A line that ends in white space has no empty object: it is too short.
    short = rel.where("pred = 'in_nation'").select(F.concat("subj", F.lit("\t"), "pred", F.lit("\t ")).alias("value"), "pos")
    good, bad = files.parse_relation_lines(rel.select(line.alias("value"), "pos").unionByName(short), (_HOST,))
    nothing = F.lit(None).cast("string")
    return good.withColumn("kind", F.lit("kept")).unionByName(
        bad.select(F.col("value").alias("subj"), nothing.alias("pred"), nothing.alias("obj"), "pos", F.lit("reject").alias("kind"))
    )


@_query("attribute_lines", f"WITH {ATTR} SELECT subj, pred, obj, pos FROM attr")
def attribute_lines(spark, d):
    line = F.concat(F.lit(f"<{_HOST}"), "subj", F.lit(">\t"), "pred", F.lit("\t"), X.unquote(F.col("obj")), F.lit("\textra"))
    return files.parse_attribute_lines(attribute_triples(spark, d).select(line.alias("value"), "pos"), (_HOST,))[0]


@_query("link_and_name_lines", "SELECT c_custkey AS id, c_name AS name, 'customer/'||c_custkey AS src, 'CUSTOMER/'||c_custkey AS tgt FROM customer")
def link_and_name_lines(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    links = files.parse_link_lines(c.select(F.concat(F.lit(f"{_HOST}customer/"), key, F.lit("\tCUSTOMER/"), key).alias("value"), F.col("c_custkey").alias("pos")), (_HOST,))[0]
    names = files.parse_name_lines(c.select(F.concat(key, F.lit("\tx\t"), "c_name").alias("value"), F.col("c_custkey").alias("pos")), (_HOST,))[0]
    return names.join(links, "pos").select("id", "name", "src", "tgt")


@_query("compressed_urls", """SELECT page_id, CASE WHEN NOT starts_with(url, 'http://') THEN url
WHEN starts_with(url, 'http://example.com/') THEN translate(replace(url, 'http://example.com/', ''), '_' || chr(9) || '%' || chr(160), '  ')
ELSE url END AS name, CASE WHEN starts_with(url, 'http') THEN translate(replace(replace(url, 'https://', ''), 'http://', ''), '_' || chr(9) || '%' || chr(160), '  ') ELSE url END AS bare FROM pages""")
def compressed_urls(spark, d):
    pages = table(spark, d, "pages")
    quoted = F.concat(F.lit("<"), F.col("url"), F.lit(">"))
    plain = F.concat(F.lit("http://"), F.regexp_replace("url", r"\Ahttps?://", ""))
    bare = F.when(F.col("url").startswith("http"), X.compress_uri(plain, ("http://",))).otherwise(F.col("url"))
    return pages.select("page_id", X.compress_uri(quoted, ("http://example.com/",)).alias("name"), bare.alias("bare"))


_WORDS = r"""list_filter(string_split(translate(lower(coalesce(text, '')), '!"''#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda x: x <> '')"""


@_query("document_words", rf"SELECT doc_id, len({_WORDS}) AS n_words, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS n_runs, coalesce(list_sort({_WORDS})[1], '') AS first_word FROM documents")
def document_words(spark, d):
    w = table(spark, d, "documents").withColumn("w", X.words(F.col("text")))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), X.count_words(F.col("text")).cast("long").alias("n_runs"), F.coalesce(F.array_min("w"), F.lit("")).alias("first_word"))


_MD5 = "md5(CAST(o_orderkey AS VARCHAR))"
_AS_UUID = f"substr({_MD5},1,8)||'-'||substr({_MD5},9,4)||'-'||substr({_MD5},13,4)||'-'||substr({_MD5},17,4)||'-'||substr({_MD5},21,12)"


@_query("short_names", f"SELECT 'event/'||{_AS_UUID}||'/x' AS name, 'event/E'||o_orderkey||'/x' AS short_name FROM orders")
def short_names(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string"))
    cut = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("event/"), cut, F.lit("/x")).alias("name"))
    return rows.select("name", X.shorten_uuids(F.col("name"), F.col("o_orderkey")).alias("short_name"))


@_query("rebased_ids", "SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS id, 'order/'||o_orderkey AS name FROM orders")
def rebased_ids(spark, d):
    return resolve.rebased(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("name")))


@_query("one_line_texts", r"""SELECT doc_id, replace(text, chr(10), '\n') AS flat, replace(replace(replace(text, chr(10), '\n'), '\n', chr(10)), '\t', chr(9)) AS back,
replace(trim(replace(replace(text, chr(13), ''), chr(10), ''), ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), chr(9), ' ') AS answer, rtrim(lang) AS padded, string_split(text, chr(9))[-1] AS last_part FROM documents""")
def one_line_texts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.one_line(t).alias("flat"), X.from_one_line(X.one_line(t)).alias("back"), X.clean_answer(t).alias("answer"), X.clean_answer(F.concat(F.lit("\t \r\n"), "lang", F.lit(" \t\n"))).alias("padded"), X.last_field(t).alias("last_part"))


def _prompt_sql(kind: str, name: str, text: str) -> str:
    head, *tail = (s.replace("'", "''").replace("\n", "'||chr(10)||'") for s in X.PROMPTS[kind].split("{name}"))
    details = "" if kind == "name" else rf"||replace(replace(coalesce({text}, ''), '\n', chr(10)), '\t', chr(9))"
    return f"'{head}'" + "".join(f"||{name}||'{t}'" for t in tail) + details


@_query("prompts", "SELECT conv_id, turn, " + ", ".join(f"{_prompt_sql(k, 'role', 'text')} AS {k}_prompt" for k in X.PROMPTS) + " FROM conversations")
def prompts(spark, d):
    rows = table(spark, d, "conversations")
    made = [F.element_at(X.chat_messages("", X.prompt(F.col("role"), F.col("text"), k)), 2)["content"].alias(f"{k}_prompt") for k in X.PROMPTS]
    return rows.select("conv_id", "turn", *made)


# --- graph -----------------------------------------------------------------------------------


@_query("functionality", f"WITH {REL} SELECT pred, count(DISTINCT subj) / count(*) AS functionality FROM rel GROUP BY pred")
def functionality(spark, d):
    return graph.functionality(relation_triples(spark, d))


@_query("functional_triples", f"WITH {REL} SELECT subj, pred, obj FROM rel WHERE pred IN (SELECT pred FROM rel GROUP BY pred HAVING count(DISTINCT subj) / count(*) > 0.9)")
def functional_triples(spark, d):
    return graph.functional(relation_triples(spark, d)).select("subj", "pred", "obj")


@_query("dictionary", f"""WITH {REL}, {ATTR}, n AS (SELECT subj AS name, 1 AS stage, pos, 1 AS side FROM attr UNION ALL SELECT subj, 2, pos, 2 FROM rel UNION ALL SELECT obj, 2, pos, 3 FROM rel),
f AS (SELECT name, min(row(stage, pos, side)) AS num FROM n GROUP BY name) SELECT row_number() OVER (ORDER BY num, name) - 1 AS id, name FROM f""")
def dictionary(spark, d):
    return graph.dictionary(graph.entity_names(attribute_triples(spark, d), relation_triples(spark, d)))


@_query("dictionary_of_given_entities", f"""WITH {REL}, {ATTR}, n AS (SELECT 'nation/'||n_nationkey AS name, 0 AS stage, CAST(n_nationkey AS BIGINT) AS pos, 0 AS side FROM nation
UNION ALL SELECT subj, 1, pos, 1 FROM attr UNION ALL SELECT subj, 2, pos, 2 FROM rel UNION ALL SELECT obj, 2, pos, 3 FROM rel),
f AS (SELECT name, min(row(stage, pos, side)) AS num FROM n GROUP BY name) SELECT row_number() OVER (ORDER BY num, name) - 1 AS id, name FROM f""")
def dictionary_of_given_entities(spark, d):
    """Entities of a given list come first."""
    given = table(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("pos"))
    return graph.dictionary(graph.entity_names(attribute_triples(spark, d), relation_triples(spark, d), given))


@_query("adjacency", f"""WITH {REL}, a AS (SELECT subj, pred, obj, pos, 'out' AS direction FROM rel UNION ALL SELECT obj, pred||'-inv', subj, pos, 'in' FROM rel)
SELECT subj, pred, direction, count(*) AS n, min(obj) AS first_obj FROM a GROUP BY ALL""")
def adjacency(spark, d):
    return graph.adjacency(relation_triples(spark, d)).groupBy("subj", "pred", "direction").agg(F.count("*").alias("n"), F.min("obj").alias("first_obj"))


@_query("literal_blocks", f"WITH {ATTR} SELECT DISTINCT obj AS literal, subj AS entity FROM attr")
def literal_blocks(spark, d):
    return graph.literal_blocks(attribute_triples(spark, d))


@_query("word_blocks", f"WITH {ATTR}, w AS (SELECT DISTINCT unnest({_WORDS}) AS word, subj FROM (SELECT subj, obj[2:-2] AS text FROM attr)) SELECT word, count(*) AS entities, min(subj) AS first_entity FROM w GROUP BY word")
def word_blocks(spark, d):
    return graph.word_blocks(attribute_triples(spark, d)).groupBy("word").agg(F.count("*").alias("entities"), F.min("entity").alias("first_entity"))


@_query("small_word_blocks", f"WITH {ATTR}, w AS (SELECT DISTINCT unnest({_WORDS}) AS word, subj FROM (SELECT subj, obj[2:-2] AS text FROM attr)) SELECT word, string_agg(subj, ' ' ORDER BY subj) AS entities FROM w GROUP BY word HAVING count(*) <= 40")
def small_word_blocks(spark, d):
    """Blocks of the words that at most 40 entities share, each a sorted list."""
    pairs = graph.word_blocks(attribute_triples(spark, d), 40)
    return graph.blocks(pairs, "word").select("word", F.array_join("entities", " ").alias("entities"))


@_query("fact_order", f"WITH {REL}, {ordered('rel', 'facts')} SELECT subj, pred, obj, pos, rank FROM facts")
def fact_order(spark, d):
    return graph.ordered_facts(relation_triples(spark, d)).select("subj", "pred", "obj", "pos", F.col("rank").cast("long").alias("rank"))


_SHORT = "(SELECT subj, pred, pos, rank, CASE WHEN count(*) OVER (PARTITION BY subj) > 10 AND length(obj[2:-2]) > 20 THEN NULL ELSE obj[2:-2] END AS obj FROM facts)"


_IDS = """n AS (SELECT subj AS name, 1 AS stage, pos, 1 AS side FROM attr UNION ALL SELECT subj, 2, pos, 2 FROM rel UNION ALL SELECT obj, 2, pos, 3 FROM rel),
ids AS (SELECT row_number() OVER (ORDER BY num, name) - 1 AS ent_id, name AS subj FROM (SELECT name, min(row(stage, pos, side)) AS num FROM n GROUP BY name))"""


@_query("property_table", f"""WITH {REL}, {ATTR}, {_IDS}, {ordered('attr', 'facts')}, s AS {_SHORT}, k AS (SELECT subj, pred, min(rank) AS r, count(obj) AS n, coalesce(string_agg(obj, ', ' ORDER BY rank), '') AS vals FROM s GROUP BY ALL),
t AS (SELECT subj, pred, row_number() OVER (PARTITION BY subj ORDER BY r) AS key_rank, vals, n FROM k)
SELECT ent_id, subj, pred, key_rank, vals, n FROM ids LEFT JOIN t USING (subj)""")
def property_table(spark, d):
    """Every entity, also those without an attribute."""
    rel, attr = relation_triples(spark, d), attribute_triples(spark, d)
    t = graph.property_table(attr, entities=graph.dictionary(graph.entity_names(attr, rel)))
    return t.select("ent_id", "subj", "pred", F.col("key_rank").cast("long").alias("key_rank"), F.array_join("vals", ", ").alias("vals"), "n")


@_query("property_header", f"""WITH {ATTR}, p AS (SELECT pred AS name, min(pos) AS pos, count(DISTINCT subj) / count(*) AS f FROM attr GROUP BY pred), r AS (SELECT name, row_number() OVER (ORDER BY pos, name) - 1 AS id, f FROM p)
SELECT id, name, 'all' AS kind FROM r UNION ALL SELECT id, name, 'functional' FROM r WHERE f > 0.9""")
def property_header(spark, d):
    attr = written(attribute_triples(spark, d))
    return graph.property_header(attr).withColumn("kind", F.lit("all")).unionByName(graph.property_header(attr, 0.9).withColumn("kind", F.lit("functional")))


@_query("relation_table", f"""WITH {REL}, {ordered('rel', 'facts')}, o AS (SELECT subj, pred, obj, rank, min(rank) OVER (PARTITION BY subj, pred) AS r FROM facts),
i AS (SELECT obj AS subj, pred||'-inv' AS pred, subj AS obj, pos, min(pos) OVER (PARTITION BY obj, pred) AS r FROM rel)
SELECT subj, pred, 'out' AS direction, dense_rank() OVER (PARTITION BY subj ORDER BY r) AS key_rank, row_number() OVER (PARTITION BY subj, pred ORDER BY rank) AS place, obj, count(*) OVER (PARTITION BY subj, pred) AS n FROM o
UNION ALL SELECT subj, pred, 'in', dense_rank() OVER (PARTITION BY subj ORDER BY r, pred), row_number() OVER (PARTITION BY subj, pred ORDER BY pos, obj), obj, count(*) OVER (PARTITION BY subj, pred) FROM i""")
def relation_table(spark, d):
    t = graph.relation_table(relation_triples(spark, d))
    return t.withColumns({"key_rank": F.col("key_rank").cast("long"), "place": F.col("place").cast("long")})


# --- tokens ------------------------------------------------------------------------------------


@_query("token_frequencies", f"SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS}) AS token FROM documents) GROUP BY token")
def token_frequencies(spark, d):
    return tokens.token_frequencies(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@_query("token_ids", f"""WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents), e AS (SELECT id, unnest(ws) AS token, unnest(range(len(ws))) AS num FROM w),
f AS (SELECT token, min(row(e.id, num)) AS first0 FROM e GROUP BY token), v AS (SELECT token, row_number() OVER (ORDER BY first0, token) - 1 AS tid FROM f)
SELECT w.id, coalesce(string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY num), '') AS token_ids FROM w LEFT JOIN e ON w.id = e.id LEFT JOIN v USING (token) GROUP BY w.id""")
def token_ids(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    bundles = tokens.bundled(rows)
    ids = tokens.ids_of_bundles(bundles, graph.dictionary(tokens.names_of(bundles)))
    return ids.select("id", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ").alias("token_ids"))


# --- resolving -----------------------------------------------------------------------------------


@_query("resolved_triples", "SELECT o_clerk_name AS subj, 'placed by' AS pred, c_name AS obj FROM (SELECT 'order/'||o_orderkey AS o_clerk_name, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey")
def resolved_triples(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    shift = 10**12
    ents = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("name")).unionByName(
        c.select((F.col("c_custkey") + shift).alias("id"), F.col("c_name").alias("name")))
    rels = spark.createDataFrame([(0, "placed by")], "id long, name string")
    ids = o.select(F.col("o_orderkey").alias("h"), F.lit(0).cast("long").alias("r"), (F.col("o_custkey") + shift).alias("t"))
    return resolve.resolve_triples(ids, ents, rels)[0]


@_query("unresolved_triples", "SELECT o_orderkey AS h, CAST(0 AS BIGINT) AS r, o_custkey AS t FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def unresolved_triples(spark, d):
    """The triples of which an id is not in the dictionary: here those of one segment's customers."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    shift = 10**12
    ents = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("name")).unionByName(
        c.select((F.col("c_custkey") + shift).alias("id"), F.col("c_name").alias("name")))
    rels = spark.createDataFrame([(0, "placed by")], "id long, name string")
    ids = o.select(F.col("o_orderkey").alias("h"), F.lit(0).cast("long").alias("r"), (F.col("o_custkey") + shift).alias("t"))
    return resolve.resolve_triples(ids, ents, rels)[1].withColumn("t", F.col("t") - shift)


def _sides(spark, d):
    c = table(spark, d, "customer")
    left = c.select((F.col("c_custkey") - 1).alias("id"), F.col("c_name").alias("name"))
    return left, left.withColumn("name", F.upper("name"))


@_query("link_names_and_ids", "SELECT c_name AS src, upper(c_name) AS tgt, c_custkey - 1 AS id1, c_custkey - 1 + (SELECT count(*) FROM customer) AS id2 FROM customer")
def link_names_and_ids(spark, d):
    left, right = _sides(spark, d)
    links = resolve.resolve_links(left.select(F.col("id").alias("id1"), F.col("id").alias("id2")), left, right)
    return links.join(resolve.link_ids(links.withColumns({"a": F.col("src"), "b": F.col("tgt")}), left, right).withColumnsRenamed({"a": "src", "b": "tgt"}), ["src", "tgt"])


@_query("renamed_triples", f"WITH {REL} SELECT coalesce('E'||CAST(c_custkey AS VARCHAR), subj) AS subj, pred, obj, pos FROM rel LEFT JOIN customer ON subj = 'customer/'||c_custkey AND c_mktsegment = 'BUILDING'")
def renamed_triples(spark, d):
    key = F.col("c_custkey").cast("string")
    names = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), key).alias("name"), F.concat(F.lit("E"), key).alias("new_name"))
    return resolve.renamed(relation_triples(spark, d), names, "subj").select("subj", "pred", "obj", "pos")


@_query("restricted_triples", f"""WITH {REL}, {ATTR}, s AS (SELECT 'customer/'||c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'nation/'||n_nationkey FROM nation)
SELECT subj, pred, obj FROM rel WHERE subj IN (SELECT name FROM s) AND obj IN (SELECT name FROM s) UNION ALL SELECT subj, pred, obj FROM attr WHERE subj IN (SELECT name FROM s)""")
def restricted_triples(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("name"))
    s = c.unionByName(table(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("name")))
    three = ["subj", "pred", "obj"]
    return resolve.relations_of(relation_triples(spark, d), s).select(*three).unionByName(resolve.attributes_of(attribute_triples(spark, d), s).select(*three))


_LINKS = "links AS (SELECT 'order/'||l_orderkey AS src, 'part/'||l_partkey AS tgt, l_orderkey*10+l_linenumber AS pos FROM lineitem)"


def _links(spark, d):
    n = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    return table(spark, d, "lineitem").select(n("order", "l_orderkey").alias("src"), n("part", "l_partkey").alias("tgt"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"))


@_query("cleaned_links", f"""WITH {_LINKS}, h AS (SELECT src AS head, max(pos) AS top FROM links GROUP BY src), bad AS (SELECT src, tgt FROM links JOIN h ON src = head WHERE pos < top UNION SELECT src, tgt FROM links JOIN h ON tgt = head WHERE pos < top)
SELECT src, tgt, pos FROM links ANTI JOIN bad USING (src, tgt)""")
def cleaned_links(spark, d):
    return resolve.cleaned_links(_links(spark, d)).select("src", "tgt", "pos")


@_query("one_to_one_links", f"WITH {_LINKS}, a AS (SELECT src, tgt, pos FROM links QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos, tgt) = 1) SELECT tgt, src, pos FROM a QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY pos, src) = 1")
def one_to_one_links(spark, d):
    return resolve.cleaned_links(_links(spark, d), "one_to_one")


# --- splits and choices ----------------------------------------------------------------------------

_N = "(SELECT count(*) FROM customer)"


@_query("masked_names", f"""WITH r AS (SELECT c_name AS name, row_number() OVER (ORDER BY md5('0:'||c_name), c_name) - 1 AS num FROM (SELECT DISTINCT c_name FROM customer)), n AS (SELECT count(*) AS n FROM r)
SELECT name, 'E'||lpad(CAST(num AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0') AS new_name FROM r, n WHERE num < CAST(floor(n * 0.4) AS BIGINT)""")
def masked_names(spark, d):
    return splits.masked_names(table(spark, d, "customer").select(F.col("c_name").alias("name")), 0.4)


@_query("sampled_attributes", f"WITH {ATTR}, r AS (SELECT *, row_number() OVER (ORDER BY md5('7:'||subj||':'||pred||':'||obj), subj, pred, obj) - 1 AS num FROM attr) SELECT subj, pred, obj FROM r WHERE num >= CAST(floor((SELECT count(*) FROM attr) * 0.3) AS BIGINT)")
def sampled_attributes(spark, d):
    return splits.sampled(attribute_triples(spark, d), 0.3, ["subj", "pred", "obj"], 7).select("subj", "pred", "obj")


@_query("link_split", f"""WITH r AS (SELECT c_name AS src, upper(c_name) AS tgt, row_number() OVER (ORDER BY md5('0:'||c_name||':'||upper(c_name)), c_name) - 1 AS num FROM customer), n AS (SELECT CAST(floor({_N} * 0.2) AS BIGINT) AS a, CAST(floor({_N} * 0.1) AS BIGINT) AS b)
SELECT src, tgt, CASE WHEN num < a THEN 'train' WHEN num < a + b THEN 'valid' ELSE 'test' END AS part FROM r, n""")
def link_split(spark, d):
    return splits.split_links(table(spark, d, "customer").select(F.col("c_name").alias("src"), F.upper("c_name").alias("tgt")))


@_query("given_split", """SELECT c_name AS src, upper(c_name) AS tgt, 'train' AS part FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_name, upper(c_name), 'test' FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def given_split(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("src"), F.upper("c_name").alias("tgt"), "c_mktsegment")
    return splits.given_split(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment <> 'BUILDING'"))


# --- texts -------------------------------------------------------------------------------------------

_ENTITIES = "ents AS (SELECT DISTINCT name FROM (SELECT subj AS name FROM rel UNION ALL SELECT obj FROM rel UNION ALL SELECT subj FROM attr))"


def _entities(rel, attr):
    return rel.select(F.explode(F.array("subj", "obj")).alias("name")).union(attr.select("subj")).distinct()


@_query("attribute_text", rf"""WITH {REL}, {ATTR}, {_ENTITIES}, {ordered('attr', 'facts')}, s AS {_SHORT},
k AS (SELECT subj, pred, min(rank) AS r, count(obj) AS n, coalesce(string_agg(obj, ', ' ORDER BY rank), '') AS vals FROM s GROUP BY subj, pred QUALIFY row_number() OVER (PARTITION BY subj ORDER BY min(rank)) <= 8),
h AS (SELECT *, n > 3 AND length(vals) > 11 AND regexp_matches(vals, '(\d.*?){{11,}}') AS hide FROM k),
p AS (SELECT subj, coalesce(string_agg(pred||': '||vals, ', ' ORDER BY r) FILTER (NOT hide), '') AS shown, coalesce(string_agg(pred, ', ' ORDER BY r) FILTER (hide), '') AS names FROM h GROUP BY subj)
SELECT name, CASE WHEN shown IS NULL THEN name||'. ' WHEN shown <> '' AND names <> '' THEN '"'||name||'" has the following attributes: '||shown||'. Besides, "'||name||'" has other attributes such as '||names||'. '
WHEN shown <> '' THEN '"'||name||'" has the following attributes: '||shown||'. ' ELSE '"'||name||'" has the following attributes: '||names||'. ' END AS content FROM ents LEFT JOIN p ON name = subj""")
def attribute_text(spark, d):
    attr = attribute_triples(spark, d)
    return texts.attribute_text(_entities(relation_triples(spark, d), attr), attr)


_RELATION_TEXT = rf"""{ordered('rel', 'facts')},
ok AS (SELECT subj, pred, min(rank) AS r, string_agg(obj, ' and ' ORDER BY rank) AS vals FROM facts GROUP BY subj, pred QUALIFY row_number() OVER (PARTITION BY subj ORDER BY min(rank)) <= 8),
o AS (SELECT subj, '"'||subj||'" has some relations with other terms/entities: its '||string_agg(pred||' is '||vals, ', ' ORDER BY r)||'. ' AS t FROM ok GROUP BY subj),
ie AS (SELECT obj AS subj, pred, subj AS obj, pos, row_number() OVER (PARTITION BY obj, pred ORDER BY pos, subj) AS num, count(*) OVER (PARTITION BY obj, pred) AS n FROM rel),
ik AS (SELECT subj, pred, min(pos) AS first, max(n) AS n, string_agg(obj, ' and ' ORDER BY pos, obj) AS vals FROM ie WHERE num <= 3 GROUP BY subj, pred QUALIFY row_number() OVER (PARTITION BY subj ORDER BY min(pos), pred) <= 8),
i AS (SELECT subj, string_agg(vals||'''s '||pred||CASE WHEN n > 1 THEN ' are "' ELSE ' is "' END||subj||'"', ', ' ORDER BY first, pred)||'. ' AS t FROM ik GROUP BY subj),
rt AS (SELECT name, CASE WHEN o.t IS NULL AND i.t IS NULL THEN name||'.' WHEN o.t IS NULL THEN '"'||name||'" has some relations with other terms/entities: '||i.t
WHEN len(regexp_extract_all(o.t, '[\p{{L}}\p{{N}}_]+')) < 50 THEN o.t||coalesce(i.t, '') ELSE o.t END AS content FROM ents LEFT JOIN o ON name = o.subj LEFT JOIN i ON name = i.subj)"""


@_query("relation_text", f"WITH {REL}, {ATTR}, {_ENTITIES}, {_RELATION_TEXT} SELECT name, content FROM rt")
def relation_text(spark, d):
    rel = relation_triples(spark, d)
    return texts.relation_text(_entities(rel, attribute_triples(spark, d)), rel)


def _dict_sql(keys: int) -> str:
    q = lambda c: f"CASE WHEN contains({c}, '''') AND NOT contains({c}, '\"') THEN '\"'||{c}||'\"' ELSE ''''||replace({c}, '''', '\\''')||'''' END"
    return f"""(SELECT subj, '{{'||string_agg({q('pred')}||': '||{q('vals')}, ', ' ORDER BY r)||'}}' AS dict, count(*) AS n FROM
(SELECT subj, pred, min(rank) AS r, coalesce(string_agg(obj, ', ' ORDER BY rank) FILTER (num <= 2), '') AS vals FROM
(SELECT *, row_number() OVER (PARTITION BY subj, pred ORDER BY obj IS NULL, rank) AS num FROM sh) GROUP BY subj, pred QUALIFY row_number() OVER (PARTITION BY subj ORDER BY min(rank)) <= {keys}) GROUP BY subj)"""


def _attribute_relation_sql(prefer: bool) -> str:
    first = "has NULLS LAST, side, r, pred" if prefer else "side, r, pred"
    return f"""WITH {REL}, {ATTR}, {_ENTITIES}, {ordered('attr', 'facts')}, sh AS {_SHORT}, own AS {_dict_sql(10)}, near AS {_dict_sql(3)}, {ordered('rel', 'rf')},
ok AS (SELECT subj, pred, obj, 0 AS side, min(rank) OVER (PARTITION BY subj, pred) AS r, row_number() OVER (PARTITION BY subj, pred ORDER BY rank) AS num FROM rf),
ik AS (SELECT obj AS subj, pred, subj AS obj, 1 AS side, min(pos) OVER (PARTITION BY obj, pred) AS r, row_number() OVER (PARTITION BY obj, pred ORDER BY pos, subj) AS num FROM rel),
ak AS (SELECT *, max(CASE WHEN obj IN (SELECT subj FROM attr) THEN 1 END) OVER (PARTITION BY subj, side, pred) AS has FROM (SELECT * FROM ok UNION ALL SELECT * FROM ik)),
e AS (SELECT *, dense_rank() OVER (PARTITION BY subj ORDER BY {first}) AS key_rank FROM ak WHERE num <= 2),
c AS (SELECT e.* FROM e LEFT JOIN own USING (subj) WHERE key_rank <= CASE WHEN n > 5 THEN 3 ELSE 4 END),
l AS (SELECT c.subj, key_rank, CASE WHEN side = 0 THEN '-> '||pred||' -> ' ELSE '<- '||pred||' <- ' END||string_agg(obj||coalesce(' ('||dict||')', ''), ', ' ORDER BY num)||chr(10) AS line FROM c LEFT JOIN near ON obj = near.subj GROUP BY c.subj, key_rank, side, pred),
t AS (SELECT subj, string_agg(line, '' ORDER BY key_rank) AS body FROM l GROUP BY subj)
SELECT name, CASE WHEN body IS NULL THEN name||'.' ELSE replace('Entity ['||name||']'||coalesce(' has attributes: ('||dict||')'||chr(10), chr(10))||'Relations: '||chr(10)||body, chr(10), '\\n') END AS content
FROM ents LEFT JOIN t ON name = t.subj LEFT JOIN own ON name = own.subj"""


@_query("attribute_relation_text", _attribute_relation_sql(False))
def attribute_relation_text(spark, d, prefer_attributed=False):
    rel, attr = relation_triples(spark, d), attribute_triples(spark, d)
    return texts.attribute_relation_text(_entities(rel, attr), attr, rel, prefer_attributed)


@_query("attributed_relation_text", _attribute_relation_sql(True))
def attributed_relation_text(spark, d):
    return attribute_relation_text(spark, d, True)


@_query("resumed_texts", "SELECT d.doc_id AS id, d.n_chars FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return enrich.still_to_do(docs, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


_TEXTS = "texts AS (SELECT doc_id AS id, source AS name, text AS content, doc_id AS pos FROM documents)"


@_query("anchor_texts", f"WITH {_TEXTS}, a AS (SELECT source AS name, min(doc_id) AS pos FROM documents GROUP BY source) SELECT a.pos, name, max_by(id, t.pos) AS id, max_by(content, t.pos) AS content FROM a JOIN texts t USING (name) GROUP BY ALL")
def anchor_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("content"), F.col("doc_id").alias("pos"))
    return texts.anchor_texts(docs.groupBy("name").agg(F.min("pos").alias("pos")), docs)


@_query("combined_texts", """SELECT doc_id AS id, source AS name, CASE WHEN lang = 'en' THEN text ELSE source||' is a source. '||text END AS content FROM documents""")
def combined_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "lang", F.col("text").alias("content"))
    a = docs.withColumn("content", F.when(F.col("lang") == "en", F.concat("name", F.lit(". "))).otherwise(F.concat("name", F.lit(" is a source. "))))
    return texts.combined_texts(a, docs)


@_query("mixed_texts", """SELECT doc_id AS id, 'doc/'||doc_id AS name, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN rtrim(text, ' ')||' '||upper(lang) ELSE text END AS content FROM documents""")
def mixed_texts(spark, d):
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), name, F.col("text").alias("content"), "lang")
    hard = table(spark, d, "labels").where("quality = 0").select(name)
    return texts.mixed_texts(docs.drop("lang"), hard, docs.select("name", F.upper("lang").alias("content")))


@_query("shortest_texts", """WITH l AS (SELECT 'doc/'||doc_id AS name, text FROM documents JOIN labels USING (doc_id)) SELECT name FROM l QUALIFY row_number() OVER (ORDER BY length(text), name) <= floor((SELECT count(*) FROM labels) * 0.2)""")
def shortest_texts(spark, d):
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name")
    return splits.shortest_texts(table(spark, d, "labels").select(name), table(spark, d, "documents").select(name, F.col("text").alias("content")))


# --- vectors and matching ----------------------------------------------------------------------------

_VECS = """s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 1),
sim AS (SELECT s.id AS src, t.id AS tgt, round(list_dot_product(s.e, t.e), 12) AS v FROM s, t)"""


def _sides_of_vectors(spark, d):
    """Two graphs share the table: even ids are the source's, odd ids the target's."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    source, target = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    return source, target, source.select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"))


@_query("normalized_vectors", """SELECT vec_id AS id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total, round(list_max(e) / n, 6) AS top FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""")
def normalized_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.normalized(F.col("embedding")).alias("e"))
    return v.select("id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("e"), 6).alias("top"))


@_query("mapped_vectors", "SELECT vec_id AS id, round(CAST(embedding[64] AS DOUBLE) * 2 + CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[1] AS DOUBLE) * 2 + CAST(embedding[2] AS DOUBLE), 6) AS second FROM embeddings")
def mapped_vectors(spark, d):
    import numpy as np

    matrix = np.eye(64) + 2 * np.roll(np.eye(64), 1, axis=1)
    v = vectors.mapped(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), matrix)
    return v.select("id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[1], 6).alias("second"))


@_query("gram_matrix", """WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) SELECT a.i AS row, b.i AS col, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""")
def gram_matrix(spark, d):
    g = vectors.gram(table(spark, d, "embeddings"))
    each = g.mapInArrow(vectors.unpacked, "row long, vals array<double>").select("row", F.posexplode("vals").alias("col", "v"))
    return each.select("row", F.col("col").cast("long").alias("col"), F.round("v", 6).alias("v"))


for _metric, _expr in {
    "inner": "list_dot_product(s.e, t.e)", "cosine": "list_cosine_similarity(s.e, t.e)", "euclidean": "1 - list_distance(s.e, t.e)",
    "manhattan": "1 - list_sum(list_transform(range(1, 65), lambda i: abs(s.e[i] - t.e[i])))",
}.items():

    @_query(f"top_candidates_{_metric}", f"WITH {_VECS.split('sim AS')[0].rstrip().rstrip(',')}, sim AS (SELECT s.id AS src, t.id AS tgt, round({_expr}, 12) AS v FROM s, t) SELECT src, tgt, round(v, 6) AS sim, row_number() OVER (PARTITION BY src ORDER BY v DESC, tgt) AS place FROM sim QUALIFY place <= 10")
    def top_candidates(spark, d, metric=_metric):
        source, target, _ = _sides_of_vectors(spark, d)
        return matching.top_candidates(source, target, 10, metric).select("src", "tgt", F.round("sim", 6).alias("sim"), F.col("place").cast("long").alias("place"))

    @_query(f"pruned_candidates_{_metric}", _sql[f"top_candidates_{_metric}"])
    def pruned_candidates(spark, d, metric=_metric):
        """The same rows, without the blocks that can't hold them."""
        source, target, _ = _sides_of_vectors(spark, d)
        found = pruning.pruned_candidates(source, target, 10, metric, block_rows=64)
        return found.select("src", "tgt", F.round("sim", 6).alias("sim"), F.col("place").cast("long").alias("place"))


_CSLS = f"""WITH {_VECS}, r1 AS (SELECT src, avg(v) AS r FROM (SELECT src, v, row_number() OVER (PARTITION BY src ORDER BY v DESC) AS num FROM sim) WHERE num <= 10 GROUP BY src),
r2 AS (SELECT tgt, avg(v) AS r FROM (SELECT tgt, v, row_number() OVER (PARTITION BY tgt ORDER BY v DESC) AS num FROM sim) WHERE num <= 10 GROUP BY tgt), c AS (SELECT src, tgt, round(2 * v - r1.r - r2.r, 12) AS v FROM sim JOIN r1 USING (src) JOIN r2 USING (tgt))"""


@_query("csls_matches", f"{_CSLS} SELECT src, tgt, round(v, 6) AS sim FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY v DESC, tgt) = 1")
def csls_matches(spark, d):
    source, target, _ = _sides_of_vectors(spark, d)
    return matching.greedy_matches(source, target, csls_k=10).select("src", "tgt", F.round("sim", 6).alias("sim"))


@_query("pruned_csls_matches", _sql["csls_matches"])
def pruned_csls_matches(spark, d):
    source, target, _ = _sides_of_vectors(spark, d)
    return pruning.pruned_candidates(source, target, 1, block_rows=64, csls_k=10).select("src", "tgt", F.round("sim", 6).alias("sim"))


@_query("neighbourhood_means", f"{_CSLS} SELECT src AS id, round(r, 6) AS r FROM r1 UNION ALL SELECT tgt, round(r, 6) FROM r2")
def neighbourhood_means(spark, d):
    source, target, _ = _sides_of_vectors(spark, d)
    a, b = matching.with_neighbourhood(source, target, 10)
    return a.select("id", F.round("r", 6).alias("r")).unionByName(b.select("id", F.round("r", 6).alias("r")))


_RANKS = "SELECT g.src, g.tgt, count(*) FILTER (c.tgt <> g.tgt AND (c.v > g.v OR (c.v = g.v AND c.tgt < g.tgt))) AS ground_rank FROM {c} g JOIN {c} c USING (src) WHERE g.tgt = g.src + 1 GROUP BY g.src, g.tgt"


@_query("gold_ranks", f"WITH {_VECS} {_RANKS.format(c='sim')}")
def gold_ranks(spark, d):
    return matching.gold_ranks(*_sides_of_vectors(spark, d))


@_query("ranking_metrics", f"""{_CSLS}, r AS ({_RANKS.format(c='c')}) SELECT round(avg(CASE WHEN ground_rank < 1 THEN 1.0 ELSE 0 END) * 100, 2) AS hits_1, round(avg(CASE WHEN ground_rank < 5 THEN 1.0 ELSE 0 END) * 100, 2) AS hits_5,
round(avg(CASE WHEN ground_rank < 10 THEN 1.0 ELSE 0 END) * 100, 2) AS hits_10, round(avg(ground_rank + 1), 6) AS mr, round(avg(1 / (ground_rank + 1)) * 100, 6) AS mrr FROM r""")
def ranking_metrics(spark, d):
    m = matching.ranking_metrics(matching.gold_ranks(*_sides_of_vectors(spark, d), csls_k=10))
    return m.withColumns({"mr": F.round("mr", 6), "mrr": F.round("mrr", 6)})


_LISTS = f"WITH {_VECS}, p AS (SELECT src, tgt, v, row_number() OVER (PARTITION BY src ORDER BY v DESC, tgt) AS place FROM sim QUALIFY place <= 10), l AS (SELECT src, list(v ORDER BY place) AS x FROM p GROUP BY src)"
_DIFFICULTY = "x[-1] - x[1] + 10 / (1 + list_sum(list_transform(range(1, len(x)), lambda i: abs(x[i] - x[i + 1]) / i)))"


def _lists(spark, d):
    source, target, _ = _sides_of_vectors(spark, d)
    return matching.candidate_lists(matching.top_candidates(source, target, 10))


@_query("candidate_difficulty", f"{_LISTS} SELECT src AS id, round({_DIFFICULTY}, 6) AS difficulty, round(list_sum(list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x)))), 6) AS scaled FROM l")
def candidate_difficulty(spark, d):
    rows = _lists(spark, d).withColumn("z", matching.scaled())
    return rows.select(F.col("src").alias("id"), F.round(matching.difficulty(), 6).alias("difficulty"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 6).alias("scaled"))


@_query("hard_entities", f"{_LISTS} SELECT src AS id, round({_DIFFICULTY}, 6) AS difficulty FROM l QUALIFY row_number() OVER (ORDER BY round({_DIFFICULTY}, 9) DESC, src) <= floor((SELECT count(*) FROM l) * 0.3)")
def hard_entities(spark, d):
    rows = _lists(spark, d).select(F.col("src").alias("id"), F.round(matching.difficulty(), 9).alias("difficulty"))
    return splits.hard_entities(rows, 0.3).withColumn("difficulty", F.round("difficulty", 6))


@_query("easy_entities", f"{_LISTS} SELECT src AS id, round({_DIFFICULTY}, 6) AS difficulty FROM l QUALIFY row_number() OVER (ORDER BY round({_DIFFICULTY}, 9), src) <= floor((SELECT count(*) FROM l) * 0.3)")
def easy_entities(spark, d):
    rows = _lists(spark, d).select(F.col("src").alias("id"), F.round(matching.difficulty(), 9).alias("difficulty"))
    return splits.hard_entities(rows, 0.3, "easy").withColumn("difficulty", F.round("difficulty", 6))


@_query("random_entities", f"{_LISTS} SELECT src AS id, round({_DIFFICULTY}, 6) AS difficulty FROM l QUALIFY row_number() OVER (ORDER BY md5('42:'||src), src) <= floor((SELECT count(*) FROM l) * 0.3)")
def random_entities(spark, d):
    rows = _lists(spark, d).select(F.col("src").alias("id"), F.round(matching.difficulty(), 9).alias("difficulty"))
    return splits.hard_entities(rows, 0.3, "random").withColumn("difficulty", F.round("difficulty", 6))


@_query("candidate_names", f"WITH {_VECS}, p AS (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY v DESC, tgt) AS place FROM sim QUALIFY place <= 10) SELECT src AS key, string_agg('vec/'||tgt, ' ' ORDER BY place) AS names FROM p GROUP BY src")
def candidate_names(spark, d):
    names = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("name"))
    rows = _lists(spark, d).select(F.col("src").alias("key"), F.col("candidates").alias("ids"))
    return resolve.candidate_names(rows, names).select("key", F.array_join("names", " ").alias("names"))


@_query("reduced_vectors", """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), k AS (SELECT id, id + j AS other FROM e, range(1, 6) q(j))
SELECT k.id, k.other, round(list_cosine_similarity(a.e, b.e), 6) AS product FROM k JOIN e a ON k.id = a.id JOIN e b ON k.other = b.id""")
def reduced_vectors(spark, d):
    """Signs of directions are arbitrary, products are not: at full rank they are the cosines of the vectors given."""
    v = written(vectors.reduced(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 64))
    pairs = v.select("id", F.col("embedding").alias("x"), F.explode(F.expr("transform(sequence(1, 5), j -> id + j)")).alias("other"))
    pairs = pairs.join(v.select(F.col("id").alias("other"), F.col("embedding").alias("y")), "other")
    return pairs.select("id", "other", F.round(F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6).alias("product"))


@_query("truncated_vectors", """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:12] AS e FROM embeddings), k AS (SELECT id, id + j AS other FROM e, range(1, 6) q(j))
SELECT k.id, k.other, round(list_cosine_similarity(a.e, b.e), 6) AS product FROM k JOIN e a ON k.id = a.id JOIN e b ON k.other = b.id""")
def truncated_vectors(spark, d):
    """Vectors of 64 numbers and rank 12 in 12 directions, found without their 64 x 64 sum: products stay."""
    times = lambda k: F.transform(F.slice("embedding", 1, 12), lambda x: x * k)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.concat(*map(times, range(1, 7))), 1, 64).alias("embedding"))
    # The last copy is cut after 4 numbers, so these weigh more; scaled down, all weigh alike.
    weight = F.array(*[F.lit((55 + (36 if i < 4 else 0)) ** -0.5) for i in range(12)] * 6)
    v = v.withColumn("embedding", F.zip_with("embedding", F.slice(weight, 1, 64), lambda x, w: x.cast("double") * w))
    v = written(vectors.reduced(written(v), 12, max_gram=16))
    pairs = v.select("id", F.col("embedding").alias("x"), F.explode(F.expr("transform(sequence(1, 5), j -> id + j)")).alias("other"))
    pairs = pairs.join(v.select(F.col("id").alias("other"), F.col("embedding").alias("y")), "other")
    return pairs.select("id", "other", F.round(F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6).alias("product"))


_HASHED = f"""WITH w AS (SELECT doc_id AS id, unnest({_WORDS}) AS word FROM documents), h AS (SELECT id, CAST('0x'||md5('0:'||word)[:8] AS BIGINT) AS h FROM w),
v AS (SELECT id, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL)"""


@_query("encoded_texts", f"{_HASHED} SELECT id, k AS place, CAST(x AS BIGINT) AS value FROM v WHERE x <> 0")
def encoded_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    v = vectors.encoded(docs, vectors.hashed_encoder()).select("id", F.posexplode("embedding").alias("place", "value"))
    return v.where("value <> 0").select("id", F.col("place").cast("long").alias("place"), F.col("value").cast("long").alias("value"))


@_query("stacked_vectors", "SELECT vec_id AS id, 1 + vec_id % 2 AS kg, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def stacked_vectors(spark, d):
    source, target, _ = _sides_of_vectors(spark, d)
    return vectors.stacked(source, target).select("id", F.col("kg").cast("long").alias("kg"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@_query("stacked_texts", "SELECT doc_id AS id, 1 AS kg, text AS content FROM documents UNION ALL SELECT conv_id, 2, text FROM conversations WHERE turn = 0")
def stacked_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return vectors.stacked(docs, table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("content")))


@_query("binary_metrics", r"""WITH r AS (SELECT toxic, CASE WHEN regexp_matches(text, '(?i)\b(trash|idiot|stupid|worthless|disgusting)\b') THEN 1 ELSE 0 END AS o FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (o = 1 AND toxic = 1) AS tp, count(*) FILTER (o = 0 AND toxic = 0) AS tn, count(*) FILTER (o = 1 AND toxic = 0) AS fp, count(*) FILTER (o = 0 AND toxic = 1) AS fn FROM r),
m AS (SELECT *, 100.0 * (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) END AS recall FROM c)
SELECT tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m""")
def binary_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    m = matching.binary_metrics(rows.withColumn("o", F.col("text").rlike(r"(?i)\b(trash|idiot|stupid|worthless|disgusting)\b").cast("int")), "o", "toxic")
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


# --- models -------------------------------------------------------------------------------------------


def _end(question: str) -> str:
    """A stand-in for a model: fails where the details are long."""
    if len(question) > 2000:
        raise RuntimeError("too long")
    return f"\t{question[-20:]}!\n"


def _count(question: str) -> str:
    return f"{len(question)} characters"


def _short_count(question: str) -> str:
    if len(question) > 4000:
        raise RuntimeError("too long")
    return _count(question)


def _named_documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))


@_query("enriched_texts", f"""WITH q AS (SELECT doc_id AS id, 'doc/'||doc_id AS name, {_prompt_sql("short", "'doc/'||doc_id", "text")} AS q FROM documents), a AS (SELECT *, chr(9)||right(q, 20)||'!' AS answer FROM q)
SELECT id, name, CASE WHEN length(q) > 2000 THEN length(q)||' characters' ELSE replace(trim(replace(replace(answer, chr(13), ''), chr(10), ''), ' '||chr(9)||chr(11)||chr(12)), chr(9), ' ') END AS content FROM a""")
def enriched_texts(spark, d):
    """In two runs: the first stops after one chunk of three, the second asks only for the rest."""
    docs, path = _named_documents(spark, d), new_folder(spark, "answers")
    options = {"kind": "short", "tries": 2, "chunk_rows": docs.count() // 3 + 1}
    enrich.with_fallback(docs, _end, _count, path, max_chunks=1, **options)
    good, _ = enrich.with_fallback(docs, _end, _count, path, **options)
    return good


@_query("failed_texts", f"""WITH q AS (SELECT doc_id AS id, 'doc/'||doc_id AS name, text AS content, {_prompt_sql("short", "'doc/'||doc_id", "text")} AS q FROM documents)
SELECT id, name, content FROM q WHERE length(q) > 4000""")
def failed_texts(spark, d):
    """What both models failed on."""
    return enrich.with_fallback(_named_documents(spark, d), _end, _short_count, kind="short", tries=1)[1]


@_query("summarized_texts", f"""WITH q AS (SELECT doc_id AS id, {_prompt_sql("summary", "''", "text")} AS q FROM documents)
SELECT id, CASE WHEN length(q) <= 2000 THEN replace(trim(replace(replace(chr(9)||right(q, 20)||'!', chr(13), ''), chr(10), ''), ' '||chr(9)||chr(11)||chr(12)), chr(9), ' ') END AS summary, CASE WHEN length(q) > 2000 THEN 'error' ELSE 'ok' END AS status FROM q""")
def summarized_texts(spark, d):
    return enrich.summarized(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), _end, tries=1).drop("content")


@_query("upper_lines", "SELECT doc_id AS pos, upper(lang)||'!' AS value FROM documents")
def upper_lines(spark, d):
    return enrich.each_line(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("lang").alias("value")), lambda v: v.upper() + "!")


# --- files ----------------------------------------------------------------------------------------------


@_query("id_triple_files", "SELECT l_orderkey AS h, l_linenumber AS r, l_partkey AS t, 'hrt' AS kind FROM lineitem UNION ALL SELECT o_orderkey, 0, o_custkey, 'htr' FROM orders UNION ALL SELECT n_nationkey, NULL, NULL, 'reject' FROM nation")
def id_triple_files(spark, d):
    """Folders in folders are read whole; both orders of columns; lines that are no numbers are rejects."""
    n = new_folder(spark, "files")
    row = lambda *c: F.concat_ws("\t", *[F.col(x).cast("string") if isinstance(x, str) else x for x in c]).alias("value")
    table(spark, d, "lineitem").select(row("l_orderkey", "l_linenumber", "l_partkey")).write.text(f"{n}/hrt/a/b")
    table(spark, d, "nation").select(row("n_nationkey", F.lit("x"), "n_regionkey")).write.text(f"{n}/hrt/c")
    table(spark, d, "orders").select(row("o_orderkey", "o_custkey", F.lit("0"))).write.text(f"{n}/htr/a")
    (one, bad), (two, none) = (files.parse_id_triples(files.read_lines(spark, f"{n}/{order}"), order) for order in ("hrt", "htr"))
    gone = bad.unionByName(none).select(F.substring_index("value", "\t", 1).cast("long").alias("h"), F.lit(None).cast("long").alias("r"), F.lit(None).cast("long").alias("t"))
    parts = [x.select("h", "r", "t", F.lit(kind).alias("kind")) for x, kind in ((one, "hrt"), (two, "htr"), (gone, "reject"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("tsv_files", r"""SELECT doc_id AS id, '"'||source||'" \x' AS name, replace(replace(text, chr(10), '\n'), chr(9), ' ') AS content FROM documents""")
def tsv_files(spark, d):
    """Quotes and backslashes survive a round trip."""
    path = new_folder(spark, "files")
    flat = F.replace(X.one_line(F.col("text")), F.lit("\t"), F.lit(" "))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit('"'), "source", F.lit('" \\x')).alias("name"), flat.alias("content"))
    files.write_tsv(docs, path)
    return files.read_tsv(spark, path, "id long, name string, content string")


@_query("dictionary_files", "SELECT c_custkey AS id, c_name AS name, 'id first' AS kind FROM customer UNION ALL SELECT c_custkey, c_name, 'name first' FROM customer")
def dictionary_files(spark, d):
    names, out = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), []
    for name_first in (False, True):
        path = new_folder(spark, "files")
        files.write_dictionary(names, path, name_first)
        out.append(files.read_dictionary(spark, path, name_first)[0].withColumn("kind", F.lit("name first" if name_first else "id first")))
    return out[0].unionByName(out[1])


@_query("candidate_files", f"{_LISTS} SELECT src AS key, list_sum(list_transform(x, lambda v: round(v, 6))) AS total, round({_DIFFICULTY}, 6) AS difficulty, len(x) AS n FROM l")
def candidate_files(spark, d):
    """Nested records as JSON lines, written in the order of difficulty."""
    path = new_folder(spark, "files")
    rows = _lists(spark, d).select(F.col("src").alias("ref"), "candidates", "cand_sims", matching.difficulty().alias("difficulty"))
    files.write_candidates(rows, path)
    back = files.read_rows(spark, path, files.CANDIDATE)
    total = F.aggregate("cand_sims", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return back.select(F.col("ref").alias("key"), total.alias("total"), F.round("difficulty", 6).alias("difficulty"), F.size("candidates").cast("long").alias("n"))


@_query("json_map_files", "SELECT conv_id||'/'||turn AS key, role||': '||text AS value FROM conversations")
def json_map_files(spark, d):
    """One JSON object for each conversation, keyed by turn."""
    path = new_folder(spark, "files")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, d, "conversations").select("conv_id", F.struct(key.alias("key"), F.concat("role", F.lit(": "), "text").alias("value")).alias("e"))
    rows.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).select("value").write.text(path)
    return files.read_json_map(spark, path, T.StringType(), whole=False)


@_query("json_object_files", f"{_LISTS.replace('list(v ORDER BY place) AS x', 'list(v ORDER BY place) AS x, list(tgt ORDER BY place) AS c')} SELECT CAST(src AS VARCHAR) AS key, src AS ref, array_to_string(c, ' ') AS candidates, round({_DIFFICULTY}, 6) AS difficulty, round(x[-1], 6) AS last_sim FROM l")
def json_object_files(spark, d):
    """Candidate records as one JSON object a file, read back in ranges of bytes."""
    path = new_folder(spark, "files")
    rows = _lists(spark, d).select(F.col("src").alias("ref"), "candidates", "cand_sims", matching.difficulty().alias("difficulty"))
    files.write_json_objects(rows.select(F.col("ref").cast("string").alias("key"), F.struct("ref", "candidates", "cand_sims", "difficulty").alias("value")), path)
    back = json_object.read_json_object(spark, path).select("key", "value.*")
    return back.select("key", "ref", F.array_join("candidates", " ").alias("candidates"), F.round("difficulty", 6).alias("difficulty"), F.round(F.element_at("cand_sims", -1), 6).alias("last_sim"))


@_query("vector_files", "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, 2 AS kg FROM embeddings WHERE vec_id % 2 = 1")
def vector_files(spark, d):
    path = new_folder(spark, "files")
    source, target, _ = _sides_of_vectors(spark, d)
    files.write_vectors(vectors.stacked(source, target), path)
    return files.read_vectors(spark, path, 2).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.lit(2).alias("kg"))
