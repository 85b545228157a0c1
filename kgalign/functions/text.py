"""Names, URIs, literals, words and prompts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name spaces that are cut off URIs, tried in this order.
PREFIXES = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#",
    "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2003/01/geo/wgs84_pos#", "http://www.w3.org/2004/02/skos/core#",
    "http://purl.org/dc/terms/", "http://xmlns.com/foaf/0.1/", "http://www.w3.org/2006/vcard/ns#", "http://dbpedia.org/property/",
    "http://dbpedia.org/resource/", "http://dbpedia.org/ontology/", "http://dbpedia.org/", "http://www.mpii.de/yago/resource/",
    "http://yago-knowledge.org/resource/", "http://www.geonames.org/ontology#", "http://www.wikidata.org/entity/", "http://www.wikidata.org/",
    "http://schema.org/", "http://rdf.freebase.com/ns/", "http://rdf.freebase.com/", "http://zh.dbpedia.org/resource/",
    "http://zh.dbpedia.org/property/", "http://zh.dbpedia.org/", "http://fr.dbpedia.org/resource/", "http://fr.dbpedia.org/property/",
    "http://fr.dbpedia.org/", "http://ja.dbpedia.org/resource/", "http://ja.dbpedia.org/property/", "http://ja.dbpedia.org/",
    "http://de.dbpedia.org/resource/", "http://de.dbpedia.org/property/", "http://de.dbpedia.org/", "http://purl.org/dc/elements/1.1/",
    "http://vi.dbpedia.org/resource/", "http://th.dbpedia.org/resource/", "http://data.doremus.org/", "http://erlangen-crm.org/", "http://isni.org/",
)
# Fixed value: the marks that part words.
MARKS = "!\"'#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
WORD = r"([\p{L}\p{N}_]+)"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(" \t\n\x0b\x0c\r"))


def strip_brackets(c: Column) -> Column:
    """A quoted literal up to its last quote; else without a leading ``<`` and a trailing ``>``."""
    literal = F.regexp_replace(c, r'(?s)\A(".*")[^"]*\z', "$1")
    return F.when(c.startswith('"'), literal).otherwise(F.regexp_replace(c, r"\A<|>\z", ""))


def compress_uri(c: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """A URI without the first prefix that fits, its underscores and tabs as spaces, without ``%`` and no-break spaces."""
    bare = strip_brackets(c)
    cut = reduce(
        lambda rest, p: F.when(bare.startswith(p), F.translate(F.replace(bare, F.lit(p), F.lit("")), "_\t% ", "  ")).otherwise(rest),
        reversed(prefixes), bare,
    )
    return F.when(bare.startswith("http://"), cut).otherwise(bare)


def words(c: Column) -> Column:
    """Lower-case words, parted by marks and spaces; none for null."""
    spaced = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKS, " " * len(MARKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shorten_uuids(name: Column, entity_id: Column) -> Column:
    """Every UUID in a name becomes ``E`` and the entity's id."""
    return F.regexp_replace(name, F.lit(UUID), F.concat(F.lit("E"), entity_id.cast("string")))


def unquote(c: Column) -> Column:
    """A value that starts with a quote without its first and last character."""
    return F.when(c.startswith('"'), F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def quote(c: Column) -> Column:
    return F.when(c.startswith('"'), c).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def many_digits(text: Column) -> Column:
    """Longer than 11 characters, with at least 11 digits on one line."""
    return (F.length(text) > 11) & text.rlike(r"(?:\d.*?){11,}")


def count_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(1)))


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def from_one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def clean_answer(c: Column) -> Column:
    """A model's answer on one line: no line breaks, no tabs, trimmed."""
    return F.replace(stripped(F.translate(c, "\r\n", "")), F.lit("\t"), F.lit(" "))


def last_field(c: Column) -> Column:
    return F.element_at(F.split(c, "\t"), -1)


def python_quoted(c: Column) -> Column:
    """A string as Python prints it."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


#: Prompts by kind; ``{name}`` is filled in where it stands, and the entity's text follows, but for ``name``.
PROMPTS = {
    "english": 'Explain the entity or code "{name}" in English in fewer than 150 words, from what you know and these details:\n',
    "simple": "Explain {name} in English in fewer than 150 words. Details:\n",
    "short": 'Explain the entity or code "{name}" in fewer than 50 words, from what you know and these details:\n',
    "distinct": 'Describe "{name}" in English in fewer than 150 words, so that it stands out from its neighbours. Given are its attributes, then its relations:\n',
    "name": 'Explain the entity or code "{name}" in English in fewer than 150 words.',
    "summary": "Turn this loose text into a short, well-written summary: keep its key points, and add what you know where that helps. The text:\n",
}


def prompt_kind(input_info: str, instruct: str, answer_english: bool) -> str:
    if input_info == "name":
        return "name"
    return "english" if answer_english else instruct if instruct in ("simple", "short") else "distinct"


def prompt(name: Column, text: Column, kind: str, prompts: dict[str, str] = PROMPTS) -> Column:
    head, *tail = prompts[kind].split("{name}")
    details = F.lit("") if kind == "name" else from_one_line(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(head), *[part for t in tail for part in (name, F.lit(t))], details)


def chat_messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
