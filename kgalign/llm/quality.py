"""Operator 7, quality rules: line-first cleaning, in column expressions only.

Each line is tried by punctuation, navigation and boilerplate rules; lines that
fail are removed, and a document that loses too large a part of its words, or
that fails the base measures, is rejected. Most rules count signs and so hold for
any language: symbols, separators between short items, addresses, long lines
without any mark of a sentence. The phrases are those of the corpus's languages.

Defined results: a null or empty text has no words and fails the base; rows are
independent, so there are no ties, repeated rows and rows with a null doc_id get the
results of any other, and an empty table gives an empty result; a long text is one row's
work, held a few times over in a task; lines without a word never fail and stay where
they are; other columns are passed on whatever their names, those with the names of the
added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, columns_of, free_name

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document may lose this percentage of its words with the lines that fail.
MAX_LOST_PERCENT = 50
#: Punctuation: symbols or doubled exclamation marks, as a percentage of a line's words.
MAX_MARKS_PERCENT = 30
MARKS = rf"[{SYMBOLS}]+|!!+"
#: Punctuation: a line of so many words or more has at least one mark that ends or parts sentences, in any script.
LONG_LINE_WORDS = 60
SENTENCE_MARKS = ".!?:;,…。！？；：，、।؟،۔"
#: Navigation: separators that stand alone, or addresses, as a percentage of a line's words.
NAVIGATION = rf"(?:^|[{SPACE_CLASS}])[|»›·•>/](?:[{SPACE_CLASS}]|$)"
MIN_NAVIGATION_MARKS = 2
ADDRESS = r"https?://|www\."
MAX_ADDRESS_PERCENT = 50
BOILERPLATE = (
    r"\ball rights reserved\b|\blicen[sc]ed under\b|\breleased under the\b|\bcookies? (?:policy|settings|preferences)\b|\buses? cookies\b"
    r"|\bprivacy policy\b|\bterms (?:of (?:use|service)|and conditions)\b|\benable javascript\b|\bclick here\b|\bread more\b"
    r"|\bsubscribe to\b|\bsign (?:in|up)\b|\blog ?in\b|\bshare (?:this|on)\b|\bskip to (?:main )?content\b|\bpowered by\b|(?:©|\(c\)) ?(?:19|20)\d\d"
    r"|\balle rechte vorbehalten\b|\bcookie-einstellungen\b|\bimpressum\b|\bweiterlesen\b|\btous droits r\S+serv\S+s\b|\bmentions l\S+gales\b"
    r"|\blire la suite\b|\btodos los derechos reservados\b|\bpol\S+tica de (?:privacidad|cookies)\b|\baviso legal\b|\bleer m\S+s\b"
)
#: A boilerplate line is short; longer lines are prose that mentions such words.
MAX_BOILERPLATE_WORDS = 25


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _is_bad(line: Column, words: Column) -> Column:
    punctuation = (_count(line, MARKS) * 100 > words * MAX_MARKS_PERCENT) | ((words >= LONG_LINE_WORDS) & ~line.rlike(f"[{SENTENCE_MARKS}]"))
    navigation = (_count(line, NAVIGATION) >= MIN_NAVIGATION_MARKS) | (_count(line, ADDRESS) * 100 >= words * MAX_ADDRESS_PERCENT)
    boilerplate = (words <= MAX_BOILERPLATE_WORDS) & line.rlike("(?i)" + BOILERPLATE)
    return (words > 0) & (punctuation | navigation | boilerplate)


#: Hints in lower case: a text with no mark, no navigation sign, no long run without a sentence mark and none of these has no line that fails.
BOILERPLATE_HINTS = (
    "rights reserved", "licensed", "licenced", "released under", "cookie", "privacy policy", "terms ", "javascript", "click here",
    "read more", "subscribe", "sign in", "sign up", "login", "log in", "share ", "skip to", "powered by", "©", "(c)",
    "vorbehalten", "impressum", "weiterlesen", "tous droits", "mentions l", "lire la suite", "derechos reservados", "tica de ", "aviso legal", "leer m",
)
MARK_HINT = rf"[{SYMBOLS}»›·•/]|!!|www\."
#: So many words and the spaces between them take as many characters at least; the run is tried once, after a mark.
LONG_LINE_HINT = rf"(?:\A|[\n{SENTENCE_MARKS}])[^\n{SENTENCE_MARKS}]{{{2 * LONG_LINE_WORDS - 1}}}"

#: A window's hash without its low bits, which hold the position: sorting plain
#: longs finds nearly all windows that occur once. Longer texts use the low bits
#: of the hash too; the candidates' whole hashes are compared in any case.
_POSITION_BITS = 20
#: In these expressions, ``@`` stands for the names of the columns between.
_WINDOW = "xxhash64(@hashes[{i}], @hashes[{i} + 1], @hashes[{i} + 2])"
_PACKED = (
    "case when size(@hashes) < 3 then array() else sort_array(transform(sequence(0, size(@hashes) - 3), "
    f"i -> shiftleft(shiftright({_WINDOW.format(i='i')}, {_POSITION_BITS}), {_POSITION_BITS}) | cast(i as bigint) % {1 << _POSITION_BITS})) end"
)
_CANDIDATES = (
    f"filter(@packed, (w, k) -> (k > 0 and shiftright(@packed[k - 1], {_POSITION_BITS}) = shiftright(w, {_POSITION_BITS}))"
    f" or (k + 1 < size(@packed) and shiftright(@packed[k + 1], {_POSITION_BITS}) = shiftright(w, {_POSITION_BITS})))"
)
#: Candidates with their whole hashes, equal ones as neighbours.
_WHOLE = (
    "sort_array(transform(if(size(@hashes) > {n}, sequence(0, size(@hashes) - 3), transform(@packed, w -> cast(w & {m} as int))), "
    "i -> named_struct('h', {w}, 'i', i)))"
).format(n=1 << _POSITION_BITS, m=(1 << _POSITION_BITS) - 1, w=_WINDOW.format(i="i"))
#: Positions of windows with an equal neighbour, in order; then the words they cover, each once.
_TWICE = "sort_array(transform(filter(@whole, (w, k) -> w.h <=> get(@whole, k - 1).h or w.h <=> get(@whole, k + 1).h), x -> x.i))"
_COVERED = "aggregate(@places, named_struct('n', 0L, 'end', -1), (a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.end), 'end', i + 3), a -> a.n)"
_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "clean_text", "kept"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, clean_text, kept``.

    ``clean_text`` is the text without the lines that fail (null for null).
    Columns of ``docs`` with these names are replaced.
    """
    base = docs.drop(*_ADDED)
    at = free_name(base, "_q_")  # no column of the user's starts like this
    name, of, expr = lambda n: at + n, lambda n: F.col(at + n), lambda e: F.expr(e.replace("@", at))
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    hint = text.rlike(MARK_HINT) | text.rlike(LONG_LINE_HINT)
    for word in BOILERPLATE_HINTS:
        hint = hint | low.contains(word)
    step = base.withColumns({
        name("hashes"): F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w)),
        name("lines"): F.split(text, "\n"),
        name("hint"): hint,
    })
    step = step.withColumns({
        name("packed"): expr(_PACKED),
        name("twice"): F.size(F.array_distinct(of("lines"))) < F.size(of("lines")),
        name("tried"): F.when(of("hint"), F.transform(of("lines"), lambda x: F.struct(x.alias("line"), _count(x, WORD).alias("words")))),
    })
    step = step.withColumns({
        name("packed"): expr(_CANDIDATES),
        name("tried"): F.transform(of("tried"), lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), _is_bad(x["line"], x["words"]).alias("bad"))),
        name("worded"): F.when(of("twice"), F.filter(of("lines"), lambda x: x.rlike(WORD))),
    })
    step = step.withColumn(name("whole"), expr(_WHOLE))
    step = step.withColumn(name("places"), expr(_TWICE))
    step = step.withColumns({
        "n_words": F.size(of("hashes")).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long"),
        "n_symbols": _count(text, f"[{SYMBOLS}]").cast("long"),
        "n_dup_lines": F.when(of("twice"), F.size(of("worded")) - F.size(F.array_distinct(of("worded")))).otherwise(0).cast("long"),
        "n_repeat_words": expr(_COVERED).cast("long"),
        "lost_words": F.coalesce(expr("aggregate(@tried, 0L, (a, x) -> a + if(x.bad, x.words, 0))"), F.lit(0).cast("long")),
        "clean_text": F.when(
            of("hint") & F.col("text").isNotNull(), F.array_join(expr("transform(filter(@tried, x -> not x.bad), x -> x.line)"), "\n")
        ).otherwise(F.col("text")),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    step = step.withColumn("base_failed", failed)
    step = step.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= MAX_LOST_PERCENT * F.col("n_words")))
    # A generator of one row: a filter on these columns stays above it. Below, it would be
    # rewritten in terms of the text, and the word hashes made anew for every word.
    return step.select(*columns_of(base), F.inline(F.array(F.struct(*_ADDED))))
