"""Each operator against brute force on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgalign.llm import chat, embeddings, line_dedup, mixing, near_dedup, packing, quality, rans, sharding, token_counts, token_files
from kgalign.llm.queries import queries, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_chars long, size long, key string"


def _texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "zeta.", "###", "42", "<|endoftext|>", "日本", "it's"]
    out = [None, "", "   ", "\n\n", "one", "a b c d", "x" * 5000, "tab\tand\r\nline", " lead  double \n\ntail\n", "Cookie policy | Home | About | Login"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    out += base + base[:2]
    for b in base[:3]:  # near copies
        w = b.split(" ")
        w[rng.randrange(60)] = "changed"
        out.append(" ".join(w))
    line = "This line is long enough to count."
    out += [f"{rng.choice(words)} {i}\n{line if i % 2 else line.upper() + '  '}\nshort" for i in range(8)]
    out.append("\n".join(" ".join(rng.choices(words, k=12)) for _ in range(900)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "b", "a", "c"][i % 4], 0, -1, "clash") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids and rows, and a null id."""
    t = "some words that are said again and again in here"
    rows = [(1, t, "s", 0, 0, ""), (1, t, "s", 0, 0, ""), (1, "other text", "s", 0, 0, ""), (None, t, None, 0, 0, ""), (2, t, None, 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(path, text, end, special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_sharding(spark, docs, odd, none):
    rows = sharding.shard_documents(spark, docs, shards=4).collect()
    count = Counter(r["shard"] for r in rows)
    assert max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(count[s]))
    text = dict(enumerate(_texts()))
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    got = sharding.shard_documents(spark, odd, shards=2).collect()
    assert sorted(r.slot for r in got) == [0, 0, 1, 1, 2] and sorted((r.doc_id or 0, r.size) for r in got) == [(0, 64), (1, 26), (1, 64), (1, 64), (2, 64)]
    assert sharding.shard_documents(spark, none).count() == 0


def test_sharding_keeps_copies_together(spark):
    rows = [(i, f"text {i % 40}", "s", 0, 0, "") for i in range(80)] + [(100 + i, "hot", "s", 0, 0, "") for i in range(40)] + [(200 + i, f"own {i}", "s", 0, 0, "") for i in range(80)]
    got = sharding.shard_documents(spark, spark.createDataFrame(rows, SCHEMA), shards=5).collect()
    where = {r.doc_id: r["shard"] for r in got}
    assert len({where[i] for i in range(100, 140)}) <= 2  # 40 copies fill a shard of 40, which other groups want too
    assert sum(where[i] != where[i + 40] for i in range(40)) <= 4
    assert set(Counter(where.values()).values()) == {40}


def test_line_dedup(spark, docs, odd, none):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    texts, held = _texts(), {}
    for i, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    for batches in (1, 4):
        for r in line_dedup.dedup_lines(spark, docs, batches=batches).collect():
            parts = (texts[r.doc_id] or "").split("\n")
            stay = [p for p in parts if len(key(p)) < 20 or len(held[key(p)]) < 3 or max(held[key(p)]) == r.doc_id]
            assert (r.n_lines, r.n_dropped, r.text, r.key) == (len(parts), len(parts) - len(stay), "\n".join(stay), "clash")
    # The line stands in three rows with an id; the largest doc_id, 2, keeps it, and so does the row without an id.
    got = Counter((r.doc_id, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark, odd).collect())
    text = "some words that are said again and again in here"
    assert got == Counter({(1, 1, ""): 2, (1, 0, "other text"): 1, (None, 0, text): 1, (2, 0, text): 1})
    clash = spark.createDataFrame([(1, "x", "mine", 5)], "doc_id long, text string, _drop string, _id int")
    assert [tuple(r) for r in line_dedup.dedup_lines(spark, clash).select("_drop", "_id", "text").collect()] == [("mine", 5, "x")]
    assert line_dedup.dedup_lines(spark, none).count() == 0


def test_line_runs_leave_nothing_in_the_warehouse(spark, docs, monkeypatch):
    from kgalign import storage

    tables = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    home = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    line_dedup.dedup_lines(spark, docs).count()
    assert not tables() and not (os.path.isdir(home) and any("line_run" in x for x in os.listdir(home)))
    made, write = [], line_dedup.LineRuns._write

    def fails(self, rows):
        made.append((write(self, rows), self.folder))
        if len(made) == 3:
            assert tables() and all(os.path.isdir(f"{self.folder}/{name}".removeprefix("file:")) for name in self.names)
            raise RuntimeError("lost")
        return made[-1][0]

    monkeypatch.setattr(line_dedup.LineRuns, "_write", fails)
    with pytest.raises(RuntimeError):
        line_dedup.dedup_lines(spark, docs)
    assert not tables() and not any(os.path.isdir(f"{folder}/{name}".removeprefix("file:")) for name, folder in made)
    assert all(folder.startswith(storage.shared_folder(spark)) for _, folder in made)


def _sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _smallest(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_near_dedup(spark, docs, odd, none):
    sets = _sets(_texts())
    want = _smallest(len(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    for r in near_dedup.near_duplicates(spark, docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    got = near_dedup.near_duplicates(spark, odd).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id is not None} <= {1, 2}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]
    assert near_dedup.near_duplicates(spark, none).count() == 0


def test_near_dedup_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (7, b + " more"), (8, c), (None, c + " more"), (None, d), (None, d + " more"), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark, docs).collect())
    assert got == Counter({
        (1, 76, 1, True): 1, (5, 77, 1, False): 1, (5, 76, 5, True): 2, (7, 77, 5, False): 1, (8, 76, 8, True): 1,
        (None, 77, None, False): 2, (None, 76, None, False): 1, (9, 0, 9, True): 2,
    })
    stay = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert len([t for i, t in stay if i is None and t in (d, d + " more")]) == 1
    assert Counter(x for x in stay if x[0] is not None) == Counter([(1, a), (5, b), (8, c), (9, ""), (9, None)]) and len(stay) == 6


def test_near_dedup_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = _sets(texts)
    want = _smallest(len(sets), lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, rows).collect()} == dict(enumerate(want))


def test_least_matches():
    for n in (32, 128):
        m = near_dedup.least_matches(n, 0.75, 1e-6)
        assert 0 < m < n * 0.75 and near_dedup.least_matches(n, 0.75, 1e-2) > m


def test_targets():
    assert [float(x) for x in mixing.targets([10, 10, 10], [5, 2, 1])] == [18.75, 7.5, 3.75]
    got = mixing.targets([1, 100, 0], [5, 2, 1])
    assert got[0] == 3 and got[1] == 98 and got[2] == 0


def test_mixing(spark, docs, odd, none):
    texts, names = _texts(), [None, "b", "a", "c"]
    size = [len(WORD.findall(t or "")) for t in texts]
    of = {s: sum(n for i, n in enumerate(size) if names[i % 4] == s) for s in names}
    order = ["a", "b", "c", None]
    aims = dict(zip(order, mixing.targets([of[s] for s in order], [5, 2, 1, 5])))
    rows = mixing.mix_documents(spark, docs, block=16).collect()
    assert len(rows) == len(texts)
    for s in names:
        own = [r for r in rows if names[r.doc_id % 4] == s]
        assert sum(r.taken for r in own) == round(aims[s])
        assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and r.source_size == of[s] and abs(r.target - aims[s]) < 1e-6 for r in own)
    again = mixing.mix_documents(spark, docs.repartition(5), block=16).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    made = mixing.mixed_documents(spark, docs, block=16).collect()
    assert Counter({i: n for i, n in ((r.doc_id, r.taken) for r in rows) if n}) == sum((Counter({r.doc_id: len(WORD.findall(r.text))}) for r in made), Counter())
    got = sorted((r.doc_id or 0, r["size"], r.source_size) for r in mixing.mix_documents(spark, odd).collect())
    assert got == [(0, 10, 20), (1, 2, 22), (1, 10, 22), (1, 10, 22), (2, 10, 20)] and mixing.mix_documents(spark, none).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", "mine", 7)], "doc_id long, text string, source string, _row string, _words int")
    assert [tuple(r) for r in mixing.mixed_documents(spark, clash).collect()] == [(1, "a b", "s", "mine", 7)]


def _plain_targets(sizes):
    """Shares by weight 5, 2, 1, ... of all words, cut at 3 times a source's size and shared again, one source after the other."""
    from fractions import Fraction

    weight = {k: (5, 2, 1)[k % 3] for k in range(len(sizes))}
    fixed = {}
    while True:
        free = [k for k in weight if k not in fixed and sizes[k]]
        left = Fraction(sum(sizes)) - sum(fixed.values())
        share = {k: left * weight[k] / sum(weight[i] for i in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return [fixed.get(k, share.get(k, Fraction(0))) for k in range(len(sizes))]
        fixed |= {k: Fraction(3 * sizes[k]) for k in over}


@pytest.mark.parametrize("block", [4, 64])
def test_mixing_against_a_plain_schedule(spark, block):
    """What each document gives, and where it first stands, by walking through the slots one by one."""
    from bisect import bisect_right

    rng = random.Random(11)
    names = ["b", "a", None, "", "é", *(f"h{i}" for i in range(9))]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300 if i % 7 == 0 else 3]), names[min(len(names) - 1, int(rng.expovariate(0.4)))]) for i in range(250)] + [(300, None, "a"), (None, "x y z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(5)).alias("h")).collect()}
    size = lambda t: len(WORD.findall(t or ""))
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s in rows if s == name) for name in order]
    aims = _plain_targets(sizes)
    quota = [round(x) for x in aims]
    wanted = [-(-q // block) for q in quota]
    n = mixing._drawn(sum(wanted), len(order))
    edges = [sum(wanted[: k + 1]) * mixing.MODULUS // sum(wanted) for k in range(len(order) - 1)]
    slots, later = [[] for _ in order], n
    for i in range(n):
        k = bisect_right(edges, i * mixing.GOLDEN_STEP % mixing.MODULUS)
        if len(slots[k]) < wanted[k]:
            slots[k].append(i)
    for k, w in enumerate(wanted):
        while len(slots[k]) < w:
            slots[k].append(later)
            later += 1
    want = {}
    for k, name in enumerate(order):
        words = [i for _, i in sorted((hashes[i], i) for i, t, s in rows if s == name and size(t)) for _ in range(size(next(t for j, t, _ in rows if j == i)))]
        taken = [words[w % len(words)] for w in range(quota[k])]  # the words of the mix, by their documents, in the order of the source's slots
        for i, t, s in rows:
            if s == name:
                at = [w for w, j in enumerate(taken) if j == i]
                want[i] = (size(t), sizes[k], float(aims[k]), len(at), min((slots[k][w // block] for w in at), default=None))
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken, r.first_slot) for r in mixing.mix_documents(spark, df, block=block).collect()}
    assert got.keys() == want.keys() and all(got[i][:2] == want[i][:2] and abs(got[i][2] - want[i][2]) < 1e-9 and got[i][3:] == want[i][3:] for i in want)


def test_schedule_gives_every_source_its_slots(spark):
    quota = [500_000 * 64, *(64 * w - w for w in range(1, 21)), 0, 500_000 * 64, *(64 for _ in range(20))]
    rows = mixing.schedule(spark, quota)
    found = rows.groupBy("k").agg(F.sum("take").alias("take"), F.count("*").alias("n"), F.countDistinct("j").alias("d"), F.max("j").alias("j")).collect()
    assert {r.k: r["take"] for r in found} == {k: q for k, q in enumerate(quota) if q}
    assert all(r.n == r.d == r.j + 1 for r in found)
    assert rows.select("slot").distinct().count() == rows.count()


def test_mixing_of_more_sources_than_a_list_holds(spark, docs, monkeypatch):
    rng = random.Random(8)
    names = [None, "", "é", "z", "日本", *(f"host{i}" for i in range(40))]
    size = lambda s: 40 if s == "z" else 1
    rows = [(i, rng.choice([None, "", "w " * rng.randint(1, 30 * size(s))]) if i % 3 else "w " * rng.randint(1, 9), s) for i, s in enumerate(names * 3)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_list = sorted((tuple(r) for r in mixing.mix_documents(spark, many, block=4).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    assert sorted((tuple(r) for r in mixing.mix_documents(spark, many, block=4).collect())) == by_list
    wordless = spark.createDataFrame([(i, None, f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix_documents(spark, wordless).collect()] == [(0, 0.0)] * 5


def test_quality(spark, docs, none):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(_texts()):
        w, c = WORD.findall(t or ""), Counter()
        c.update(zip(w, w[1:], w[2:]))
        covered = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.key == "clash"
    assert got[9].lost_words == got[9].n_words and quality.quality_rules(none).count() == 0


def _bad_line(line):
    n = len(WORD.findall(line))
    if not n:
        return False
    marks, alone = len(re.findall(r"[#*$%&|<>]+|!!+", line)), len(re.findall(quality.NAVIGATION, line))
    phrases = re.search(quality.BOILERPLATE, line, re.IGNORECASE | re.ASCII)
    unmarked = n >= 60 and not any(c in line for c in quality.SENTENCE_MARKS)
    links = len(re.findall(r"https?://|www\.", line))
    return marks * 100 > 30 * n or unmarked or alone >= 2 or links * 2 >= n or (n <= 25 and bool(phrases))


def test_quality_verdict(spark):
    good = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(60)) + "."
    words = " ".join(f"salad{i}" for i in range(70))
    texts = [
        good, good + "\nAll rights reserved.", f"{good}\n{words}", f"{good}\nHome | News | About", f"{words}\n{good}\r", good + "\n" + "x$ y# z " * 25,
        f"{good}\nhttp://a.example/b www.example.com/c", f"{good}\nAlle Rechte vorbehalten", f"{good}\n\n \nTous droits réservés\nend",
        words.replace("salad9", "salad9,"), "short", None, good.replace(".", "。"),
    ]
    odd = [(None, good + "\nread more"), (0, good)]
    df = spark.createDataFrame([*enumerate(texts), *odd], "doc_id long, text string").withColumns({
        "at": F.lit("mine"), "ws": F.lit(7), "_hashes": F.lit("h"), "_q_hint": F.lit("q"), "a.b": F.lit("dot"), "kept": F.lit("replaced"),
    })
    rows = quality.quality_rules(df).collect()
    assert len(rows) == len(texts) + 2 and all((r["at"], r.ws, r._hashes, r._q_hint, r["a.b"]) == ("mine", 7, "h", "q", "dot") for r in rows)
    for r in rows:
        lines = [(x, _bad_line(x), len(WORD.findall(x))) for x in (r.text or "").split("\n")]
        lost = sum(n for _, bad, n in lines if bad)
        assert r.lost_words == lost and r.kept == (not r.base_failed and 2 * lost <= r.n_words)
        assert r.clean_text == (None if r.text is None else "\n".join(x for x, bad, _ in lines if not bad))
    assert {r.doc_id: r.kept for r in rows if r.doc_id} | {0: True} == {i: i not in (2, 4, 5, 10, 11) for i in range(13)}


def test_chat(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "a\\<|b<\\|c\\\\" + control), (1, 1, "assis\ntant<\\n>", None), (1, 2, "assistant", control), (1, 3, "user", "bye"), (2, 0, None, "q"), (2, 0, None, "q"), (None, 1, "assistant", ""), (3, None, "assistant", "z" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_conversations(df)
    assert all(r.text.count(chat.START) == r.text.count(chat.END) for r in examples.collect())
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        assert [(t.role, t.text) for t in got[k].turns] == [(r[2] or "", r[3] or "") for r in group]
        assert list(got[k].replies) == [r[3] or "" for r in group if r[2] == "assistant"]
    digest = {r.conv_id: r for r in chat.chat_digest(examples).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(control.encode()).hexdigest() and digest[1].n_turns == 4
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 5000, 300_001])
def test_rans(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 50_257).astype(np.uint32)
    model = rans.Model.of_counts(np.bincount(ids, minlength=50_257) if n else np.zeros(4, int))
    blob = rans.encode_block(model, ids, [(7, n), (None, 0)], start=5)
    block, back = rans.decode_block(model, blob)
    assert (back == ids).all() and block["doc_ids"] == [7, None] and block["start"] == 5
    parts = [rans.decode_part(model, block, i) for i in reversed(range(len(block["states"])))]
    assert not n or (np.concatenate(parts[::-1]) == ids).all()
    if n:
        with pytest.raises(ValueError):
            rans.decode_block(model, blob[:-1] + bytes([blob[-1] ^ 1]))


def test_token_files(spark, docs, odd, none):
    path, at = tokenizer_path("byte_bpe_50k.json"), 0
    folder = token_files.write_token_files(spark, docs, path, block_tokens=500)
    # Another session needs the folder alone.
    got = {r.doc_id: r for r in token_files.read_token_files(spark.newSession(), folder).collect()}
    for i, t in enumerate(_texts()):
        ids = _ids(path, t, 0)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = sorted(((r.doc_id or 0), r.start, r.n_tokens) for r in token_files.read_token_files(spark, token_files.write_token_files(spark, odd, path)).collect())
    sizes = [len(_ids(path, t, 0)) for t in ("some words that are said again and again in here", "other text")]
    assert [r[0] for r in rows] == [0, 1, 1, 1, 2] and sorted(r[2] for r in rows) == sorted([sizes[0]] * 4 + [sizes[1]])
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(5)]
    assert token_files.read_token_files(spark, token_files.write_token_files(spark, none, path)).count() == 0
    as_text = {r.doc_id: r for r in token_files.read_token_files(spark, token_files.write_token_files(spark, docs, path, special_as_text=True)).collect()}
    assert all(r.n_tokens == len(_ids(path, _texts()[i], 0, True)) for i, r in as_text.items())


def test_rows_without_an_id_are_dealt_over_all_parts(spark, tmp_path):
    """Nine of ten rows have no doc_id, and a third of all are equal; the files hold the rows in the order of ids and whole."""
    rng = random.Random(2)
    texts = ["the same text again"] * 300 + [" ".join(rng.choices(["a", "bc", "def", "The"], k=6)) for _ in range(600)]
    rows = [(None if i % 10 else i, t) for i, t in enumerate(texts)]
    path = tokenizer_path("byte_bpe_50k.json")
    folder = token_files.write_token_files(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, store_bytes=1 << 14)
    parts = [r["sum(tokens)"] for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").sum("tokens").collect()]
    assert len(parts) == 4 and max(parts) < 0.4 * sum(parts)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    crc = lambda t: zlib.crc32(_ids(path, t, 0).tobytes())
    assert Counter((r[0], r[3]) for r in got) == Counter((i, crc(t)) for i, t in rows)


def test_unknown_vocabularies_go_to_the_library(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    from kgalign.llm.token_ids import WordIds

    rules = json.loads(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read())
    rules["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    library, own = Tokenizer.from_file(str(path)), WordIds(str(path))
    for t in ("plain words here", "a  b\nc", "", None):
        assert own.encode(t) == np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert own.encode("plain words") != WordIds(tokenizer_path("byte_bpe_50k.json")).encode("plain words")
    assert token_files._id_type(1 << 16) == "<u2" and token_files._id_type((1 << 16) + 1) == "<u4"
    wide = np.array([0, 99_999, 70_000, 0], dtype=np.uint32)
    model = rans.Model.of_counts(np.bincount(wide, minlength=400_000))
    assert model.bits == 20 and (rans.decode_block(model, rans.encode_block(model, wide, [(1, 4)]))[1] == wide).all()
    # States that floating-point numbers don't hold.
    widest = np.arange(0, 1 << 21, 700, dtype=np.uint32)
    model = rans.Model.of_counts(np.bincount(widest, minlength=1 << 21))
    assert model.bits == 23 and (rans.decode_block(model, rans.encode_block(model, widest, [(1, len(widest))]))[1] == widest).all()


def test_packing(spark, docs, odd, none):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack_documents(spark, docs, path, capacity=64).collect()
    for i, t in enumerate(_texts()):
        ids, at = _ids(path, t, 1), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            part = ids[at : at + r.length].tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(part), part)
            at += r.length
        assert at == len(ids)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in group:
            assert r.offset == end
            end += r.length
        assert end <= 64
    got = Counter((r.doc_id, r.start, r.length) for r in packing.pack_documents(spark, odd, path).collect())
    sizes = [len(_ids(path, t, 1)) for t in ("some words that are said again and again in here", "other text")]
    assert sum(n * k for (_, _, n), k in got.items()) == 4 * sizes[0] + sizes[1] and {i for i, _, _ in got} == {1, 2, None}
    assert packing.pack_documents(spark, none, path).count() == 0


def test_packing_wastes_little(spark):
    """Each sequence is full, a power of two, or a bin of its class: the class's number of pieces, a few tokens of padding for each."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "the", "of"], k=min(3000, int(rng.paretovariate(0.8) * 9)))) for _ in range(1500)]
    rows = packing.pack_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), tokenizer_path("word_bpe_49k.json"), capacity=256).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert sorted(bins) == list(range(len(bins)))
    padding = classes = 0
    for lengths in bins.values():
        total, k = sum(lengths), 256 // max(lengths)
        if total == 256 or total & (total - 1) == 0:
            continue
        assert all(256 // n == k for n in lengths) and len(lengths) == k and 256 - total <= packing.SLACK * k
        padding, classes = padding + 256 - total, classes + 1
    assert classes > 20 and padding < 0.03 * 256 * len(bins) and 256 * len(bins) < 1.04 * sum(r.length for r in rows)


def test_control_strings_as_in_the_library(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "a <|startoftext|> b", "<|EndOfText|>", "x\n<|endoftext|><|endoftext|>y <|startoftext|>", "plain words", "<|endoftext|", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda name, end: [[*Tokenizer.from_file(tokenizer_path(name)).encode(t or "", add_special_tokens=False).ids, end] for t in texts]
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    want = ids("byte_bpe_50k.json", 0)
    got = {r.doc_id: r for r in queries()["op3_token_files"](spark, str(tmp_path)).collect()}
    assert [(got[i].n_tokens, got[i].ids_crc32) for i in range(len(texts))] == [(len(x), crc(x)) for x in want]
    assert [got[i].start for i in range(len(texts))] == [sum(map(len, want[:i])) for i in range(len(texts))]
    want = ids("word_bpe_49k.json", 1)
    for rows in (queries()["op9_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        rows = rows.collect()
        assert all((r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), crc(want[r.doc_id][r.start : r.start + r.length])) for r in rows)
        assert sum(r.length for r in rows) == sum(map(len, want))


def test_cut_lengths():
    for n in range(1, 5000, 7):
        cut = packing.cut_lengths(n, 2048, 8)
        assert sum(length for length, _ in cut) == n and all(length * k <= 2048 for length, k in cut)


def test_token_counts(spark, docs, odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    initial, later = token_counts.byte_level_pieces(path)

    def brute(word, first, rest):
        n = i = 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if word[i:j] in (rest if i else first)), i)
            if j == i:
                return 1
            n, i = n + 1, j
        return n

    for r in token_counts.count_tokens(spark, docs, path).collect():
        words = (_texts()[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(brute(w, initial, later) for w in words))
    assert token_counts.count_tokens(spark, none, path).count() == 0
    text = "some words that are said again and again in here"
    got = Counter((r.doc_id, r.n_words, r.source, r.key) for r in token_counts.count_tokens(spark, odd, path).collect())
    assert got == Counter({(1, 10, "s", ""): 2, (1, 2, "s", ""): 1, (None, 10, None, ""): 1, (2, 10, None, ""): 1}) and len(text.split()) == 10
    rng = random.Random(1)
    for _ in range(500):
        first, rest = ({bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(4)} for _ in range(2))
        word = bytes(rng.choices(b"abc", [5, 5, 1], k=rng.randint(1, 9)))
        assert token_counts.LongestMatch(first, rest).count(word) == brute(word, first, rest)


#: One level of cells, many cells, two levels.
@pytest.mark.parametrize("options", [{}, {"cell_rows": 4}, {"cell_rows": 4, "exact": True}, {"cell_rows": 2, "max_cells": 3, "exact": True}])
def test_embeddings(spark, options):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[20:40] = x[:20] + rng.normal(size=(20, 8)) * 0.12
    x[40:45] = x[0]
    rows = [(i, [float(v) for v in row], i % 2 if i < 40 else 0) for i, row in enumerate(x)]
    rows += [(60, None, 0), (61, [0.0] * 8, 0), (62, [None] * 8, 0), (63, [float("nan")] * 8, 0), (64, rows[0][1], None), (65, [1.0, 2.0], 0), (66, [2.0, 4.0], 0), (67, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"coarse": F.lit("clash"), "cid": F.lit(1)})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = lambda i, j: i < 60 and j < 60 and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98
    linked = lambda i, j: i != j and ({i, j} == {65, 66} or near(i, j))
    want = _smallest(68, linked)
    for r in embeddings.near_vectors(spark, df, **options).collect():
        i = r.vec_id
        assert (r.n_links, r.component_id, r.kept) == (sum(linked(i, j) for j in range(68)), want[i], want[i] == i)
    assert embeddings.near_vectors(spark, df.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.01], 0), (None, [0.01, 1.0], 0), (None, [-1.0, 0.0], 0), (7, [1.0, 0.02], 0)]
    got = Counter(tuple(r) for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter({(1, 3, 1, True): 2, (1, 1, 1, True): 1, (None, 3, 1, False): 1, (None, 1, 1, False): 1, (None, 0, None, False): 1, (7, 3, 1, False): 1})


@pytest.mark.parametrize("n", [2, 500])
def test_cells_are_trained_at_any_size(spark, n, monkeypatch):
    seen, train = [], embeddings.train_cells
    monkeypatch.setattr(embeddings, "train_cells", lambda *a, **b: seen.append(train(*a, **b)) or seen[-1])
    x = np.random.default_rng(n).normal(size=(n, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert embeddings.near_vectors(spark, rows).count() == n
    assert [c[0].shape for c in seen[0].values()] == [(2, 16)] and np.allclose(np.linalg.norm(seen[0][16][0], axis=1), 1)


def test_recall_of_the_default_margin(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.normal(size=(600, 64))
    step -= (step * x).sum(axis=1, keepdims=True) * x
    y = x * 0.981 + step / np.linalg.norm(step, axis=1, keepdims=True) * (1 - 0.981**2) ** 0.5  # just above the threshold
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.concatenate((x, y)))]
    got = embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_rows=20)
    assert got.where("n_links = 1").count() == 1200  # all of 600 planted pairs, in 60 cells


def _spectrum(rng, n, kind):
    """Unit vectors of 64 dimensions, and how their near copies differ."""
    if isinstance(kind, int):
        basis = np.linalg.qr(rng.normal(size=(64, kind)))[0].T
        draw = lambda m: rng.normal(size=(m, kind)) @ basis
    else:
        scale = np.arange(1, 65) ** -0.75 if kind == "power" else np.ones(64)
        draw = lambda m: rng.normal(size=(m, 64)) * scale
    return draw(n), draw


@pytest.mark.parametrize("kind", [2, 3, 6, "power", "alike"])
def test_recall_follows_the_spread_of_the_data(spark, kind):
    """Links found by the default margin, of vectors on a plane, in few dimensions, of a falling spectrum and without one; pairs are planted with differences like the data's."""
    rng = np.random.default_rng(12)
    n = 1500
    x, draw = _spectrum(rng, n, kind)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = draw(n)
    step -= (step * x).sum(axis=1, keepdims=True) * x
    y = x * 0.9805 + step / np.linalg.norm(step, axis=1, keepdims=True) * (1 - 0.9805**2) ** 0.5
    v = np.concatenate((x, y))
    rows = spark.createDataFrame([(i, [float(t) for t in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, rows, cell_rows=60).collect()}
    found = np.array([got[i].n_links for i in range(2 * n)])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.999 * linked.sum() >= 0.999 * 2 * n


def test_many_lengths_of_vectors(spark):
    """More lengths than have broadcast centroids, and one of them in two levels."""
    rng = np.random.default_rng(13)
    rows, at = [], 0
    for dim, n in ((5, 90), (6, 40), *((d, 6) for d in range(7, 20))):
        x = rng.normal(size=(n, dim))
        x[n // 2 :] = x[: n - n // 2] * 3 + rng.normal(size=(n - n // 2, dim)) * 0.05
        rows += [(at + i, [float(v) for v in r], "s") for i, r in enumerate(x)]
        at += n
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    linked = lambda i, j: i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    want = _smallest(len(rows), linked)
    for options in ({"max_lengths": 2}, {"max_lengths": 2, "cell_rows": 4, "max_cells": 5}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark, df, exact=True, **options).collect()}
        assert got == {i: (sum(linked(i, j) for j in range(len(rows))), want[i]) for i in range(len(rows))}


def test_components_end_where_all_is_settled(spark):
    from kgalign.llm.common import Scratch, components

    n = 400
    order = list(range(n))
    random.Random(2).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1000), (2001, 2000), (2001, 2002)]
    got = components(Scratch(spark, "t"), spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(n)} | {2000: 2000, 2001: 2000, 2002: 2000} and len(got) == n + 3


def test_long_texts_are_hashed_by_chunks(monkeypatch):
    from kgalign.llm import shingles

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé ", k=rng.randint(1, 9))) for _ in range(4000)]
    texts = [" ".join(words), "\n" + "x" * 3000 + " y " + " ".join(words[:50]) + " " * 600, "z" * 2500, " " * 3000, "a b " + "q" * 1500, "ab" * 700 + " c d e f g"]
    whole = list(shingles.shingle_sets(texts))
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 500)
    assert all(len(x) == len(y) and (x == y).all() for x, y in zip(whole, shingles.shingle_sets(texts)))
    assert [len(s) for s in whole] == [len(s) for s in _sets(texts)]


def test_near_dedup_of_open_buckets_in_parts(spark, monkeypatch):
    """Strangers that share buckets with a large group, in blocks of few rows: groups are whole, and no stranger joins."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(50):
        w = list(base)
        for _ in range(2 if i < 30 else rng.randint(3, 7)):
            w[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = _sets(texts)
    want = _smallest(len(sets), lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(set(want)) > 1 and {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, rows).collect()} == dict(enumerate(want))


def test_crowds_made_from_a_template_meet_by_rare_shingles(spark, monkeypatch):
    """Thousands of texts at similarity 0.6 in common buckets, among them pairs that are near: few rows are made, and no link is lost."""
    from kgalign.llm.common import Scratch

    monkeypatch.setattr(near_dedup, "CROWD", 40)
    rng = random.Random(12)
    template, texts = [f"t{i}" for i in range(60)], []
    for i in range(2500):
        own = [f"o{rng.randrange(10**7)}" for _ in range(16)]
        texts.append(template + own)
        if i % 10 == 0:  # a near copy: a few of its own words differ
            texts.append(template + own[:11] + [f"c{rng.randrange(10**7)}" for _ in range(5)] if i % 20 else template + own[:1] + ["x"] + own[2:])
    texts = [" ".join(t) for t in texts]
    made, save = {}, Scratch.save

    def told(self, df, name, *by):
        out = save(self, df, name, *by)
        made[name] = out
        return out

    monkeypatch.setattr(Scratch, "save", told)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert made["members"].count() > 1000  # the buckets are crowded
    assert made["crowd"].count() < 20 * len(texts)
    sets, holds = _sets(texts), {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    near = [(h[k], h[m]) for h in holds.values() if 1 < len(h) < 100 for m in range(len(h)) for k in range(m)]
    want = list(range(len(sets)))
    for i, j in sorted(set(near)):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            want[j] = want[i]
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts) - 100


def test_sharding_cuts_few_links(spark):
    """Cut links before (by hash) and after propagation, of groups far smaller than a shard."""
    rng = random.Random(1)
    rows = [(i, f"group {rng.randrange(60)}" if i < 300 else f"own {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    started = {r.doc_id: r.s for r in df.select("doc_id", sharding._start("doc_id", 6).alias("s")).collect()}
    placed = {r.doc_id: r["shard"] for r in sharding.shard_documents(spark, df, shards=6).collect()}
    text = dict(rows)
    cut = lambda where: sum(where[i] != where[j] for i in range(300) for j in range(i) if text[i] == text[j])
    assert cut(placed) * 5 < cut(started) and set(Counter(placed.values()).values()) == {150}


def test_hot_keys_are_split(spark, monkeypatch):
    """Joins of rows with a hot key, as they ran: the partition that has it is read by several tasks."""
    from kgalign.llm.common import Scratch

    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    old, plans, save = {k: spark.conf.get(k) for k in small}, {}, Scratch.save

    def told(self, df, name, *by):
        if name == "links":
            df.collect()
            plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name, *by)

    monkeypatch.setattr(Scratch, "save", told)
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        copies = spark.createDataFrame([(i, "the hot text" if i < 6000 else f"text {i // 2}") for i in range(12000)], "doc_id long, text string").repartition(8)
        sharding.shard_documents(spark, copies, shards=4, rounds=1)
        assert "SortMergeJoin(skew=true)" in plans["links"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_chat_ignores_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "y")], "conv_id long, turn long, role string, text string, turns string")
    assert [r.loss_chars for r in chat.chat_digest(chat.format_conversations(rows)).collect()] == [1]


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string"


def _pipeline_docs(spark):
    prose = lambda k: " ".join(f"{k}word{i}" + ("." if i % 9 == 8 else "") for i in range(70)) + "."
    a, b, shared = prose("a"), prose("b"), "A line that many documents hold in common."
    texts = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, None), (4, ""), (5, "too short"), *((10 + i, f"{prose(f'c{i}')}\n{shared}") for i in range(4))]
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", 0, "clash", "clash") for i, t in texts], PIPELINE_SCHEMA)


def test_pipeline_stages_with_odd_rows(spark):
    """Nulls, repeated ids and rows, ties and clashing names; each stage on what it is given."""
    import corpus_pipeline as p

    docs = _pipeline_docs(spark)
    got = p.quality(spark, docs, "")
    assert got.columns == p.COLUMNS and Counter(r.doc_id for r in got.collect()) == Counter({1: 2, 2: 1, None: 2, **{10 + i: 1 for i in range(4)}})
    lines = {r.doc_id: r.text for r in p.lines(spark, docs.where("doc_id >= 10"), "").collect()}
    assert {i for i, t in lines.items() if "in common" in t} == {13} and set(lines) == {10, 11, 12, 13}
    near = p.near(spark, docs, "")
    assert near.columns == p.COLUMNS and Counter(r.doc_id for r in near.collect()) == Counter({1: 1, None: 1, 3: 1, 4: 1, 5: 1, **{10 + i: 1 for i in range(4)}})
    mixed = p.mix(spark, docs, "")
    assert mixed.columns == p.COLUMNS and {r.doc_id for r in mixed.collect()} <= {1, 2, None, 5, 10, 11, 12, 13}
    packed = p.pack(spark, docs, "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_stages_with_empty_tables(spark):
    import corpus_pipeline as p

    none = _pipeline_docs(spark).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, rows = spark.read.parquet(f"{DATA}/documents.parquet"), []
    clean = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        rows.append(docs)
    quality_ids, line_rows, near_rows = ([r.asDict() for r in d.collect()] for d in rows[:3])
    assert {r["doc_id"] for r in quality_ids} <= set(clean.index)
    sets = _sets([r["text"] for r in line_rows])
    want = _smallest(len(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    order = [r["doc_id"] for r in line_rows]
    groups = {}
    for i, g in enumerate(want):
        groups.setdefault(g, []).append(order[i])
    assert {r["doc_id"] for r in near_rows} == {min(g) for g in groups.values()}
    path, tokens = tokenizer_path("word_bpe_49k.json"), Counter()
    for r in rows[3].collect():
        tokens[r.doc_id] += len(_ids(path, r.text, 1))
    assert tokens == sum((Counter({r.doc_id: r.length}) for r in rows[4].collect()), Counter())


def test_names():
    assert {f"op{i}" for i in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in queries()}
