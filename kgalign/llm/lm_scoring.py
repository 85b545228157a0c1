"""Operator 12, scores of texts by an n-gram model in a log-frequency Bloom filter.

The n-grams of all training texts are counted. A count is quantised to a level, about
log(count) to BASE, and a gram of level q is put in a Bloom filter as ``(gram, 1)`` to
``(gram, q)``. Its level is read back by probing ``(gram, 1)``, ``(gram, 2)``, ... up to the
first that is absent: the level found is never too low, and too high by each further step with
probability about 0.3 % (BITS for an entry, PROBES hashes). The score of a token mixes the counts of
its grams, each order smoothed by the shorter one:
``p_n = (c(gram) + STRENGTH * p_(n-1)) / (c(context) + STRENGTH)``, from
``p_1 = (c + 0.5) / (N + 0.5 (V + 1))`` on. The base score takes exact counts of tokens.

The filter is cut in parts by the grams' hashes, whose number follows the bytes of the texts, so that a part's
size doesn't. Grams are counted in tasks, then go to their part packed, many in a row; no gram is hot,
since a task sends it once for some millions. Where all parts together have at most MAX_BROADCAST bytes,
they are broadcast and texts are scored where they are read. Beyond that, as each worker would hold them all, each chunk of texts
sends its different grams to the parts, and gets their levels back where its texts, packed, come too: the same scores, without
anything whole anywhere.

Words are known by 64-bit hashes: among a billion different ones two are taken for one with probability 3 %.

Defined results: a null or empty text is its end token alone; a null doc_id is not held out, so it is
learned from; repeated rows are each learned from and scored; a long text is hashed, counted and scored in pieces of
PIECE tokens, whose sums are added, and needs 8 bytes for each of its words a few times; sums of logarithms may differ in
the last bits where pieces are added in another order; with no training texts all tokens are unknown;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import is_table
from .common import Scratch, slices

#: Length of the longest grams.
ORDER = 2
#: Counts of a level are within a factor of this.
BASE = 1.5
BITS, PROBES = 12, 8
#: Weight of the shorter gram's probability, as a count.
STRENGTH = 2.0
#: Bytes of text for each part of the model; the most bytes of a model that is broadcast.
PART_BYTES, MAX_BROADCAST = 8 << 20, 32 << 20
PIECE, FLUSH = 1 << 17, 1 << 22
#: Bytes of a gram's key beside its part.
KEY_BYTES = 5
_SEGMENT = "part int, bits binary, size long, top int, words binary, counts binary, tokens long"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def thresholds(base: float):
    """The least count of each level, from level 1 on, in whole numbers."""
    import numpy as np

    out, x = [], 1.0
    while x < 2**62:
        out.append(ceil(x))
        x *= base
    return np.unique(np.array(out, dtype=np.int64))


def expected_counts(base: float):
    """The count that each level stands for, from level 0 on: the middle of its counts."""
    import numpy as np

    least = thresholds(base)
    return np.concatenate(([0.0], (least[:-1] + least[1:] - 1) / 2, least[-1:].astype(np.float64)))


def _hashes(keys, level: int):
    """Where the probes of ``(key, level)`` start, and their step."""
    import numpy as np

    from .shingles import mix

    x = mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    return x, (x >> np.uint64(32)) | np.uint64(1)


def _place(x, step, i: int, size: int):
    """The bit of the i-th probe, by the low half of a sum."""
    import numpy as np

    return (((x + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def build_filter(keys, levels, bits_each: int = BITS) -> tuple[bytes, int, int]:
    """Bits, their number and the highest level of a Bloom filter of ``keys`` with ``levels``."""
    import numpy as np

    size = max(64, int(levels.sum()) * bits_each)
    if size >= 1 << 32:
        raise ValueError("a part of the model is too large: lower part_bytes")
    bits, top = np.zeros(size, dtype=bool), int(levels.max(initial=0))
    for level in range(1, top + 1):
        x, step = _hashes(keys[levels >= level], level)
        for i in range(PROBES):
            bits[_place(x, step, i, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes(), size, top


def probe(bits, size, top: int, keys, first=None):
    """The level of each key: probes of ``(key, 1)``, ``(key, 2)``, ... until one is absent.

    ``size`` is the filter's number of bits, or each key's own filter's, which then begin at the bits ``first``.
    """
    import numpy as np

    levels, alive = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys))
    for level in range(1, top + 1):
        x, step = _hashes(keys[alive], level)
        for i in range(PROBES):
            if first is None:
                at = _place(x, step, i, np.uint64(size))
            else:
                at = _place(x, step, i, size[alive]) + first[alive]
            there = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if not there.all():
                alive, x, step = alive[there], x[there], step[there]
        if not len(alive):
            break
        levels[alive] = level
    return levels


def exact_counts(words, counts, keys):
    """Counts of those keys that are among the sorted words, 0 for others."""
    import numpy as np

    if not len(words):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.searchsorted(words, keys)
    at[at == len(words)] = 0
    return np.where(words[at] == keys, counts[at], 0)


class Model:
    """Parts of the model: their filters one after the other, and the exact counts of all their words, in the order of keys."""

    def __init__(self, rows: list, parts: int):
        import numpy as np

        rows, self.parts = sorted(rows), parts  # by part, and a key's first bits are its part
        self.held, self.size = np.array([r[0] for r in rows], dtype=np.int32), np.array([r[2] for r in rows], dtype=np.uint64)
        self.first = np.cumsum([0, *(8 * len(r[1]) for r in rows)])[:-1].astype(np.uint64)
        self.bits, self.top = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8), max((r[3] for r in rows), default=0)
        self.words, self.counts = (np.frombuffer(b"".join(r[i] for r in rows), dtype=kind) for i, kind in ((4, "<u8"), (5, "<i8")))

    def levels(self, keys):
        import numpy as np

        out = np.zeros(len(keys), dtype=np.uint8)
        if len(self.held):
            part = part_of(keys, self.parts)
            at = np.minimum(np.searchsorted(self.held, part), len(self.held) - 1)
            there = self.held[at] == part
            out[there] = probe(self.bits, self.size[at[there]], self.top, short_keys(keys[there], self.parts), self.first[at[there]])
        return out

    def exact(self, keys):
        return exact_counts(self.words, self.counts, keys)


class Grams:
    """Keys of the grams of pieces of texts. A piece is its ``order - 1`` tokens before, or starts, and its own tokens."""

    def __init__(self, order: int, piece: int = PIECE):
        import numpy as np

        from .shingles import mix

        rng = np.random.Generator(np.random.PCG64(31))
        self.order, self.piece = order, piece
        self.start, self.end = mix(np.arange(1, 3, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.place = [rng.integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for m in range(order + 1)]

    def pieces(self, words) -> Iterator:
        """The sequence of a text, with its end, in pieces."""
        import numpy as np

        pad = self.order - 1
        whole = np.concatenate((np.full(pad, self.start, dtype=np.uint64), words, [self.end])).astype(np.uint64)
        for i in range(pad, len(whole), self.piece):
            yield whole[i - pad : i + self.piece]

    def keys(self, pieces: list) -> tuple[list, object]:
        """For each order the keys of the tokens' grams, and how many tokens each piece has."""
        import numpy as np

        from .shingles import mix

        pad, sizes = self.order - 1, np.array([len(p) for p in pieces], dtype=np.int64)
        line = np.concatenate(pieces)
        own = np.ones(len(line), dtype=bool)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for i in range(pad):
            own[first + i] = False
        at, out = np.flatnonzero(own), []
        with np.errstate(over="ignore"):
            for m in range(1, self.order + 1):
                if m == 1:
                    out.append(line[at])
                    continue
                total = np.zeros(len(at), dtype=np.uint64)
                for j in range(m):
                    total += line[at - (m - 1 - j)] * self.place[m][j]
                out.append(mix(total))
        return out, sizes - pad

    def contexts(self, pieces: list) -> list:
        """For each order but the last the key of the gram before a piece's first token, one for each piece."""
        import numpy as np

        from .shingles import mix

        pad, out = self.order - 1, []
        if not pad or not pieces:
            return out
        heads = np.stack([p[:pad] for p in pieces])
        with np.errstate(over="ignore"):
            for m in range(1, self.order):
                out.append(heads[:, -1] if m == 1 else mix(sum(heads[:, pad - m + j] * self.place[m][j] for j in range(m))))
        return out


def part_of(keys, parts: int):
    """A power of two ``parts``: the first bits of a key."""
    import numpy as np

    return (keys >> np.uint64(1) >> np.uint64(63 - (parts.bit_length() - 1))).astype(np.int32)


def short_keys(keys, parts: int):
    """The first bits of keys after those that tell their part: KEY_BYTES bytes, whatever the number of parts, so that few grams of a part look alike."""
    import numpy as np

    return (keys << np.uint64(parts.bit_length() - 1)) >> np.uint64(64 - 8 * KEY_BYTES)


def _packed(keys) -> bytes:
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes):
    import numpy as np

    out = np.zeros((len(data) // KEY_BYTES, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _gather(order: int, parts: int, piece: int):
    """Counts of the grams of texts, packed by part: ``part, words, keys, counts``; ``words`` says that these are tokens, and have whole keys; no counts are ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        grams, held, others, size = Grams(order, piece), [], [], 0

        def flush():
            rows = []
            for words, lists in ((True, held), (False, others)):
                if not lists:
                    continue
                keys, counts = np.unique(np.concatenate(lists), return_counts=True)
                for some in (counts == 1, counts > 1):
                    k, c = keys[some], counts[some].astype("<u4")
                    part, short = part_of(k, parts), short_keys(k, parts)
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(k) else [0]
                    rows += [(int(part[a]), words, k[a:b].tobytes() if words else _packed(short[a:b]), c[a:b].tobytes() if c[a] > 1 else None) for a, b in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "words", "keys", "counts"])

        for batch in slices(batches):
            for rows, pieces in _pieces(batch.column(0), grams):
                found, sizes = grams.keys(pieces)
                held.append(found[0]), others.extend(found[1:])
                # Before the first token of a text there are starts alone; a later piece's contexts are grams of the piece before.
                others.extend(x for x in grams.contexts([p for p in pieces if len(p) and (p[: order - 1] == grams.start).all()]) if len(x))
                size += int(sizes.sum()) * order
                if size >= FLUSH:
                    yield flush()
                    held, others, size = [], [], 0
        if held:
            yield flush()

    return run


def _fold(base: float, bits_each: int, parts: int):
    """A part's packed counts to its segment of the model."""

    def summed(keys, counts):
        import numpy as np

        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        words = table.column("words").to_numpy(zero_copy_only=False)
        sides = []
        for side in (words, ~words):
            rows = table.take(pa.array(np.flatnonzero(side)))
            packed, told = rows.column("keys").to_pylist(), rows.column("counts").to_pylist()
            keys = [np.frombuffer(k, dtype="<u8") if side is words else _unpacked(k) for k in packed]
            counts = [np.ones(len(k), dtype="<u4") if c is None else np.frombuffer(c, dtype="<u4") for k, c in zip(keys, told)]
            sides.append(summed(np.concatenate(keys or [np.zeros(0, "<u8")]), np.concatenate(counts or [np.zeros(0, "<u4")])))
        keys, counts = np.concatenate((short_keys(sides[0][0], parts), sides[1][0])), np.concatenate((sides[0][1], sides[1][1]))
        bits, size, top = build_filter(keys, np.searchsorted(thresholds(base), counts, side="right"), bits_each)
        row = [key[0].as_py(), bits, size, top, sides[0][0].tobytes(), sides[0][1].astype("<i8").tobytes(), int(sides[0][1].sum())]
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table({c.split(" ")[0]: pa.array([v], t) for c, v, t in zip(_SEGMENT.split(", "), row, types)})

    return run


def learn(scratch: Scratch, texts: DataFrame, order: int = ORDER, part_bytes: int = PART_BYTES, bits_each: int = BITS, piece: int = PIECE) -> tuple[DataFrame, int]:
    """The model of ``texts(text)`` as a table, one row for each part that has grams, and the number of parts."""
    n = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = 1 << max(0, ceil(n / part_bytes) - 1).bit_length()
    counts = texts.select("text").mapInArrow(_gather(order, parts, piece), "part int, words boolean, keys binary, counts binary")
    return scratch.save(counts.groupBy("part").applyInArrow(_fold(BASE, bits_each, parts), _SEGMENT), "model"), parts


class Needed:
    """The different keys of some pieces: ``words``, sorted, and ``grams`` of the higher orders; and where each token's are among them."""

    def __init__(self, grams: Grams, pieces: list):
        import numpy as np

        found, self.sizes = grams.keys(pieces)
        before = grams.contexts(pieces)
        unique, self.at, self.before = [], [], []
        for m, keys in enumerate(found):
            ctx = before[m] if m < len(before) else keys[:0]
            held, at = np.unique(np.concatenate((keys, ctx)), return_inverse=True)
            unique.append(held), self.at.append(at[: len(keys)]), self.before.append(at[len(keys) :])
        self.words, self.orders = unique[0], [len(u) for u in unique[1:]]
        self.grams = np.concatenate(unique[1:] or [unique[0][:0]])

    def by_part(self, keys, parts: int):
        """The order of keys by part, the parts, and where each begins, with the end."""
        import numpy as np

        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, dtype=np.int64)
        return order, part[first], np.append(first, len(part))


class Scorer:
    """Scores of pieces from the levels and exact counts of their grams."""

    def __init__(self, order: int, tokens: int, distinct: int, piece: int = PIECE):
        self.grams, self.tokens, self.distinct, self.expected = Grams(order, piece), tokens, distinct, expected_counts(BASE)

    def scores(self, needed: Needed, exact, word_levels, gram_levels) -> tuple:
        """For each piece ``n_tokens, n_known, base, score``."""
        import numpy as np

        cut = np.cumsum(needed.orders)[:-1] if needed.orders else []
        counts = [self.expected[x] for x in (word_levels, *(np.split(gram_levels, cut) if needed.orders else []))]
        first = np.concatenate(([0], np.cumsum(needed.sizes)[:-1]))
        below = self.tokens + 0.5 * (self.distinct + 1)
        c, of = exact[needed.at[0]], [count[at] for count, at in zip(counts, needed.at)]
        p = (of[0] + 0.5) / below
        for n in range(1, len(of)):
            context = np.empty(len(p))
            context[1:] = of[n - 1][:-1]
            context[first] = counts[n - 1][needed.before[n - 1]]
            p = (np.minimum(of[n], context) + STRENGTH * p) / (context + STRENGTH)
        return needed.sizes, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10((c + 0.5) / below), first), np.add.reduceat(np.log10(p), first)


def _pieces(texts, grams: Grams, whole: bool = False) -> Iterator[tuple[list, list]]:
    """Groups of pieces of texts, of some PIECE tokens each, with the row of each piece; with ``whole`` groups end where texts do."""
    from .shingles import word_keys

    rows, pieces, size = [], [], 0
    for i, words in enumerate(word_keys(texts.to_pylist())):
        for piece in grams.pieces(words):
            if size >= grams.piece and not (whole and rows[-1] == i):
                yield rows, pieces
                rows, pieces, size = [], [], 0
            rows.append(i), pieces.append(piece)
            size += len(piece)
    if pieces:
        yield rows, pieces


_FOUND = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _found(ids, held, at: list, scores: list):
    """Sums over the pieces of each row; every row has one."""
    import numpy as np

    sums = [np.bincount(at, weights=np.concatenate(s), minlength=len(ids)) for s in zip(*scores)]
    columns = [ids, held, *(pa.array(s.astype(np.int64)) for s in sums[:2]), *map(pa.array, sums[2:])]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in _FOUND.split(", ")])


def _score_here(order: int, parts: int, shared, piece: int):
    """Scores of texts by the broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tokens, distinct = shared.value
        scorer, model = Scorer(order, tokens, distinct, piece), Model(rows, parts)
        for batch in slices(batches):
            at, scores = [], []
            for rows, pieces in _pieces(batch.column(2), scorer.grams):
                needed = Needed(scorer.grams, pieces)
                at += rows
                scores.append(scorer.scores(needed, model.exact(needed.words), model.levels(needed.words), model.levels(needed.grams)))
            if at:
                yield _found(batch.column(0), batch.column(1), at, scores)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[tuple]:
    """Texts in groups of some piece of tokens, or a long one alone: a number, the rows, and their pieces."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in slices(batches):
        for rows, pieces in _pieces(batch.column(2), grams, whole=True):
            yield number, batch.slice(rows[0], rows[-1] + 1 - rows[0]), pieces
            number += 1


def _ask(order: int, parts: int, piece: int):
    """The different keys of each chunk, for each part: ``chunk, part, words, grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(order, piece)
        for number, _, pieces in _chunks(batches, grams):
            needed, out = Needed(grams, pieces), {}
            for side, keys in enumerate((needed.words, needed.grams)):
                by, own, cut = needed.by_part(keys, parts)
                keys = keys[by]
                for p, a, b in zip(own.tolist(), cut[:-1], cut[1:]):
                    out.setdefault(p, [b"", b""])[side] = keys[a:b].tobytes() if side == 0 else _packed(short_keys(keys[a:b], parts))
            columns = [pa.array([number] * len(out), pa.int64()), pa.array(list(out), pa.int32()), *(pa.array([v[i] for v in out.values()], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "words", "grams"])

    return run


def _answer(parts: int):
    """What a part knows of the keys asked: ``chunk, part, exact, levels, grams``, counts and levels of words and levels of grams."""

    def run(key: tuple, asked: pa.Table, segments: pa.Table) -> pa.Table:
        import numpy as np

        part = segments.to_pylist()[0] if segments.num_rows else {"bits": b"", "size": 0, "top": 0, "words": b"", "counts": b""}
        bits, known, counts = (np.frombuffer(part[c], dtype=kind) for c, kind in (("bits", np.uint8), ("words", "<u8"), ("counts", "<i8")))
        # Chunks ask much the same; what several ask is looked up once.
        words, grams = (asked.column(c).to_pylist() for c in ("words", "grams"))
        keys, of_words = np.unique(np.frombuffer(b"".join(words), dtype="<u8"), return_inverse=True)
        short, of_grams = np.unique(_unpacked(b"".join(grams)), return_inverse=True)
        told = {
            "exact": (exact_counts(known, counts, keys).astype("<i8")[of_words], [len(w) // 8 for w in words]),
            "levels": (probe(bits, part["size"], part["top"], short_keys(keys, parts))[of_words], [len(w) // 8 for w in words]),
            "grams": (probe(bits, part["size"], part["top"], short)[of_grams], [len(g) // KEY_BYTES for g in grams]),
        }
        columns = {"chunk": asked.column("chunk"), "part": pa.array([key[0].as_py()] * len(words), pa.int32())}
        for name, (values, sizes) in told.items():
            data, cut = values.tobytes(), np.cumsum([0, *sizes]) * values.itemsize
            columns[name] = pa.array([data[i:j] for i, j in zip(cut, cut[1:])], pa.binary())
        return pa.table(columns)

    return run


def _told(order: int, piece: int):
    """The texts of each chunk again, packed: ``chunk, rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, rows, _ in _chunks(batches, Grams(order, piece)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())], names=["chunk", "rows"])

    return run


def _finish(order: int, parts: int, tokens: int, distinct: int, piece: int):
    """Scores of a chunk's texts from the answers of all parts."""

    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        scorer = Scorer(order, tokens, distinct, piece)
        rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(chunk.column("rows")[0].as_py())).read_all().combine_chunks()
        ids, held, texts = (rows.column(i).combine_chunks() for i in range(3))
        at, pieces = [], []
        for i, some in _pieces(texts, scorer.grams, whole=True):
            at += i
            pieces += some
        needed, answers = Needed(scorer.grams, pieces), answers.sort_by("part")
        exact, levels, found = (np.frombuffer(b"".join(answers.column(c).to_pylist()), dtype=kind) for c, kind in (("exact", "<i8"), ("levels", np.uint8), ("grams", np.uint8)))
        grams = np.empty(len(needed.grams), dtype=np.uint8)
        grams[needed.by_part(needed.grams, parts)[0]] = found
        return pa.Table.from_batches([_found(ids, held, at, [scorer.scores(needed, exact, levels, grams)])])

    return run


def score_texts(
    spark: SparkSession, docs: DataFrame, order: int = ORDER, part_bytes: int = PART_BYTES, max_broadcast: int = MAX_BROADCAST, held: Column | None = None,
    bits_each: int = BITS, piece: int = PIECE,
) -> DataFrame:
    """Rows ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one for each of ``docs(doc_id, text)``.

    ``held`` says which documents are not learned from; by default those whose crc32 of the doc_id leaves 1 by 5.
    """
    scratch = Scratch(spark, "lm")
    held = held_out(F.col("doc_id")) if held is None else F.coalesce(held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if not is_table(docs):  # chunks are made twice, and must be the same
        rows = scratch.save(rows, "texts")
    model, parts = learn(scratch, rows.where("not held_out"), order, part_bytes, bits_each, piece)
    size = model.agg(
        F.sum(F.length("bits") + F.length("words") + F.length("counts")).alias("bytes"), F.sum(F.length("words") / 8).cast("long").alias("distinct"), F.sum("tokens").alias("tokens")
    ).first()
    tokens, distinct = size["tokens"] or 0, size["distinct"] or 0
    if (size["bytes"] or 0) <= max_broadcast:
        shared = spark.sparkContext.broadcast(([tuple(r) for r in model.drop("tokens").collect()], tokens, distinct))  # at most max_broadcast bytes
        found = rows.mapInArrow(_score_here(order, parts, shared, piece), _FOUND)
    else:
        asked = rows.mapInArrow(_ask(order, parts, piece), "chunk long, part int, words binary, grams binary")
        answers = asked.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(_answer(parts), "chunk long, part int, exact binary, levels binary, grams binary")
        chunks = rows.mapInArrow(_told(order, piece), "chunk long, rows binary")
        found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(order, parts, tokens, distinct, piece), _FOUND)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
