"""Operator 6, token counts by a linear longest-match automaton.

A word's pieces are the longest initial piece, then again and again the longest
continuing piece. The automaton counts them in one pass over the word: its nodes
are the tries of initial and continuing pieces; a node that cannot go on has a
failure link, to the node that stands for the same letters after the pieces sure
to be cut off by then, and the number of these pieces. No piece is ever built.

Defined results: a null or empty text has no words; a word that no pieces cover
counts one token; repeated rows get equal counts; an empty table gives an empty
result; other columns are passed on, those with the names of the added columns
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Scratch, slices

#: Counts of words remembered by a worker; emptied when full.
MAX_WORDS = 400_000


class LongestMatch(dict):
    """Pieces of a word (bytes), by the automaton; as a dict: of the words met so far."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        # Nodes are numbers: 0 starts words, 1 goes on. An edge's key is node * 256 + byte.
        self.edges: dict[int, int] = {}
        ends, parents = {}, [(0, 0, -1), (0, 1, -1)]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for depth, letter in enumerate(piece, 1):
                    key = node << 8 | letter
                    if key not in self.edges:
                        self.edges[key] = len(parents)
                        parents.append((depth, node, letter))
                    node = self.edges[key]
                if piece:
                    ends[node] = True
        self.fail, self.popped = [-1] * len(parents), [0] * len(parents)
        for node in sorted(range(2, len(parents)), key=lambda v: parents[v][0]):
            _, parent, letter = parents[node]
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
                continue
            at, popped = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | letter) not in self.edges:
                popped += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.edges[at << 8 | letter], popped

    def count(self, word: bytes) -> int:
        """Number of pieces; 1 for a word that they don't cover."""
        edges, fail, popped, node, total = self.edges, self.fail, self.popped, 0, 0
        for letter in word:
            while (to := edges.get(node << 8 | letter)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node == 1 else 1

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = self.count(word)
        return n


def byte_level_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuing pieces from a byte-level vocabulary: those with a leading space start words."""
    from tokenizers import Tokenizer

    from .token_ids import byte_letters

    byte = {letter: b for b, letter in byte_letters().items()}
    pieces = [bytes(byte[c] for c in t) for t in Tokenizer.from_file(path).get_vocab(with_added_tokens=False) if all(c in byte for c in t)]
    single = {bytes([b]) for b in range(256)}
    return single | {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}, single | {p for p in pieces if p[:1] != b" "}


_loaded: dict[str, LongestMatch] = {}


def _count(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = LongestMatch(*byte_level_pieces(path))
        pieces = _loaded[path]
        for batch in slices(batches):
            columns = dict(zip(batch.schema.names, batch.columns))
            # split() of bytes cuts at the six ASCII spaces alone.
            words = [(t or "").encode().split() for t in columns["text"].to_pylist()]
            columns["n_words"] = pa.array(map(len, words), pa.int64())
            columns["n_tokens"] = pa.array([sum(map(pieces.__getitem__, w)) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs`` without its text, with ``n_words, n_tokens``."""
    Scratch(spark, "token_counts")  # workers find the package
    docs = docs.drop("n_words", "n_tokens")
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_count(vocabulary_path, schema.names), schema)
