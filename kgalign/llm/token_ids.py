"""Whole texts to token ids with a public tokenizer, remembering words.

``encode`` of the library is exact but slow, and texts repeat their words. A text
is cut where the tokenizer always cuts, and the ids of each piece are kept. A
text with characters or white space for which the cuts are not certain goes to
the library whole, and so do all texts of a vocabulary file with other rules than the
two kinds known here, so the result is the library's in any case. By default a
control string in a text is its one id, as in the library; with
``special_as_text`` it is encoded like any other text.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import attrgetter

#: Characters for which letters, digits and case are the same in every engine.
_SAFE = "\n\x20-\x7eÀ-ÖØ-öø-ÿ"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# English endings that are pieces of their own; the steps before the merges in the two kinds of files, as they say them.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_WORD_ENDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: A run of these after letters is one piece.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_id_of = attrgetter("id")
#: Bytes of a worker's stores, as a bound, and of an entry. A full store becomes the old one, of which what is met again is kept; words
#: and other pieces have one each, the second half as large: three times the entries of a store of words in all.
STORE_BYTES, ENTRY_BYTES = 336 << 20, 140


# The ranges of the byte-level alphabet.
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordIds(dict):
    """Ids (little-endian 32-bit) of texts; as a dict: of the pieces met so far."""

    def __init__(self, path: str, special_as_text: bool = False, store_bytes: int = STORE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        plain = rules["model"]["type"] == "BPE" and not (rules["post_processor"] or rules["truncation"] or rules["padding"])
        rules = {k: rules[k] for k in ("normalizer", "pre_tokenizer")} if plain else None
        self.tokenizer.encode_special_tokens = special_as_text
        # Added tokens are found before a text is cut, some of them in the normalized text.
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        case = re.IGNORECASE if any(t.normalized for t in added) else 0
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)", case).search
        self.tokenize = self.tokenizer.model.tokenize
        letters = byte_letters()
        self.bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.space, self.line = self.bytes[ord(" ")], self.bytes[ord("\n")]
        self.lower = rules == _WORD_ENDS
        self.safe = re.compile(f"[{_SAFE}]*" if rules in (_BYTE_LEVEL, _WORD_ENDS) else "").fullmatch
        if self.lower:  # white space is dropped; single digits
            self.pieces = re.compile(f"{_CONTRACTIONS}|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+").findall
        else:  # a space goes with what follows
            self.pieces = re.compile(f"{_CONTRACTIONS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+").findall
        self.most = max(2, store_bytes // (3 * ENTRY_BYTES))
        self.short: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_short: dict[str, bytes] = {}

    def _merged(self, piece: str) -> bytes:
        letters = piece.replace(" ", self.space).replace("\n", self.line) if piece.isascii() else piece.translate(self.bytes)
        return array("I", map(_id_of, self.tokenize(letters))).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.short.get(piece)
        if ids is None:
            # Letters that are known as a word stand in the larger store alone.
            word = piece if self.lower else piece[1:] if piece[0] == " " else ""
            if word.isalpha() and (ids := self.get(word)) is not None:
                return ids
            if len(self.short) >= self.most // 2:
                self.old_short, self.short = self.short, {}
            ids = self.old_short.get(piece)
            self.short[piece] = ids = self._merged(piece) if ids is None else ids
        return ids

    def __missing__(self, word: str) -> bytes:
        """Ids of a word with the space before it, where the tokenizer keeps spaces."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None and word.isalpha():  # letters alone are one piece
            letters = word if word.isascii() else word.translate(self.bytes)
            ids = array("I", map(_id_of, self.tokenize(letters if self.lower else self.space + letters))).tobytes()
        elif ids is None and (letters := word.rstrip(_MARKS)).isalpha():  # and the marks after them are another
            ids = self[letters] + self._piece(word[len(letters) :])
        elif ids is None:
            ids = b"".join(map(self._piece, self.pieces(word if self.lower or word[:1] == "\n" else " " + word)))
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.safe(text) or self.added(text):
            return self.whole(text)
        if self.lower:
            return b"".join(map(self.__getitem__, text.lower().replace("\n", " ").split(" ")))
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return b"".join(map(self._piece, self.pieces(text)))
        # Single white space between words: a line break is a piece of its own, a space goes with the next word.
        words = text.replace("\n", " \n").split(" ")
        return b"".join(map(self._piece, self.pieces(words[0]))) + b"".join(map(self.__getitem__, words[1:]))


_loaded: dict[tuple, WordIds] = {}


def word_ids(path: str, special_as_text: bool = False, store_bytes: int = STORE_BYTES) -> WordIds:
    """One for each worker process, file, treatment of control strings and size."""
    key = (path, special_as_text, store_bytes)
    if key not in _loaded:
        _loaded[key] = WordIds(*key)
    return _loaded[key]
