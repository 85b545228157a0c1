"""Sets of word shingles of whole texts, as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
#: Texts are hashed together up to so many bytes; a longer text is hashed alone, by chunks.
CHUNK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1, 2**63, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (murmur's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Powers of the base and of its inverse, for places in a chunk.
_UP, _DOWN = np.full(CHUNK_BYTES + 1, _BASE), np.full(CHUNK_BYTES + 1, _BASE_INVERSE)
_UP[0] = _DOWN[0] = 1
_UP, _DOWN = np.multiply.accumulate(_UP), np.multiply.accumulate(_DOWN)


def _word_hashes(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of each word of a chunk that ends in white space."""
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[joined] * _UP[: len(joined)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)), starts


def _huge_word(data: np.ndarray) -> np.ndarray:
    """The same hash of one word that is longer than a chunk, part by part."""
    total = np.uint64(0)
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        total += (_BYTE[part] * _UP[: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(int(_BASE), at, 1 << 64))
    return mix(np.array([total + np.uint64(len(data))], dtype=np.uint64))


def _long_text_words(text: bytes) -> np.ndarray:
    """Word hashes of a text of more than a chunk, cut at white space: only these grow with it."""
    data, out, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(data):
        part = data[at : at + CHUNK_BYTES - 1]
        last = np.flatnonzero(_SPACE[part])
        if at + len(part) == len(data):
            out.append(_word_hashes(np.append(part, np.uint8(10)).astype(np.uint8))[0])
            break
        if len(last):
            out.append(_word_hashes(part[: int(last[-1]) + 1])[0])
            at += int(last[-1]) + 1
            continue
        end = at + len(part)
        while end < len(data) and not len(last := np.flatnonzero(_SPACE[data[end : end + CHUNK_BYTES]])):
            end += CHUNK_BYTES
        end = min(len(data), end + (int(last[0]) if len(last) else 0))
        out.append(_huge_word(data[at:end]))
        at = end
    return np.concatenate(out)


def _mixed_windows(words: np.ndarray) -> np.ndarray:
    w = SHINGLE_WORDS
    n = max(0, len(words) - w + 1)
    windows = words[:n] * _PLACE[0]
    for j in range(1, w):
        windows += words[j : j + n] * _PLACE[j]
    return mix(windows)


def _set(words: np.ndarray) -> np.ndarray:
    """The set of a text of so many words: its windows, or the whole sequence where it is shorter."""
    w, step = SHINGLE_WORDS, 1 << 16
    if len(words) >= w:
        out = np.concatenate([_mixed_windows(words[i : i + step + w - 1]) for i in range(0, len(words) - w + 1, step)])
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    whole = np.uint64(len(words)) * _PLACE[w]
    for j, x in enumerate(words):
        whole = whole + x * _PLACE[j]
    return mix(np.array([whole], dtype=np.uint64))


def _chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    words, starts = _word_hashes(np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    windows = _mixed_windows(words)
    return [np.unique(windows[a : b - SHINGLE_WORDS + 1]) if b - a >= SHINGLE_WORDS else _set(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of each text: distinct 5-word shingles, or the whole sequence where there are fewer words."""
    chunk, size = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            data = (text or "").encode()
            if chunk and size + len(data) + 1 > CHUNK_BYTES:
                yield from _chunk_sets(chunk)
                chunk, size = [], 0
            if len(data) >= CHUNK_BYTES:
                yield _set(_long_text_words(data.lower()))
                continue
            chunk.append(data)
            size += len(data) + 1
        if chunk:
            yield from _chunk_sets(chunk)


def word_keys(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's words, A-Z lower-cased, in order."""
    chunk, size = [], 0

    def hashed():
        words, starts = _word_hashes(np.frombuffer(b"\n".join(chunk).lower() + b"\n", dtype=np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in chunk)])).tolist()
        return [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    with np.errstate(over="ignore"):
        for text in texts:
            data = (text or "").encode()
            if chunk and size + len(data) + 1 > CHUNK_BYTES:
                yield from hashed()
                chunk, size = [], 0
            if len(data) >= CHUNK_BYTES:
                yield _long_text_words(data.lower())
                continue
            chunk.append(data)
            size += len(data) + 1
        if chunk:
            yield from hashed()
