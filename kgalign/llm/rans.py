"""Static range asymmetric numeral system for token ids, in numpy.

A block is coded by many interleaved lanes: token ``t`` belongs to lane
``t % lanes``. Each lane has a 64-bit state and gives off 32-bit words. The
encoder works from the end to the beginning, the decoder forwards. States stay below
2**53 for all but the largest vocabularies, so that the encoder can divide them as
floating-point numbers, which is exact there and several times as fast.

Layout of a block (little-endian):
  magic ``TRB1`` | u32 lanes, steps between checkpoints, checkpoints, documents |
  u64 tokens, words, start (ids of the part before the block) |
  u32 crc32 of all that follows | u32 crc32 of the ids as 32-bit integers |
  i64 doc_id, u8 1 if it is null, u32 tokens, for each document |
  u64 states at the block's start, by lane |
  for each checkpoint: u64 words read before it, u64 states by lane |
  u32 words
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TRB1"
HEAD = struct.Struct("<4sIIIIQQQII")
#: Bits of a frequency table's sum: of small vocabularies; larger ones have one more than their ids need.
SCALE_BITS = 18
LANES = 4096
CHECKPOINT_STEPS = 128
#: A state is at least ``2**LOW_BITS`` between two ids, or ``2**bits`` of a frequency table with more; a word makes room above.
LOW_BITS = 21
WORD_BITS = 32


class Model:
    """A frequency table shared by all blocks: ``freq`` of each id, summing to ``2**bits``."""

    def __init__(self, freq: np.ndarray):
        self.bits = int(freq.sum()).bit_length() - 1
        self.low_bits = max(LOW_BITS, self.bits)
        self.freq = freq.astype(np.int64)
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.freq)[:-1]))
        self.symbol = np.repeat(np.arange(len(freq)), self.freq)
        self.number = np.float64 if self.low_bits + WORD_BITS <= 53 else np.uint64

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        """Counts scaled to the table's sum; each id that occurs gets 1 at least."""
        total, size = max(1, int(counts.sum())), 1 << max(SCALE_BITS, len(counts).bit_length() + 1)
        seen = counts > 0
        spare = size - int(seen.sum())
        freq = np.where(seen, 1 + (counts.astype(np.float64) * spare / total).astype(np.int64), 0)
        if seen.any():
            freq[np.argmax(counts)] += size - freq.sum()
        else:
            freq[0] = size
        return cls(freq)


def _quotient(x: np.ndarray, by) -> np.ndarray:
    return np.floor(x / by) if x.dtype == np.float64 else x // by


def encode_block(model: Model, ids: np.ndarray, docs: list[tuple[int | None, int]], start: int = 0, lanes: int = LANES) -> bytes:
    """One block; ``docs`` are ``(doc_id, tokens)`` in order."""
    n, number = len(ids), model.number
    lanes = max(1, min(lanes, n // 128))  # a short block has few states to hold
    state = np.full(lanes, 1 << model.low_bits, dtype=number)
    size, word, room = number(1 << model.bits), number(1 << WORD_BITS), number(1 << (model.low_bits + WORD_BITS - model.bits))
    freq, first, at = model.freq.astype(number), model.start.astype(number), ids.astype(np.intp)
    out, written, marks = [], 0, []
    for step in range(-(-n // lanes) - 1, -1, -1):
        s = at[step * lanes : (step + 1) * lanes]
        f, x = freq.take(s), state[: len(s)]
        full = np.flatnonzero(x >= f * room)
        if len(full):
            high = _quotient(x[full], word)
            out.append((x[full] - high * word).astype(np.uint32))
            written += len(full)
            x[full] = high
        x += _quotient(x, f) * (size - f) + first.take(s)
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((written, state.astype(np.uint64)))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    points = b"".join(struct.pack("<Q", len(words) - w) + s.tobytes() for w, s in marks[::-1])
    index = np.array([0 if d is None else d for d, _ in docs], dtype="<i8").tobytes() + np.array([d is None for d, _ in docs], dtype=np.uint8).tobytes()
    index += np.array([c for _, c in docs], dtype="<u4").tobytes()
    body = index + state.astype(np.uint64).tobytes() + points + words.tobytes()
    head = HEAD.pack(MAGIC, lanes, CHECKPOINT_STEPS, len(marks), len(docs), n, len(words), start, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + body


def read_block(blob: bytes) -> dict:
    """Header fields and parts of a block, after its checksum."""
    magic, lanes, every, points, docs, n, words, start, crc, ids_crc = HEAD.unpack_from(blob)
    if magic != MAGIC or zlib.crc32(memoryview(blob)[HEAD.size :]) != crc:
        raise ValueError("damaged block")
    at = HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", docs, at)
    nulls = np.frombuffer(blob, np.uint8, docs, at + 8 * docs).astype(bool)
    sizes = np.frombuffer(blob, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    states = [(0, np.frombuffer(blob, "<u8", lanes, at))]
    at += 8 * lanes
    for _ in range(points):
        states.append((struct.unpack_from("<Q", blob, at)[0], np.frombuffer(blob, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    return {
        "lanes": lanes, "every": every, "n": n, "start": start, "ids_crc": ids_crc, "doc_ids": [None if z else int(d) for d, z in zip(doc_ids, nulls)],
        "sizes": sizes, "states": states, "words": np.frombuffer(blob, "<u4", words, at),
    }


def decode_part(model: Model, block: dict, part: int) -> np.ndarray:
    """The ids between checkpoint ``part`` (0: the start) and the next one; parts can be decoded in any order."""
    at, first = block["states"][part]
    state, lanes, n, words = first.astype(np.int64), block["lanes"], block["n"], block["words"]
    low = part * block["every"]
    high = low + block["every"] if part + 1 < len(block["states"]) else -(-n // lanes)
    out = np.empty(min(n, high * lanes) - low * lanes, dtype=np.uint32)
    bits, mask, least = model.bits, (1 << model.bits) - 1, 1 << model.low_bits
    for step in range(low, high):
        width = min(lanes, n - step * lanes)
        x = state[:width]
        slot = x & mask
        s = model.symbol.take(slot)
        out[(step - low) * lanes : (step - low) * lanes + width] = s
        x >>= bits
        x *= model.freq.take(s)
        x += slot - model.start.take(s)
        need = np.flatnonzero(x < least)
        if k := len(need):
            x[need] = (x[need] << WORD_BITS) | words[at : at + k]
            at += k
    return out


def decode_block(model: Model, blob: bytes) -> tuple[dict, np.ndarray]:
    """A block and all its ids, checked."""
    block = read_block(blob)
    parts = [decode_part(model, block, i) for i in range(len(block["states"]))] if block["n"] else []
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != block["ids_crc"]:
        raise ValueError("ids differ from what was written")
    return block, ids
