"""Words of whole texts in one pass over the bytes of a batch, and hashes of their bytes.

A word is a maximal run of ``0-9``, ``a-z`` and characters beyond ASCII, after A-Z alone
are lower-cased. All bytes of a character beyond ASCII are 128 or more, so the runs of
such bytes are the runs of such characters.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import xxhash

CODES = np.arange(256, dtype=np.uint8)
UPPER = (CODES >= 65) & (CODES <= 90)
LOWERED = np.where(UPPER, CODES + 32, CODES).astype(np.uint8)
IN_WORD = (CODES >= 128) | ((LOWERED >= 97) & (LOWERED <= 122)) | ((CODES >= 48) & (CODES <= 57))
# Longer words are hashed one by one.
LONG_WORD = 48
SPACE = 32


class Words(NamedTuple):
    """``text``: all words, a blank after each. ``first[i]`` to ``first[i + 1]`` are the words of text ``i``."""

    text: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()


def words_of(flat: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts ``flat[offsets[i]:offsets[i + 1]]``; no word crosses two texts."""
    inside = IN_WORD[flat]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(flat))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    text = np.empty(int(sizes.sum()) + len(sizes), np.uint8)
    after = np.cumsum(sizes + 1)
    blank = np.zeros(len(text), bool)
    blank[after - 1] = True
    text[~blank] = LOWERED[flat[inside]]
    text[blank] = SPACE
    return Words(text, after - sizes - 1, sizes, np.searchsorted(starts, offsets))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def _rounds(sizes: np.ndarray):
    """For each place of the short words: the words that have it."""
    live = np.flatnonzero(sizes <= LONG_WORD)
    place = 0
    while len(live := live[sizes[live] > place]):
        yield place, live
        place += 1


def crc32_of(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every range of bytes."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for place, live in _rounds(sizes):
        now = crc[live]
        crc[live] = CRC[(now ^ text[starts[live] + place]) & 255] ^ (now >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        crc[i] = zlib.crc32(text[starts[i] : starts[i] + sizes[i]])
    return crc


def hash_of(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every range of bytes, the same wherever the bytes stand."""
    value = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for place, live in _rounds(sizes):
        value[live] = (value[live] ^ text[starts[live] + place]) * np.uint64(0x100000001B3)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        value[i] = xxhash.xxh64_intdigest(text[starts[i] : starts[i] + sizes[i]].tobytes())
    return value


def runs_of_words(words: Words, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and text of all runs of 1 to ``most`` consecutive words of a text, joined by one blank, repeats included."""
    owner, ends = words.owner, words.starts + words.sizes
    starts, sizes, owners = [], [], []
    for n in range(1, most + 1):
        head = np.arange(max(0, len(owner) - n + 1))
        head = head[owner[head] == owner[head + n - 1]]
        starts.append(words.starts[head])
        sizes.append(ends[head + n - 1] - words.starts[head])
        owners.append(owner[head])
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(owners)


def equal_bytes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether each range of ``text`` holds the same bytes as the range of ``other`` beside it."""
    same = sizes == other_sizes
    held = np.where(same, sizes, 0)
    for place, live in _rounds(held):
        same[live] &= text[starts[live] + place] == other[other_starts[live] + place]
    for i in np.flatnonzero(held > LONG_WORD).tolist():
        same[i] = np.array_equal(text[starts[i] : starts[i] + sizes[i]], other[other_starts[i] : other_starts[i] + sizes[i]])
    return same
