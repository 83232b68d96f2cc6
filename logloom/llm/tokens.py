"""Token ids of whole texts by a tokenizer file, with each distinct piece encoded once."""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logloom.llm.common import joined_bytes, ragged

# Pieces that one Python worker remembers at most; the older half goes beyond it. Longer pieces are not kept.
CACHED_PIECES, CACHED_BYTES = 300_000, 64
# Bytes of text that are cut into pieces at a time; the arrays for that take some thirty times as much.
ENCODED_BYTES = 2 << 20
# Fixed value: the word pattern of the tokenizer file that pieces are cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Pieces that are one word of the pattern: ASCII signs, or ASCII and Latin letters after an apostrophe or none.
WHOLE = re.compile("[!-/:-@\\[-`{-~]+|[0-9]|'?[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
# The byte-level rule: bytes that are printable in Latin-1 stand for themselves, the others for U+0100 and on.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PLAIN_BYTES)}
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
CODES = np.arange(256, dtype=np.uint8)
UPPER = (CODES >= 65) & (CODES <= 90)
LOWERED = np.where(UPPER, CODES + 32, CODES).astype(np.uint8)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[(LOWERED >= 97) & (LOWERED <= 122)] = LETTER
KIND[[32, *range(9, 14)]] = SPACE
# First bytes of U+00C0 to U+017F, and the three of these that are no letter or become two characters in lower case.
LATIN = range(0xC3, 0xC6)
NO_LETTER = (0xC397, 0xC3B7, 0xC4B0)

_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker for the tokenizer file ``path``."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def pieces_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of the texts ``flat[offsets[i]:offsets[i + 1]]`` without white space, and the first piece of each text.

    Words of ASCII and of the letters U+00C0 to U+017F are cut by the word pattern and A-Z are lower-cased.
    Any other word is one piece as it stands, as characters in it may join when they are normalized.
    """
    kind, begins = KIND[flat], np.zeros(len(flat), bool)
    lead = np.flatnonzero((flat >= LATIN.start) & (flat < LATIN.stop))
    pair = flat[lead].astype(np.int32) << 8 | flat[lead + 1]
    lead = lead[~np.isin(pair, NO_LETTER)]
    kind[lead] = kind[lead + 1] = LETTER
    begins[:1] = True
    begins[1:] = kind[1:] != kind[:-1]
    edges = offsets[offsets < len(flat)]
    begins[edges] = True
    space = kind == SPACE
    begins = (begins | (kind == DIGIT)) & ~space
    low = LOWERED[flat]
    if (kind == OTHER).any():
        opens = np.ones(len(flat), bool)
        opens[1:] = space[:-1]
        opens[edges] = True
        starts = np.flatnonzero(opens & ~space)
        others = np.concatenate([[0], np.cumsum(kind == OTHER)])
        filled = np.concatenate([[0], np.cumsum(~space)])
        after = np.append(starts[1:], len(flat))
        odd = others[after] > others[starts]
        at, sizes = starts[odd], (filled[after] - filled[starts])[odd]
        begins[ragged(at + 1, sizes - 1)] = False
        inner = ragged(at, sizes)
        low[inner] = flat[inner]
    _join_contractions(low, kind, begins, edges)
    starts = np.flatnonzero(begins)
    ends = np.concatenate([[0], np.cumsum(~space)])[np.append(starts, len(flat))].astype(np.int32)
    if not len(starts):
        ends = np.zeros(1, np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[~space])])
    return pieces, np.searchsorted(starts, offsets)


def _join_contractions(low: np.ndarray, kind: np.ndarray, begins: np.ndarray, edges: np.ndarray) -> None:
    """A lone apostrophe takes the letters s, t, m, d, re, ve or ll that follow it; the next piece begins after them."""
    quote = np.flatnonzero((low[:-1] == 39) & begins[:-1] & begins[1:] & (kind[1:] == LETTER))
    quote = quote[~np.isin(quote + 1, edges)]
    if not len(quote):
        return
    one, inside = low[quote + 1], quote + 2 < len(low)
    beyond = np.minimum(quote + 2, len(low) - 1)
    two = np.where(inside & (kind[beyond] == LETTER) & ~begins[beyond], low[beyond], 0)
    size = np.where(np.isin(one, list(b"stmd")), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    quote, size = quote[size > 0], size[size > 0]
    begins[quote + 1] = False
    after = quote + 1 + size
    after = after[after < len(low)]
    begins[after[kind[after] == LETTER]] = True


class TextEncoder:
    """Encodes Arrow string arrays as the library does with ``add_special_tokens=False``.

    Where the tokenizer drops white space, lowers case and cuts words by :data:`PATTERN`, pieces are
    looked up, and only new ones go through its merges. Texts that hold the string of an added
    token, and all texts of any other tokenizer, are encoded whole by the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = self._cuts_pieces()
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts_pieces(self) -> bool:
        import json

        told = json.loads(self.tokenizer.to_str())
        normal, cut = (told[k] or {} for k in ("normalizer", "pre_tokenizer"))
        steps = [n["type"] for n in normal.get("normalizers", [])]
        first = (cut.get("pretokenizers") or [{}])[0]
        as_is = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        split = first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
        mapped = [p["type"] for p in cut.get("pretokenizers", [])] == ["Split", "ByteLevel"] and not cut["pretokenizers"][1]["add_prefix_space"]
        return bool(mapped and steps == ["NFC", "Replace", "Lowercase"] and split and as_is and told["model"]["type"] == "BPE")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of each text (one more than texts)."""
        if not self.by_piece:
            return self._joined([np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        pieces, first = pieces_of(*joined_bytes(texts))
        coded = pieces.dictionary_encode()
        found = self._encoded(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        table = np.frombuffer(b"".join(found), self.type)
        which = np.asarray(coded.indices)
        each = sizes[which] if len(which) else np.zeros(0, np.int64)
        ids = table[ragged((np.cumsum(sizes) - sizes)[which], each)] if len(which) else np.zeros(0, self.type)
        ends = np.concatenate([[0], np.cumsum(each)])[first]
        return self._with_added(texts, ids, ends)

    def _with_added(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros(len(texts), bool)
        for token in self.added:
            held |= np.asarray(pc.match_substring(texts, token))
        if not held.any():
            return ids, ends
        return self._joined([np.array(self._ids(texts[i].as_py()), self.type) if held[i] else ids[ends[i] : ends[i + 1]] for i in range(len(texts))])

    def _joined(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, self.type), *parts]), np.cumsum([0, *map(len, parts)], dtype=np.int64)

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        known, out = self.known, []
        for piece in pieces:
            got = known.get(piece)
            if got is None:
                got = self._piece(piece)
                if len(piece) <= CACHED_BYTES:
                    known[piece] = got
            out.append(got)
        if len(known) > CACHED_PIECES:
            for piece in list(islice(known, len(known) // 2)):
                del known[piece]
        return out

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not WHOLE.fullmatch(text):
            ids = self._ids(text)
        elif text.isascii():
            ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        else:
            ids = [t.id for t in self.tokenizer.model.tokenize(text.lower().encode().decode("latin-1").translate(BYTE_CHARS))]
        return array(self.code, ids).tobytes()
