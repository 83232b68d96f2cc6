"""Licence scans: short notices are found with a bounded number of edits, from exact seeds."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import id_and_text, joined_bytes, steps
from logloom.llm.words import words_of

# The phrases that are found word by word, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices that are found with edits, in words as the scan takes them, and the words that must stand unchanged.
NOTICES = (
    ("under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("apache license version 2", "apache-2", "apache 2"),
    ("creative commons attribution noncommercial", "cc-by-nc", "commons"),
    ("creative commons attribution sharealike", "cc-by-sa", "commons"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", "redistribution"),
    ("gnu general public license", "gpl", "gnu general"),
    ("gnu lesser general public license", "lgpl", "gnu lesser"),
    ("gnu affero general public license", "agpl", "gnu affero"),
    ("mozilla public license", "mpl", "mozilla"),
    ("eclipse public license", "epl", "eclipse"),
    ("boost software license", "bsl", "boost"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ""),
)
# A notice may differ by one edit for so many characters.
CHARS_PER_EDIT = 10
SPAN = "struct<label: string, notice: string, first_word: bigint, last_word: bigint, start: bigint, end: bigint, edits: int, exact: boolean>"
FOUND = f"doc_id bigint, n_words bigint, spans array<{SPAN}>"
# Windows whose outcome one task remembers; equal lines are verified once.
REMEMBERED = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Notice(NamedTuple):
    text: str
    label: str
    fixed: frozenset[str] = frozenset()
    edits: int = 0
    exact: bool = True


def notices_of(phrases: tuple, notices: tuple, chars_per_edit: int) -> list[Notice]:
    edited = [Notice(t, label, frozenset(fixed.split()), len(t) // chars_per_edit, False) for t, label, fixed in notices]
    return [Notice(t, label) for t, label in phrases] + edited


def seeds_of(notice: Notice) -> list[tuple[str, int]]:
    """The notice cut in one part more than it may have edits, with the place of each: an edit touches one part, so one stands unchanged."""
    cuts = np.linspace(0, len(notice.text), notice.edits + 2).round().astype(int).tolist()
    return [(notice.text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """Finds notices in texts of words joined by one blank."""

    def __init__(self, notices: list[Notice]) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            for seed, at in [(notice.text, 0)] if notice.exact else seeds_of(notice):
                uses.setdefault(seed, []).append((n, at))
        for seed, where in uses.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}") for n in notices]
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def candidates(self, joined: str) -> tuple[list[tuple[int, int]], set[tuple[int, int]]]:
        """Places of whole phrases, and the windows of edited notices: each holds every match that leaves one seed as it stands."""
        whole, windows = [], set()
        for last, (size, uses) in self.seeds.iter(joined):
            for n, at in uses:
                notice, begin = self.notices[n], last + 1 - size - at
                if not notice.exact:
                    windows.add((n, max(0, begin - notice.edits)))
                elif (not begin or joined[begin - 1] == " ") and joined[last + 1 : last + 2] in ("", " "):
                    whole.append((n, begin))
        return whole, windows

    def verified(self, n: int, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the match with the fewest edits in a window."""
        key = n, window
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.patterns[n].search(window)
            self.known[key] = (found.start(), found.end(), sum(found.fuzzy_counts)) if found else None
        return self.known[key]

    def spans(self, joined: str) -> list[tuple[int, int, int, int]]:
        """Notice, first and last character in whole words, and edits. Phrases: every place. Notices: the
        matches with the fewest edits that do not overlap, the left one of equals, with the fixed words among their words."""
        whole, windows = self.candidates(joined)
        out = [(n, begin, begin + len(self.notices[n].text), 0) for n, begin in whole]
        taken = {(self.notices[n].text, begin) for n, begin in whole}
        edited: dict[int, list[tuple[int, int, int]]] = {}
        for n, a in windows:
            notice = self.notices[n]
            if found := self.verified(n, joined[a : a + len(notice.text) + 2 * notice.edits]):
                begin, end = _whole_words(joined, a + found[0], a + found[1])
                if notice.fixed <= set(joined[begin:end].split(" ")):
                    edited.setdefault(n, []).append((found[2], begin, end))
        for n, matches in edited.items():
            kept: list[tuple[int, int]] = []
            for edits, begin, end in sorted(set(matches)):
                at = bisect.bisect_left(kept, (begin, end))
                if (at < len(kept) and kept[at][0] < end) or (at and kept[at - 1][1] > begin):
                    continue
                kept.insert(at, (begin, end))
                if edits or (self.notices[n].text, begin) not in taken:
                    out.append((n, begin, end, edits))
        return sorted(out, key=lambda s: (s[1], s[0]))


def _whole_words(joined: str, begin: int, end: int) -> tuple[int, int]:
    """The words that a match touches."""
    inner = joined[begin:end]
    begin, end = begin + len(inner) - len(inner.lstrip(" ")), end - (len(inner) - len(inner.rstrip(" ")))
    after = joined.find(" ", end)
    return joined.rfind(" ", 0, begin) + 1, len(joined) if after < 0 else after


def scan_licenses(
    docs: DataFrame,
    *,
    phrases: tuple = PHRASES,
    notices: tuple = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, spans`` of every document.

    A span has a label, the notice, its first and last word (from 0), code points of these words, edits, and
    ``exact`` for the ``phrases``, which are found word by word at every place. ``notices``
    (text, label, fixed words) may differ by one edit (a character put in, left out or exchanged) for every
    ``chars_per_edit`` characters. Seeds that must stand unchanged give windows, and bounded-error matching
    verifies each window and counts its edits; matches of one notice do not overlap.

    Null and empty texts have no word and no span. Whole texts are scanned, however long, without a cut: a
    window is never longer than a notice and its edits. Repeated rows give repeated results, an empty table
    none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices_of(phrases, notices, chars_per_edit))
        for batch in steps(batches):
            column = batch.column("_text")
            words = words_of(*joined_bytes(column))
            edges = np.concatenate([[0], np.cumsum(words.sizes + 1)])[words.first]
            # One pass over all texts tells which of them hold a seed; bytes stand for characters here.
            hits = [last for last, _ in scanner.seeds.iter(words.text.tobytes().decode("latin-1"))]
            met = np.unique(np.searchsorted(edges, hits, "right") - 1) if hits else []
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in [int(i) for i in met]:
                joined = words.text[edges[i] : edges[i + 1] - 1].tobytes().decode("utf-8", "replace")
                if found := scanner.spans(joined):
                    spans[i] = _told(column[i].as_py().decode("utf-8", "replace"), joined, found, scanner.notices)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(words.counts.astype(np.int64)), pa.array(spans, ARROW_SPANS)], names=["doc_id", "n_words", "spans"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, FOUND)


ARROW_SPANS = pa.list_(
    pa.struct(
        [("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]
        + [("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_())]
    )
)


def _told(text: str, joined: str, found: list[tuple[int, int, int, int]], notices: list[Notice]) -> list[dict]:
    begins = [m.span() for m in WORD.finditer(text)]
    blanks = [m.start() for m in re.finditer(" ", joined)]
    out = []
    for n, begin, end, edits in found:
        first, last = bisect.bisect_left(blanks, begin), bisect.bisect_left(blanks, end)
        notice = notices[n]
        out.append(
            {"label": notice.label, "notice": notice.text, "first_word": first, "last_word": last}
            | {"start": begins[first][0], "end": begins[last][1], "edits": edits, "exact": notice.exact}
        )
    return out
