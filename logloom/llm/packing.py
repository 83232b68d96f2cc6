"""Packing of documents into training sequences that keep their order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import as_text, id_and_text, rows_of, steps, task_number
from logloom.llm.tokens import ENCODED_BYTES, encoder

# Tokens that one run of the dynamic programme looks at.
BLOCK_TOKENS = 1 << 20
# A stretch without any boundary is offered cuts this far apart.
HARD_STEP = 16
# Cost of a cut, in padding tokens: after a document, after a sentence, anywhere else.
DOCUMENT_CUT, SENTENCE_CUT, HARD_CUT = 0.0, 2.0, 8.0
# Tokens that end a sentence, as the tokenizer file writes them.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>", "...</w>", "。</w>")
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def best_cuts(ends: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """The boundaries after which windows end, as indexes into ``ends``; the last one always is.

    ``ends`` are ascending positions no more than ``length`` apart. A window from
    boundary i to j costs its padding ``length - (ends[j] - ends[i])`` and the penalty of
    cutting at j. With g(i) = cost(i) + ends[i], cost(j) = penalty(j) + length - ends[j] +
    min g(i) over the i at most ``length`` before j. That minimum slides, so a queue
    with ascending g gives it in constant amortised time.
    """
    n = len(ends)
    cost, came = [0.0] * (n + 1), [0] * (n + 1)
    at = [0, *ends.tolist()]
    fee = penalty.tolist()
    queue: deque[int] = deque([0])
    g = [0.0] * (n + 1)
    for j in range(1, n + 1):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        came[j] = i
        mine = fee[j - 1] + length + g[i]  # cost(j) + ends[j]
        cost[j] = mine - here
        g[j] = mine
        while queue and g[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = came[j]
    return np.array(cuts[::-1], np.int64)


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end and what a cut there costs."""
    marks = np.flatnonzero(np.isin(ids, sentence_ends)) + 1
    places = np.unique(np.concatenate([marks, doc_ends]))
    gaps = np.diff(np.concatenate([[0], places]))
    wide = np.flatnonzero(gaps > min(HARD_STEP * 2, length))
    if len(wide):
        more = [np.arange(places[k] - gaps[k] + min(HARD_STEP, length), places[k], min(HARD_STEP, length)) for k in wide]
        places = np.unique(np.concatenate([places, *more]))
    price = np.full(len(places), HARD_CUT)
    price[np.isin(places, marks)] = SENTENCE_CUT
    price[np.isin(places, doc_ends)] = DOCUMENT_CUT
    return places, price


class Packer:
    """The documents of one partition in order; the window that ends a block moves on into the next block."""

    def __init__(self, length: int, sentence_ends: np.ndarray, first_sequence: int, block: int = BLOCK_TOKENS) -> None:
        self.length, self.sentence_ends, self.sequence, self.block = length, sentence_ends, first_sequence, block
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, ids before these, ids here, ids of the document
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        sizes = np.array([d[2] for d in self.docs], np.int64)
        doc_ends = np.cumsum(sizes)
        places, price = boundaries(ids, doc_ends, self.sentence_ends, self.length)
        window_ends = places[best_cuts(places, price, self.length)]
        if not last and len(window_ends) > 1:
            window_ends = window_ends[:-1]
        stop = int(window_ends[-1])
        doc_starts = doc_ends - sizes
        window_starts = np.concatenate([[0], window_ends[:-1]])
        starts = np.unique(np.concatenate([window_starts, doc_starts[doc_starts < stop]]))
        finish = np.concatenate([starts[1:], [stop]])
        of_doc = np.searchsorted(doc_starts, starts, "right") - 1
        of_window = np.searchsorted(window_starts, starts, "right") - 1
        for a, b, d, w in zip(starts.tolist(), finish.tolist(), of_doc.tolist(), of_window.tolist(), strict=True):
            doc_id, before, _, whole = self.docs[d]
            piece = ids[a:b].astype("<u4").tobytes()
            yield doc_id, before + a - int(doc_starts[d]), b - a, piece, whole, self.sequence + w, a - int(window_starts[w])
        self.sequence += len(window_ends)
        left = int(np.searchsorted(doc_ends, stop, "right"))
        rest = [(i, before, n, whole) for i, before, n, whole in self.docs[left:]]
        if rest:
            i, before, n, whole = rest[0]
            cut = stop - int(doc_starts[left])
            rest[0] = (i, before + cut, n - cut, whole)
        self.docs, self.held = rest, len(ids) - stop
        self.ids = [ids[stop:].copy()] if self.held else []


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, block: int = BLOCK_TOKENS
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids, in the order of the rows.

    Each text is encoded whole and followed by ``end_id`` (null text: that id alone). Every
    id is in exactly one piece: ``doc_id, start`` (ids of its document before the piece),
    ``length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.
    Nothing is shuffled: a task packs its rows in their order, a block of ids at a time,
    and only the last sequence of a task may be short. ``sequence_id`` is the partition
    number in the upper bits and a counter in the lower 33, the same when a task is retried.
    Repeated rows are packed as often as they occur; an empty table gives no row.
    """
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        vocabulary = encode.tokenizer.get_vocab()
        ends = np.array([vocabulary[t] for t in SENTENCE_ENDS if t in vocabulary], encode.type)
        packer = Packer(length, ends, task_number()[0] << 33, block)

        def pieces() -> Iterator[tuple]:
            for batch in steps(batches, limit=ENCODED_BYTES):
                ids, offsets = encode.encode(as_text(batch.column("_text")))
                ids = np.insert(ids, offsets[1:], np.array(end_id, encode.type))
                offsets = offsets + np.arange(len(offsets))
                for k, doc_id in enumerate(batch.column("_id").to_pylist()):
                    yield from packer.add(doc_id, ids[offsets[k] : offsets[k + 1]])
            yield from packer.flush()

        out: list[tuple] = []
        for piece in pieces():
            out.append(piece)
            if len(out) == 4096:
                yield rows_of(dict(enumerate(map(list, zip(*out, strict=True)))), SCHEMA)
                out = []
        if out:
            yield rows_of(dict(enumerate(map(list, zip(*out, strict=True)))), SCHEMA)

    names = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(run, names)
