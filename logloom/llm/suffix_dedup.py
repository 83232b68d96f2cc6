"""Repeated passages across documents: shared byte strings of a least length, found exactly."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import id_and_text, joined_bytes, ragged, steps, task_number, without_broken_characters
from logloom.operators.numbering import shared_folder

# Least length of a repeat, in bytes.
LENGTH = 50
# A window is known by the smallest hash of its grams of this many bytes.
GRAM = 20
# Bytes of text in one block of documents, and for one bucket of hashes.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
# Bytes that one suffix sort takes, if no single group is larger.
SORT_BYTES = 1 << 20
# Stretches with one hash beyond which their windows are spread over buckets by their own hash.
HOT = 200_000
# Windows in one stretch at most (long runs of one hash occur in periodic texts only).
STRETCH = 4096
NO_ID = np.iinfo(np.int64).max

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[0]) ^ (np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[1] >> np.uint64(29))


# ---------------------------------------------------------------- Burrows-Wheeler transform


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (bytes, read as a ring) in the order of their next ``depth`` bytes."""
    n = len(text)
    padded = np.resize(text, n + depth + 8)
    key = np.zeros(n + depth, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n + depth].astype(np.uint64)
    known = 8
    order = np.argsort(key)
    while known < depth:
        ranked = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]), dtype=np.uint64)
        step = min(known, depth - known)
        key = (rank[:-step] << np.uint64(32)) | rank[step:]
        known += step
        order = np.argsort(key)
    return order[order < n]


def repeat_boundaries(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at rows whose common prefix with the row before is shorter than ``depth``.

    Works on the Burrows-Wheeler transform of the sorted rows, breadth first by value: a
    boundary between two rows with a common prefix of v makes, for each byte c before rows
    on both sides, a boundary of v + 1 between the rows that c extends them to. A
    value is set once, at the first (smallest) v that reaches it. Values from ``depth``
    on are never derived: what stays open is a repeat.
    """
    n = len(text)
    before = text[order - 1]
    extended = np.argsort(before, kind="stable")  # row j extends row extended[j] by one byte to the left
    target = np.empty(n, np.int64)
    target[extended] = np.arange(n)
    first = text[order]
    closed = np.zeros(n, bool)
    closed[0] = True
    closed[1:] = first[1:] != first[:-1]
    fresh = np.flatnonzero(closed)
    open_rows = np.flatnonzero(~closed)
    for _ in range(1, depth):
        if not len(fresh) or not len(open_rows):
            break
        if len(fresh) * 16 > len(open_rows):
            interval = np.cumsum(closed, dtype=np.int32)
            hit = interval[extended[open_rows]] != interval[extended[open_rows - 1]]
            fresh, open_rows = open_rows[hit], open_rows[~hit]
            closed[fresh] = True
        else:
            borders = np.flatnonzero(closed)
            ends = np.append(borders, n)[np.searchsorted(borders, fresh, "right")]
            rows = ragged(fresh, ends - fresh)
            owner = np.repeat(np.arange(len(fresh)), ends - fresh)
            # The first row of each byte in each interval is extended right after the border.
            _, at = np.unique(owner * 256 + before[rows], return_index=True)
            reached = target[rows[at]]
            fresh = np.unique(reached[~closed[reached]])
            closed[fresh] = True
            open_rows = open_rows[~closed[open_rows]] if len(fresh) else open_rows
    return closed


def least_owner(strings: list[bytes], owners: np.ndarray, depth: int) -> list[np.ndarray]:
    """For every window of ``depth`` bytes of every string, the least owner among all strings that contain it."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = np.maximum(sizes - depth + 1, 0)
    owner = np.full(len(text), NO_ID, np.int64)
    places = ragged(starts, windows)
    owner[places] = np.repeat(owners, windows)
    order = suffix_order(text, depth)
    closed = repeat_boundaries(text, order, depth)
    heads = np.flatnonzero(closed)
    least = np.minimum.reduceat(owner[order], heads)
    found = np.empty(len(text), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(heads, len(text))))
    return np.split(found[places], np.cumsum(windows)[:-1])


# ---------------------------------------------------------------- stretches of windows


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    out = a * _MULTIPLIERS[k]
    out ^= out >> np.uint64(29)
    out += b
    return out


def _gram_hashes(flat: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes, put together from hashes of 1, 2, 4, … bytes."""
    powers, size = [_BYTES[flat]], 1
    while size * 2 <= gram:
        last = powers[-1]
        powers.append(_mix(last[:-size], last[size:], len(powers) % 6))
        size *= 2
    out, have = powers[-1], size
    for k in range(len(powers) - 2, -1, -1):
        if gram - have >= 1 << k:
            part = powers[k]
            m = len(flat) - have - (1 << k) + 1
            out = _mix(out[:m], part[have : have + m], k + 1)
            have += 1 << k
    out = out ^ (out >> np.uint64(32))
    out *= _MULTIPLIERS[4]
    out ^= out >> np.uint64(31)
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def window_keys(flat: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``length`` bytes its smallest gram hash (upper 48 bits); equal windows have equal keys."""
    out = np.empty(max(len(flat) - length + 1, 0), np.uint64)
    piece = 1 << 20
    for at in range(0, len(out), piece):
        part = flat[at : at + piece + length - 1]
        out[at : at + piece] = _sliding_least(_gram_hashes(part, gram), length - gram + 1)
    out >>= np.uint64(16)
    return out


def stretches(flat: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: key, first window, number of windows, document. No window leaves its document."""
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    keys = window_keys(flat, length, gram)
    change = np.zeros(len(keys) + 1, bool)
    change[1:-1] = keys[1:] != keys[:-1]
    some = np.flatnonzero(windows)
    change[offsets[:-1][some]] = True
    change[(offsets[:-1] + windows)[some]] = True  # the first window that would leave the document
    starts = np.flatnonzero(change[:-1])
    ends = np.append(starts[1:], len(keys))
    docs = np.searchsorted(offsets, starts, "right") - 1
    inside = starts < offsets[docs] + windows[docs]
    starts, counts, docs = starts[inside], (ends - starts)[inside], docs[inside]
    if len(counts) and counts.max() > STRETCH:
        parts = -(-counts // STRETCH)
        which = np.repeat(np.arange(len(counts)), parts)
        shift = ragged(np.zeros(len(counts), np.int64), parts) * STRETCH
        starts, docs = starts[which] + shift, docs[which]
        counts = np.minimum(counts[which] - shift, STRETCH)
    return keys[starts], starts, counts, docs


# ---------------------------------------------------------------- messages between blocks and buckets


def _compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _decompress(data: bytes, size: int = 0) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return _compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = _decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, count, 8), 8 * (count + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


BLOCKS = "block bigint, ids binary, sizes binary, data binary, carried binary"
LETTER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("letter", pa.binary())])
LETTERS = "block bigint, bucket int, letter binary"


def _to_bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return _compress(sink.getvalue().to_pybytes())


def _from_bytes(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(_decompress(data)) as source:
        return source.read_all()


def _to_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in blocks: consecutive rows of a partition, their texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, sizes, data, carried = task_number()[0] << 33, 0, [], [], [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "block": [number],
                    "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                    "sizes": pa.array([np.concatenate(sizes).tobytes()], pa.binary()),
                    "data": pa.array([_compress(b"".join(data))], pa.binary()),
                    "carried": pa.array([_to_bytes(carried)], pa.binary()),
                }
            )

        for batch in steps(batches, limit=min(block_bytes, 1 << 20)):
            flat, offsets = joined_bytes(batch.column("_text"))
            ids.append(np.asarray(batch.column("_id").fill_null(NO_ID)).astype(np.int64))
            sizes.append(np.diff(offsets))
            data.append(flat.tobytes())
            carried.append(batch.select(["_carried"]))
            held += len(flat)
            if held >= block_bytes:
                yield block()
                number, held, ids, sizes, data, carried = number + 1, 0, [], [], [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


class Block:
    """One block opened: its bytes, documents and stretches."""

    def __init__(self, row: dict, length: int, gram: int) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.raw = _decompress(row["data"], int(self.offsets[-1])) if self.offsets[-1] else b""
        self.flat = np.frombuffer(self.raw, np.uint8)
        self.key, self.start, self.windows, self.doc = stretches(self.flat, self.offsets, length, gram)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * _MULTIPLIERS[5]) >> np.uint64(20)) % np.uint64(buckets)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted-by-(bucket, key) positions."""
    where = _bucket_of(keys, buckets).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(where)), strict=False):
        yield int(where[a]), slice(int(a), int(b))


def _sorted_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.lexsort((keys, _bucket_of(keys, buckets)))


def _letters(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, bucket, letter = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(letter, pa.binary())], schema=LETTER)


def _distinct_keys(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block by bucket, how often each occurs, and whether in several documents."""
    order = np.lexsort((block.doc, block.key))
    key, doc = block.key[order], block.doc[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(key)))
    several = doc[heads] != doc[heads + counts - 1] if len(heads) else np.zeros(0, bool)
    distinct = key[heads]
    by = _sorted_keys(distinct, buckets)
    return distinct[by], counts[by], several[by]


def _ask(row: dict, length: int, gram: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """First letter of a block to each bucket: its keys (as steps), their counts, and which occur in several documents."""
    keys, counts, several = _distinct_keys(Block(row, length, gram), buckets)
    counts = np.minimum(counts, 0xFFFF).astype(np.uint16)
    return [(row["block"], b, _pack(np.diff(keys[s], prepend=np.uint64(0)), counts[s], np.packbits(several[s]))) for b, s in _by_bucket(keys, buckets)]


def _answer(letters: list[dict], hot: int) -> list[tuple[int, int, bytes]]:
    """Marks for each key of each block: 0 in one document only, 1 shared, 2 shared by more than ``hot`` stretches."""
    opened = [_unpack(x["letter"], np.uint64, np.uint16, np.uint8) for x in letters]
    keys = [np.cumsum(k) for k, _, _ in opened]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    group = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    counts = np.concatenate([c for _, c, _ in opened]).astype(np.float64)[order]
    many = np.concatenate([np.unpackbits(m, count=len(k)) for k, (_, _, m) in zip(keys, opened, strict=True)])[order]
    shared = np.bincount(group) + np.bincount(group, weights=many) > 1
    mark = (shared + (shared & (np.bincount(group, weights=counts) > hot))).astype(np.uint8)
    marks = np.empty(len(flat), np.uint8)
    marks[order] = mark[group]
    ends = np.cumsum([len(k) for k in keys])
    return [(x["block"], x["bucket"], _pack(m)) for x, m in zip(letters, np.split(marks, ends[:-1]), strict=True)]


def _contexts(block: Block, answers: list[dict], length: int, gram: int, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, tuple]:
    """Distinct strings around the shared windows of a block.

    Returns the strings by bucket and key, their keys, their least document ids, and per
    occurrence (string, first window, number of windows, document). Stretches of hot keys
    are cut into single windows, each with a key of its own, so that their strings spread
    over buckets; windows that are equal are then one string wherever they stand.
    """
    keys, _, _ = _distinct_keys(block, buckets)
    marks = np.zeros(len(keys), np.uint8)
    slices = dict(_by_bucket(keys, buckets))
    for a in answers:
        marks[slices[a["bucket"]]] = _unpack(a["letter"], np.uint8)[0]
    by_key = np.argsort(keys)
    mark = marks[by_key][np.searchsorted(keys, block.key, sorter=by_key)]
    plain, hot = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
    single = ragged(block.start[hot], block.windows[hot])
    start = np.concatenate([block.start[plain], single])
    windows = np.concatenate([block.windows[plain], np.ones(len(single), np.int64)])
    doc = np.concatenate([block.doc[plain], np.repeat(block.doc[hot], block.windows[hot])])
    known: dict[bytes, int] = {}
    raw, add = block.raw, known.setdefault
    which = np.fromiter((add(raw[a:b], len(known)) for a, b in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)), np.int64, len(start))
    strings = list(known)
    least = np.full(len(strings), NO_ID, np.int64)
    np.minimum.at(least, which, block.ids[doc])
    own = np.zeros(len(strings), np.uint64)
    own[which[: len(plain)]] = block.key[plain]
    if len(single):
        own[which[len(plain) :]] = _gram_hashes_of([strings[w] for w in which[len(plain) :].tolist()])
    # dict numbers follow first occurrence; equal strings get equal places in the order below.
    order = _sorted_keys(own, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [strings[i] for i in order.tolist()], own[order], least[order], (place[which], start, windows, doc)


def _gram_hashes_of(strings: list[bytes]) -> np.ndarray:
    """A 48-bit key of strings of one length."""
    table = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1)
    out = np.zeros(len(strings), np.uint64)
    for k in range(table.shape[1]):
        out = _mix(out, _BYTES[table[:, k]], k % 6)
    return (out * _MULTIPLIERS[4]) >> np.uint64(16)


def _send(row: dict, length: int, gram: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Second letter: the strings of a block, by bucket."""
    strings, keys, least, _ = _contexts(Block(row, length, gram), row["answers"] or [], length, gram, buckets)
    out = []
    for b, s in _by_bucket(keys, buckets):
        part = strings[s]
        sizes = np.fromiter(map(len, part), np.int32, len(part))
        out.append((row["block"], b, _pack(keys[s], least[s], sizes, np.frombuffer(b"".join(part), np.uint8))))
    return out


def _resolve(letters: list[dict], length: int, sort_bytes: int) -> list[tuple[int, int, bytes]]:
    """For each string of each block the least document id of each of its windows, as runs.

    Equal strings are one. Strings with one key go through the transform together;
    a key with a single string has nothing to compare.
    """
    known: dict[bytes, int] = {}
    which, least_parts, key_parts = [], [], []
    for x in letters:
        keys, least, sizes, data = _unpack(x["letter"], np.uint64, np.int64, np.int32, np.uint8)
        raw, ends = data.tobytes(), np.cumsum(sizes).tolist()
        at = [0, *ends[:-1]]
        which.append(np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(at, ends, strict=True)), np.int64, len(ends)))
        least_parts.append(least)
        key_parts.append(keys)
    strings = list(known)
    every = np.concatenate(which)
    least = np.full(len(strings), NO_ID, np.int64)
    np.minimum.at(least, every, np.concatenate(least_parts))
    key = np.zeros(len(strings), np.uint64)
    key[every] = np.concatenate(key_parts)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(heads, len(order)))
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    batch: list[int] = []
    size = 0

    def transform() -> None:
        for i, owners in zip(batch, least_owner([strings[i] for i in batch], least[batch], length), strict=True):
            steps_ = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            if len(steps_) > 1 or owners[0] != least[i]:
                runs[i] = (steps_, owners[steps_])

    for h, c in zip(heads[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
        members = order[h : h + c].tolist()
        batch += members
        size += sum(len(strings[i]) for i in members)
        if size >= sort_bytes:
            transform()
            batch, size = [], 0
    if batch:
        transform()
    out = []
    for x, mine in zip(letters, which, strict=True):
        own = [i for i in np.unique(mine).tolist() if i in runs] if runs else []
        with_runs = np.isin(mine, own)
        split = [runs[i] for i in mine[with_runs].tolist()]
        out.append(
            (
                x["block"],
                x["bucket"],
                _pack(
                    least[mine],
                    with_runs,
                    np.array([len(a) for a, _ in split], np.int32),
                    np.concatenate([a for a, _ in split]).astype(np.int32) if split else np.zeros(0, np.int32),
                    np.concatenate([o for _, o in split]) if split else np.zeros(0, np.int64),
                ),
            )
        )
    return out


def _covered(row: dict, length: int, gram: int, buckets: int) -> tuple[Block, np.ndarray]:
    """Which bytes of a block go: those in a window that a document with a smaller id has as well."""
    block = Block(row, length, gram)
    strings, keys, _, (which, start, windows, doc) = _contexts(block, row["answers"] or [], length, gram, buckets)
    cover = np.zeros(len(block.flat) + 1, np.int32)
    if not len(strings):
        return block, cover[:-1] > 0
    least = np.full(len(strings), NO_ID, np.int64)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    slices = dict(_by_bucket(keys, buckets))
    for a in row["runs"] or []:
        where = slices[a["bucket"]]
        own, with_runs, sizes, steps_, owners = _unpack(a["letter"], np.int64, np.bool_, np.int32, np.int32, np.int64)
        least[where] = own
        ends = np.cumsum(sizes)
        for i, e, n in zip((np.flatnonzero(with_runs) + where.start).tolist(), ends.tolist(), sizes.tolist(), strict=True):
            parts[i] = (steps_[e - n : e].astype(np.int64), owners[e - n : e])
    uneven = np.zeros(len(strings), bool)
    uneven[list(parts)] = True
    ids = block.ids[doc]
    whole = np.flatnonzero(~uneven[which] & (least[which] < ids))
    np.add.at(cover, start[whole], 1)
    np.add.at(cover, start[whole] + windows[whole] + length - 1, -1)
    for k in np.flatnonzero(uneven[which]).tolist():
        steps_, owners = parts[int(which[k])]
        ends = np.append(steps_[1:], windows[k])
        smaller = owners < ids[k]
        np.add.at(cover, start[k] + steps_[smaller], 1)
        np.add.at(cover, start[k] + ends[smaller] + length - 1, -1)
    return block, np.cumsum(cover[:-1]) > 0


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _results(row: dict, length: int, gram: int, buckets: int, whole: bool) -> Iterator[pa.RecordBatch]:
    block, gone = _covered(row, length, gram, buckets)
    offsets = block.offsets
    padded = np.concatenate([[False], gone, [False]])
    begins = padded[1:] & ~padded[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = gone[inner]  # a run never crosses documents
    starts = np.flatnonzero(begins)
    stops = padded[:-1] & ~padded[1:]
    stops[inner[inner > 0]] |= gone[inner[inner > 0] - 1]
    ends = np.flatnonzero(stops)
    of_doc = np.searchsorted(offsets, starts, "right") - 1
    per_doc = np.bincount(of_doc, minlength=len(block.ids))
    removed = np.bincount(of_doc, weights=ends - starts, minlength=len(block.ids)).astype(np.int64)
    kept_flat = block.flat[~gone].tobytes()
    kept_ends = np.cumsum(np.diff(offsets) - removed)
    spans = pa.StructArray.from_arrays([pa.array(starts - offsets[of_doc]), pa.array(ends - offsets[of_doc])], ["start", "end"])
    span_ends = np.cumsum(per_doc)
    carried = _from_bytes(row["carried"]).column("_carried").combine_chunks()
    step = max(1, (4 << 20) * len(block.ids) // max(len(block.flat), 1))
    for a in range(0, len(block.ids), step):
        b = min(a + step, len(block.ids))
        first_span, first_kept = (int(span_ends[a - 1]), int(kept_ends[a - 1])) if a else (0, 0)
        ids = block.ids[a:b]
        kept = [kept_flat[s:e] for s, e in zip([first_kept, *kept_ends[a : b - 1].tolist()], kept_ends[a:b].tolist(), strict=True)]
        for k in np.flatnonzero(per_doc[a:b]).tolist() if whole else []:
            own = slice(int(span_ends[a + k] - per_doc[a + k]), int(span_ends[a + k]))
            size = ends[own] - starts[own]
            cuts = starts[own] - offsets[a + k] - (np.cumsum(size) - size)
            kept[k] = without_broken_characters(kept[k], cuts.tolist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=ids == NO_ID),
                pa.array(np.diff(offsets)[a:b]),
                pa.array(removed[a:b]),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], span_ends[a:b] - first_span]).astype(np.int32)), spans.slice(first_span, int(span_ends[b - 1]) - first_span)
                ),
                pa.array(kept, pa.binary()),
                carried.slice(a, b - a),
            ],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "carried"],
        )


def _map_blocks(blocks: DataFrame, work, schema: str = LETTERS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = work(batch.slice(k, 1).to_pylist()[0])
                if out:
                    yield _letters(out)

    return blocks.mapInArrow(run, schema)


def _map_buckets(letters: DataFrame, buckets: int, work) -> DataFrame:
    """All letters to a bucket in one task, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield _letters(work(held))
                    held = []
                held.append(row)
        if held:
            yield _letters(work(held))

    return letters.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block").mapInArrow(run, LETTERS)


def _delivered(letters: DataFrame, name: str) -> DataFrame:
    """The letters of each block in one row (as many as it wrote itself)."""
    return letters.groupBy("block").agg(F.collect_list(F.struct("bucket", "letter")).alias(name))


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    sort_bytes: int = SORT_BYTES,
    hot: int = HOT,
    carry: list[str] | None = None,
    whole_characters: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, carried``: each text without what earlier documents have as well.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller id; strings are judged on the input. ``spans`` are the maximal removed
    runs (byte positions), ``kept`` the remaining bytes. Null text counts as empty; rows
    with one id do not remove each other; a null id is larger than any other. A row per
    input row; ``carried`` has the columns named in ``carry`` and whether the text was null. With
    ``whole_characters``, bytes of characters that a cut has broken are left out of ``kept`` too.

    Every window of ``length`` bytes belongs to the smallest hash of its grams, so equal windows
    meet in one bucket and most hashes can be told to occur in one document only. Just the
    strings around the others travel; equal strings are folded, and the strings of a hash go
    through a Burrows-Wheeler transform whose open intervals are the shared windows. The
    blocks of text are written once, bucketed by block number, so the three passes over
    them join what buckets answer without moving the text again.
    """
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/logloom/{name}"
    along = F.struct(docs[text_col].isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry or []])
    rows = id_and_text(docs.withColumn("_carried", along), id_col, text_col, "_carried")
    written = _to_blocks(rows, block_bytes)
    # As many files per task as it has blocks; the joins below shuffle only what answers them.
    bucketed = written.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", folder)
    bucketed.saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.select(F.sum(F.octet_length("data"))).first()[0] or 0  # compressed to about a half
    buckets = max(1, -(-2 * size // bucket_bytes))

    asked = _map_blocks(blocks, lambda row: _ask(row, length, gram, buckets))
    answers = _stored(_map_buckets(asked, buckets, lambda x: _answer(x, hot)), f"{folder}-answers")
    told = blocks.join(_delivered(answers, "answers"), "block", "left")
    sent = _map_blocks(told, lambda row: _send(row, length, gram, buckets))
    runs = _map_buckets(sent, buckets, lambda x: _resolve(x, length, sort_bytes))
    ready = told.join(_delivered(runs, "runs"), "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _results(batch.slice(k, 1).to_pylist()[0], length, gram, buckets, whole_characters)

    result = T.StructType.fromDDL(RESULT).add("carried", rows.schema["_carried"].dataType)
    return ready.mapInArrow(finish, result)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
