"""SimHash near-duplicates: fingerprints, pigeonring candidates, and one class per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import id_and_text, steps
from logloom.operators.components import connected_components
from logloom.operators.numbering import cut_lineage

BITS = 64
# Shingles hashed at a time, so that a long text needs bounded memory.
CHUNK = 1 << 16
# Fingerprints of one bucket that are compared with each other; larger buckets go the way of ``_ball_links``.
BUCKET = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; fewer words give one shingle, none gives zero."""
    parts = text.lower().split()  # on bytes: A-Z only, white space 0x20 and 0x09 to 0x0D only
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: max(len(parts) - words + 1, 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (a signed long with the 64 bits) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            bits = np.array([fingerprint(v, words, seed) for v in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def ring(max_distance: int, segments: int) -> tuple[list[tuple[int, int]], list[int]]:
    """``(shift, width)`` of each segment and the budget of every chain of 1, 2, … segments.

    If two fingerprints differ in at most d bits over m segments in a ring, some segment
    starts a chain in which, for every length l, the first l segments differ in at
    most floor(l d / m) bits.
    """
    base, more = divmod(BITS, segments)
    widths = [base + (k < more) for k in range(segments)]
    shifts = np.cumsum([0, *widths[:-1]]).tolist()
    return list(zip(shifts, widths, strict=True)), [length * max_distance // segments for length in range(1, segments + 1)]


def _masks(max_distance: int, segments: int) -> list[list[int]]:
    """For each start in the ring, the bits of its first 1, 2, … segments."""
    places, _ = ring(max_distance, segments)
    single = [((1 << w) - 1) << s for s, w in places]
    out = []
    for i in range(segments):
        total, chain = 0, []
        for k in range(segments):
            total |= single[(i + k) % segments]
            chain.append(total)
        out.append(chain)
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def chain_pairs(fps: np.ndarray, start: int, max_distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one bucket that keep all chain budgets from ``start``; the last budget is the distance itself."""
    budgets, chains = ring(max_distance, segments)[1], _masks(max_distance, segments)[start]
    a, b = np.triu_indices(len(fps), 1)
    differ = fps[a] ^ fps[b]
    for budget, mask in zip(budgets, chains, strict=True):
        keep = np.bitwise_count(differ & np.uint64(mask)) <= budget
        a, b, differ = a[keep], b[keep], differ[keep]
    return a, b


def _bucket_links(members: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """Verified links inside buckets of at most ``BUCKET`` fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for start, fps, nodes in zip(*(batch.column(c).to_pylist() for c in ("start", "fps", "nodes")), strict=True):
                a, b = chain_pairs(np.array(fps, np.int64).view(np.uint64), start, max_distance, segments)
                ids = np.array(nodes, np.int64)
                u.append(ids[a])
                v.append(ids[b])
            if u:
                yield pa.RecordBatch.from_pydict({"u": np.concatenate(u), "v": np.concatenate(v)})

    packed = members.groupBy("start", "key").agg(F.collect_list(F.struct("fp", "node")).alias("_all"))
    return packed.select("start", F.col("_all.fp").alias("fps"), F.col("_all.node").alias("nodes")).mapInArrow(run, "u bigint, v bigint")


def _ball_links(members: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """Links that connect the members of large buckets without meeting them in pairs.

    Two fingerprints differ in at most 2r bits exactly if some point is within r bits of
    both. Members of a bucket agree on the bits of its key, so r other bits are flipped
    at most. All fingerprints around a point are linked with each other; one link
    of each to the smallest has the same components. A point has few of them.
    """
    budgets = ring(max_distance, segments)[1]
    keyed = budgets.index(next(b for b in budgets if b))
    flips = []
    for chain in _masks(max_distance, segments):
        free = [1 << k for k in range(BITS) if not chain[keyed - 1] >> k & 1]
        one = [0, *free]
        flips.append(one if max_distance == 2 else sorted({a | b for a in one for b in one}))
    table = F.array(*[F.array(*[F.lit(_signed(x)) for x in f]) for f in flips])
    points = members.select("fp", "node", F.explode(F.get(table, F.col("start"))).alias("flip"))
    points = points.select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    least = points.groupBy("point").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return points.join(least, "point").filter("node <> v").select(F.col("node").alias("u"), "v")


def fingerprint_classes(prints: DataFrame, *, max_distance: int = 2, segments: int = 5) -> DataFrame:
    """``doc_id, fp, component_id`` for the rows of ``prints(doc_id, fp)``.

    Fingerprints link at ``max_distance`` (2 or 4) or fewer differing bits; the component is
    the smallest id reachable. Equal fingerprints are folded first, so copies cost one
    row. A bucket is a start in the ring plus the bits of the longest chain whose budget is
    zero; only its members meet, and pairs leave as soon as a longer chain
    exceeds its budget. Empty input gives an empty result; rows with a null id stay, and take part
    through the ids of their fingerprint (null if it has none).
    """
    if max_distance not in (2, 4):
        raise ValueError("max_distance must be 2 or 4")
    prints = cut_lineage(prints.select("doc_id", "fp"), "fingerprints")
    nodes = cut_lineage(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    budgets, chains = ring(max_distance, segments)[1], _masks(max_distance, segments)
    length = budgets.index(next(b for b in budgets if b))  # segments that must agree whole
    if not length:
        raise ValueError("more segments than max_distance are needed")
    keys = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(c[length - 1]))).alias("key")) for i, c in enumerate(chains)])
    keyed = nodes.select("fp", "node", F.explode(keys).alias("_k")).select("fp", "node", "_k.start", "_k.key")
    sizes = cut_lineage(keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = keyed.join(sizes, ["start", "key"])
    links = _bucket_links(met.filter(F.col("n") <= BUCKET), max_distance, segments)
    if not sizes.filter(F.col("n") > BUCKET).isEmpty():
        links = links.union(_ball_links(met.filter(F.col("n") > BUCKET), max_distance, segments))
    classes = connected_components(links)
    known = nodes.join(classes.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    known = known.select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: a row per input row, near-duplicates under one component."""
    return fingerprint_classes(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), max_distance=max_distance)
