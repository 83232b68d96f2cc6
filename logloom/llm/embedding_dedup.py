"""Near-duplicate vectors by sorted passes over random hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.vectors import dimension, matrix, unit_vectors
from logloom.operators.components import connected_components
from logloom.operators.numbering import cut_lineage

# Rows after a row, in the order of a pass, that it is compared with.
WINDOW = 128
# Chance that the passes find a pair exactly at the threshold; closer pairs are found sooner.
RECALL = 0.95
# Members of a component that meet in one task at a time.
TILE = 2048
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def passes_needed(rows: int, cosine: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes until a pair at the threshold has shared a window at least once with probability ``recall``.

    Two vectors agree on one hash bit with probability 1 - angle / pi. They are in one
    window if they agree on the first log2(rows / window) bits, or nearly so.
    """
    bits = max(0.0, math.log2(max(rows, 1) / window))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def hash_keys(vectors: np.ndarray, number: int, seed: int) -> np.ndarray:
    """63 signs of random projections, one after the other from the highest bit."""
    planes = np.random.default_rng([seed, number]).normal(size=(vectors.shape[1], 63))
    bits = (vectors @ planes > 0).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(62, -1, -1, dtype=np.int64))


def window_links(ids: np.ndarray, unit: np.ndarray, cosine: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs among rows at most ``window`` apart, found in blocks of matrix products."""
    u, v = [], []
    for at in range(0, len(ids), window):
        left, right = unit[at : at + window], unit[at : at + 2 * window]
        i, j = np.nonzero(left @ right.T >= cosine)
        keep = (j > i) & (j - i <= window)
        u.append(ids[at + i[keep]])
        v.append(ids[at + j[keep]])
    a, b = np.concatenate(u), np.concatenate(v)
    return np.minimum(a, b), np.maximum(a, b)


def _pass_links(units: DataFrame, passes: int, cosine: float, window: int, seed: int) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("_v"))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(vectors), p, np.int32)), pa.array(hash_keys(vectors, p, seed)), batch.column("_id"), batch.column("_v")],
                        names=["pass", "key", "_id", "_v"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def links(ids: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
            u, v = window_links(ids, unit, cosine, window)
            pairs = np.unique(np.stack([u, v], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=LINKS)

        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.asarray(batch.column("pass"))
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            ids, vectors = np.asarray(batch.column("_id")), matrix(batch.column("_v"))
            for a, b in zip(edges, edges[1:], strict=False):
                p = int(number[a])
                before = held.get(p)
                # The last rows of the former batch see the first rows of this one.
                part_ids = ids[a:b] if before is None else np.concatenate([before[0], ids[a:b]])
                part = vectors[a:b] if before is None else np.concatenate([before[1], vectors[a:b]])
                yield links(part_ids, part)
                held = {p: (part_ids[-window:].copy(), part[-window:].copy())}

    order = [F.col("pass"), F.col("key"), F.col("_id")]
    spread = units.mapInArrow(keyed, "pass int, key bigint, _id bigint, _v array<double>").repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(compare, "u bigint, v bigint").distinct()


def _tile_links(members: DataFrame, cosine: float) -> DataFrame:
    """``_id, linked``: for members ``(component, size, _id, weight, _v)`` the weight of all members they link with.

    A component is dealt into tiles of about ``TILE`` members, and every two tiles meet in one
    group; only a sum per member leaves it, never a pair.
    """
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("_id"), tiles).cast("int")
    dealt = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tile, a, b = (np.asarray(group.column(c)) for c in ("_own", "_a", "_b"))
        unit = matrix(group.column("_v").combine_chunks() if group.num_rows else pa.array([], pa.list_(pa.float64())))
        weight, ids = np.asarray(group.column("weight")), np.asarray(group.column("_id"))
        out = np.zeros(len(ids), np.int64)
        left, right = np.flatnonzero(tile == a[0]), np.flatnonzero(tile == b[0])
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            near = unit[rows] @ unit[right].T >= cosine
            if a[0] == b[0]:
                near &= rows[:, None] != right[None, :]
            out[rows] += near @ weight[right]
            if a[0] != b[0]:
                out[right] += weight[rows] @ near
        return pa.table({"_id": ids, "linked": out})

    parts = dealt.groupBy("component", "_a", "_b").applyInArrow(count, "_id bigint, linked bigint")
    return parts.groupBy("_id").agg(F.sum("linked").alias("linked"))


def near_duplicate_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, window: int = WINDOW, recall: float = RECALL, seed: int = 11
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row per input row.

    Each pass sorts the vectors by a string of random hash bits and compares every
    vector with the next ``window`` in that order; pairs of cosine at least ``cosine`` (doubles)
    link, and components join over all passes. The number of passes follows from the number
    of vectors. Windows miss pairs in components with more members than a window, so
    each component whose pairs were not all found is then compared whole, in tiles. Equal vectors are one
    vector in the passes and count as often as they occur. Null, zero or non-finite vectors link with
    nothing; a null id is kept as its own row with a null component. Rows with one id count as
    one vector each.
    """
    everything = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"))
    keyed = cut_lineage(unit_vectors(vectors, id_col, vector_col), "unit-vectors")
    dimension(keyed)
    folded = keyed.groupBy("_same").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.min_by("_v", "_id").alias("_v"))
    folded = cut_lineage(folded, "distinct-vectors")
    rows = folded.count()
    links = cut_lineage(_pass_links(folded.select(F.col("node").alias("_id"), "_v"), passes_needed(rows, cosine, window, recall), cosine, window, seed), "vector-links")
    classes = cut_lineage(connected_components(links), "vector-classes")
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    found = links.join(classes, links["u"] == classes["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    state = sizes.join(found, "component").withColumn("whole", F.col("pairs") == F.col("size") * (F.col("size") - 1) / 2)
    member = classes.join(state, "component").join(folded, "node")
    member = cut_lineage(member.select("component", "size", "whole", F.col("node").alias("_id"), "weight", F.when(~F.col("whole"), F.col("_v")).alias("_v")), "vector-members")
    total = member.filter("whole").groupBy("component").agg(F.sum("weight").alias("_sum"))
    full = member.filter("whole").join(total, "component").select("_id", (F.col("_sum") - F.col("weight")).alias("linked"))
    counted = full.union(_tile_links(member.filter(~F.col("whole")).drop("whole"), cosine))
    per_node = folded.select("_same", "node", "weight").join(classes, "node", "left").join(counted.withColumnRenamed("_id", "node"), "node", "left")
    per_node = per_node.select("_same", F.coalesce("component", "node").alias("_c"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("_l"))
    known = keyed.select(F.col("_id"), "_same").distinct().join(per_node, "_same").groupBy("_id").agg(F.max("_l").alias("_l"), F.min("_c").alias("_c"))
    out = everything.join(known, everything["vec_id"] == known["_id"], "left")
    component = F.coalesce("_c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("_l", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
