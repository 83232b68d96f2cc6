"""Approximate nearest neighbours by largest inner product: a forest of sorted hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.vectors import dimension, matrix, valid_vectors
from logloom.operators.numbering import cut_lineage

# Sorted arrays of hash strings, and bits of a string.
TREES, BITS = 96, 48
# The trees are ascended together until a query has met this share of a shard, and at least so many rows.
SHARE, LEAST = 0.45, 1000
# Largest norm over smallest of one range of rows: a forest lifts its rows by the largest norm of its own range.
NORM_STEP = 1.25
# Rows of one shard, and queries that pass one copy of it; every query visits every shard.
SHARD_ROWS, QUERY_ROWS = 65_536, 65_536
# Queries of one shard that are answered at a time.
QUERY_STEP = 256


class Forest:
    """The forest of the rows of one range of norms.

    Each tree is an array of hash strings (integers of ``BITS`` sign bits) in sorted order. The
    rows whose strings share the first d bits with a query's are a range of that array, and
    a shorter prefix is a wider range, so walking up a tree is widening the range.
    Inner products become angles by one more component: sqrt(norm^2 - |x|^2) for rows and
    zero for queries.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, trees: int, seed: int) -> None:
        self.ids, self.vectors, self.trees, self.seed, self.norm = ids, vectors, trees, seed, norm
        rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
        lifted = np.concatenate([vectors, rest[:, None]], axis=1) / norm
        self.orders, self.strings = [], []
        for k in range(trees):
            strings = self._strings(lifted, k)
            order = np.argsort(strings, kind="stable")
            self.orders.append(order.astype(np.int32))
            self.strings.append(strings[order])

    def _strings(self, lifted: np.ndarray, tree: int) -> np.ndarray:
        planes = np.random.default_rng([self.seed, tree]).normal(size=(lifted.shape[1], BITS))
        return (lifted @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def _range(self, strings: np.ndarray, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the rows that share ``depth`` bits with each of ``strings``."""
        low = strings >> (BITS - depth) << (BITS - depth)
        return np.searchsorted(self.strings[tree], low, "left"), np.searchsorted(self.strings[tree], low + (np.int64(1) << (BITS - depth)), "left")

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """Which rows each query meets (queries x rows): the depth falls in all trees at once until ``wanted`` are met."""
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) / self.norm
        strings = [self._strings(lifted, k) for k in range(self.trees)]
        met = np.zeros((len(queries), len(self.ids)), bool)
        active = np.arange(len(queries))
        for depth in range(self._deepest(strings), -1, -1):
            ranges = [self._range(strings[k][active], k, depth) for k in range(self.trees)]
            # Ranges of different trees overlap, so only their sum can tell early that they are too few.
            enough = np.sum([end - begin for begin, end in ranges], axis=0) >= wanted
            for k, (begin, end) in enumerate(ranges):
                order = self.orders[k]
                for q, b, e in zip(active[enough].tolist(), begin[enough].tolist(), end[enough].tolist(), strict=True):
                    met[q, order[b:e]] = True
            active = active[met[active].sum(axis=1) < wanted]
            if not len(active):
                break
        return met

    def _deepest(self, strings: list[np.ndarray]) -> int:
        """The longest prefix that any query shares with any row in any tree."""
        best = 0
        for own, mine in zip(self.strings, strings, strict=True):
            at = np.searchsorted(own, mine)
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(own) - 1)):
                differ = own[side] ^ mine
                common = BITS - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64)
                best = max(best, int(common.max()))
        return min(best, BITS)


class Shard:
    """The rows of one shard in ranges of norms, with a forest for each range.

    Lifted by a norm far above their own, rows point the same way and their strings do not tell
    them apart, so a few large vectors must not lift all others. Every range is ascended until
    the share of it, and at least so many rows, are met; smaller ranges are met whole.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, seed: int, share: float, least: int) -> None:
        self.ids, self.vectors = ids, vectors
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        # Steps are counted down from the largest norm, so rows of equal norm are one range.
        steps = np.floor(np.log(norms.max() / norms) / np.log(NORM_STEP) + 1e-9)
        self.whole, self.forests = np.zeros(len(ids), bool), []
        for step in np.unique(steps):
            rows = np.flatnonzero(steps == step)
            wanted = max(least, int(share * len(rows)))
            if len(rows) <= wanted:
                self.whole[rows] = True
            else:
                self.forests.append((rows, wanted, Forest(ids[rows], vectors[rows], float(norms[rows].max()), trees, seed)))

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        met = np.repeat(self.whole[None, :], len(queries), axis=0)
        for rows, wanted, forest in self.forests:
            met[:, rows] = forest.candidates(queries, wanted)
        return met

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, row ids and inner products of the best ``k`` candidates, a step of queries at a time."""
        for at in range(0, len(queries), QUERY_STEP):
            part = queries[at : at + QUERY_STEP]
            score = part @ self.vectors.T
            score[~self.candidates(part)] = -np.inf
            score[query_ids[at : at + QUERY_STEP, None] == self.ids[None, :]] = -np.inf
            for q, row in zip(query_ids[at : at + QUERY_STEP], score, strict=True):
                good = np.flatnonzero(row > -np.inf)
                if len(good) > k:
                    # Ties at the border stay in, so that the smaller id can win.
                    border = np.partition(row[good], len(good) - k)[len(good) - k]
                    good = good[row[good] >= border]
                    good = good[np.lexsort((self.ids[good], -row[good]))[:k]]
                yield np.full(len(good), q), self.ids[good], row[good]


def nearest_by_product(
    vectors: DataFrame,
    is_query,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = TREES,
    share: float = SHARE,
    least: int = LEAST,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    seed: int = 23,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows found with the largest inner product, nearest first.

    ``is_query`` is a condition on ``id_col``; every other row is a candidate, ties go to the smaller
    id, and scores are inner products of the original vectors in doubles. Rows are dealt into
    shards of about ``shard_rows`` by a hash of the id, queries into parts of about ``query_rows``. A
    task builds the forest of one shard, and one part of the queries streams past it, so a
    task is bounded whatever the table. A query thus meets at least ``share`` of
    the rows and ``least`` rows of each range of norms of each shard. Null, zero or non-finite vectors, and null ids, take no
    part. Rows with one id are one candidate; the nearest of them counts.
    """
    rows = cut_lineage(valid_vectors(vectors, id_col, vector_col).filter("_id is not null"), "vectors")
    dimension(rows)
    count = rows.count()
    schema = "query_id bigint, vec_id bigint, score double"
    shards = max(1, -(-count // shard_rows))
    asked = rows.filter(is_query(F.col("_id")))
    parts = max(1, -(-asked.count() // query_rows))
    dealt = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select(dealt(shards).alias("shard"), every(parts).alias("part"), F.lit(0).alias("kind"), "_id", "_v")
    asked = asked.select(every(shards).alias("shard"), dealt(parts).alias("part"), F.lit(1).alias("kind"), "_id", "_v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts, forest = None, [], [], None
        for batch in batches:
            numbers, kinds = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if numbers[a] != shard:
                    shard, ids, parts, forest = numbers[a], [], [], None
                own, own_vectors = np.asarray(batch.column("_id").slice(a, b - a)), matrix(batch.column("_v").slice(a, b - a))
                if kinds[a] == 0:
                    ids.append(own)
                    parts.append(own_vectors)
                    continue
                if forest is None:
                    if not ids:
                        continue
                    forest = Shard(np.concatenate(ids), np.concatenate(parts), trees, seed, share, least)
                    ids, parts = [], []
                for q, v, s in forest.search(own, own_vectors, k):
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    tasks = data.union(asked).repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("shard", "kind", "_id")
    found = tasks.mapInArrow(search, schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
