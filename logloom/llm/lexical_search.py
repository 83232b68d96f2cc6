"""Ranked lexical search: upper bounds from hashed max-sketches, then exact scores in descending order of the bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import id_and_text, joined_bytes, ragged, steps
from logloom.llm.words import Words, equal_bytes, hash_of, words_of
from logloom.operators.numbering import cut_lineage

# A document's sketch has so many cells for each of its distinct terms; a term is written to and read from so many of them.
CELLS, COPIES = 16, 6
# The threshold comes from so many times k documents of each item, those with the highest bounds.
SEEDS = 4
# An impact is below 1,000,000; a cell holds it in steps of 4096, rounded up.
STEP_BITS = 12
# Items, and distinct terms of them, that are searched in one pass; more items take further passes.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 100_000
# Bytes of text or sketches, cells and scores that a task works on at a time.
SCORED_BYTES, LOOKUPS, SCORES = 2 << 20, 1 << 18, 1 << 21
INDEX = "doc_id bigint, n_terms bigint, sketch binary, text binary"


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """100 - 90 + (90 * n * N) div L of documents with n terms."""
        if len(n) and 90 * int(n.max()) * self.documents >= 1 << 63:
            share = np.array([90 * int(x) * self.documents // self.terms for x in n], np.int64)
        else:
            share = 90 * n * self.documents // max(self.terms, 1)
        return 100 - 90 + share

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(1000000000 * tf) div (1000 * tf + 8 * m), by the term's and the document's counts."""
        return 1_000_000_000 * tf // (1000 * tf + 8 * self.lengths(n))


class Queries:
    """A block of items: their distinct terms in order of the hash, weights, and the items of each term."""

    def __init__(self, items: list[tuple[int, list[bytes]]]) -> None:
        self.items = [item for item, _ in items]
        known = sorted({t for _, terms in items for t in terms})
        flat = np.frombuffer(b"".join(known), np.uint8)
        sizes = np.array(list(map(len, known)), np.int64)
        hashes = hash_of(flat, np.cumsum(sizes) - sizes, sizes) if known else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.terms = [known[i] for i in order]
        self.hashes, self.sizes = hashes[order], sizes[order]
        self.text, self.starts = flat, (np.cumsum(sizes) - sizes)[order]
        self.weights = np.zeros(len(known), np.int64)
        place = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((place[t], number) for number, (_, terms) in enumerate(items) for t in set(terms))
        self.posted = np.array([n for _, n in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(known) + 1))

    def weigh(self, corpus: Corpus, df: np.ndarray) -> None:
        """floor(1000 ln((2N + 2) / (2df + 1))) of each term; never negative."""
        top = 2 * corpus.documents + 2
        self.weights = np.array([math.floor(1000 * math.log(top / (2 * n + 1))) for n in df.tolist()], np.int64)

    def counted(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and occurrences of every term of the block in the texts."""
        none = np.zeros(0, np.int64)
        if not len(words.starts) or not self.terms:
            return none, none, none
        hashes = hash_of(words.text, words.starts, words.sizes)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[spot] == hashes)
        owner, spot = words.owner[met], spot[met]
        same = equal_bytes(words.text, words.starts[met], words.sizes[met], self.text, self.starts[spot], self.sizes[spot])
        for j in np.flatnonzero(~same).tolist():  # another term of the same hash
            word, s = words.word(met[j]), spot[j]
            while s < len(self.terms) and self.hashes[s] == hashes[met[j]]:
                if self.terms[s] == word:
                    spot[j], same[j] = s, True
                s += 1
        pair, tf = np.unique(owner[same] * len(self.terms) + spot[same], return_counts=True)
        return pair // len(self.terms), pair % len(self.terms), tf

    def summed(self, texts: int, text: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Sum of weight * impact for each text and item. The sums stay far below 2 ** 53."""
        sizes = np.diff(self.first)[term]
        item = self.posted[ragged(self.first[:-1][term], sizes)]
        cell = np.repeat(text * len(self.items), sizes) + item
        total = np.bincount(cell, np.repeat((self.weights[term] * impact).astype(np.float64), sizes), texts * len(self.items))
        return total.astype(np.int64).reshape(texts, len(self.items))

    def scores(self, words: Words, corpus: Corpus) -> np.ndarray:
        """Exact scores of the texts for all items of the block."""
        text, term, tf = self.counted(words)
        return self.summed(len(words.counts), text, term, corpus.impacts(tf, words.counts[text]))

    def bounds(self, sketches: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, from the sketches ``sketches[ends[i]:ends[i + 1]]`` alone."""
        texts, out = len(ends) - 1, []
        mixed = [mix(self.hashes, copy) for copy in range(COPIES)]
        rows = max(1, LOOKUPS // max(1, len(self.terms)))
        for at in range(0, texts, rows):
            begin, cells = ends[at : at + rows + 1][:-1], np.diff(ends[at : at + rows + 1])
            first = sketches[begin[:, None] + cell_of(mixed[0], cells[:, None])]
            text, term = np.nonzero(first)
            least = first[text, term]
            for copy in range(1, COPIES):  # most terms are absent, and most of those have left by now
                least = np.minimum(least, sketches[begin[text] + cell_of(mixed[copy][term], cells[text])])
                left = np.flatnonzero(least)
                text, term, least = text[left], term[left], least[left]
            out.append(self.summed(len(begin), text, term, least.astype(np.int64) << STEP_BITS))
        return np.concatenate(out) if out else np.zeros((0, len(self.items)), np.int64)


def mix(hashes: np.ndarray, copy: int) -> np.ndarray:
    """32 bits of each hash that tell its cell in one copy."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (low + np.uint64(copy) * high) & np.uint64(0xFFFFFFFF)


def cell_of(mixed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell in a sketch of ``cells`` cells."""
    return (mixed * cells.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def sketch(words: Words, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of the texts one after the other, and the offsets of each."""
    hashes = hash_of(words.text, words.starts, words.sizes)
    owner = words.owner
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tf = np.diff(np.append(head, len(order)))
    hashes, owner = hashes[head], owner[head]
    impact = (corpus.impacts(tf, words.counts[owner]) + (1 << STEP_BITS) - 1 >> STEP_BITS).astype(np.uint8)
    cells = CELLS * np.bincount(owner, minlength=len(words.counts))
    ends = np.concatenate([[0], np.cumsum(cells)])
    out = np.zeros(ends[-1], np.uint8)
    for copy in range(COPIES):
        np.maximum.at(out, ends[owner] + cell_of(mix(hashes, copy), cells[owner]), impact)
    return out, ends


def corpus_statistics(docs: DataFrame, *, text_col: str = "text") -> Corpus:
    """N and L over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in steps(batches):
            counts = words_of(*joined_bytes(batch.column("_text"))).counts
            documents, terms = documents + int(np.count_nonzero(counts)), terms + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    texts = docs.select(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("_text"))
    total = texts.mapInArrow(run, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    return Corpus(int(total[0] or 0), int(total[1] or 0))


def build_index(docs: DataFrame, corpus: Corpus, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_terms, sketch, text, _row`` of every document with a term, numbered; written to the shared folder.

    A sketch has 16 cells for each distinct term; every term's impact is folded into six of them, a
    cell keeping the largest. The least of a term's six cells is never below its impact, and 0 for all but one
    in a thousand terms that the document lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=SCORED_BYTES):
            words = words_of(*joined_bytes(batch.column("_text")))
            flat, ends = sketch(words, corpus)
            sketches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
            every = pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(words.counts.astype(np.int64)), sketches.cast(pa.binary()), batch.column("_text")],
                names=["doc_id", "n_terms", "sketch", "text"],
            )
            yield every.filter(pa.array(words.counts > 0))

    rows = id_and_text(docs, id_col, text_col).mapInArrow(run, INDEX)
    return cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()), "sketches")


def document_frequency(index: DataFrame, queries: Queries) -> np.ndarray:
    """In how many documents each term of the block occurs; a task sends one row per term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries.terms), np.int64)
        for batch in steps(batches, "text", SCORED_BYTES):
            total += np.bincount(queries.counted(words_of(*joined_bytes(batch.column("text"))))[1], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "n"])

    out = np.zeros(len(queries.terms), np.int64)
    # As many rows as a block has terms at most.
    for term, n in index.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class Best:
    """The highest scores of every item that one task has met; ties go to the smaller id, null ids last."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k, self.floor = k, least.copy()
        self.rows: list[list[tuple]] = [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[item]
        rows += [(-s, i is None, i or 0, i) for s, i in zip(scores.tolist(), ids, strict=True)]
        rows.sort(key=lambda r: r[:3])
        del rows[self.k :]
        if len(rows) == self.k:
            self.floor[item] = max(self.floor[item], -rows[-1][0])


def _largest_bounds(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """For every item the ``k`` documents of each task with the highest bounds; reads sketches only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.items), k, np.ones(len(queries.items), np.int64))
        for batch in scored_steps(batches, "sketch", len(queries.items)):
            bounds = queries.bounds(*joined_bytes(batch.column("sketch")))
            rows = np.array(batch.column("_row").to_pylist(), np.int64)
            for item in np.flatnonzero((bounds >= best.floor).any(0)).tolist():
                held = np.flatnonzero(bounds[:, item] >= best.floor[item])
                held = held[np.argsort(-bounds[held, item], kind="stable")[:k]]
                best.add(item, bounds[held, item], rows[held].tolist())
        yield _table_of(best, ["item", "_row", "bound"])

    return index.select("_row", "sketch").mapInArrow(run, "item bigint, _row bigint, bound bigint")


def scored_steps(batches: Iterator[pa.RecordBatch], column: str, items: int) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes, and of bounded rows times items."""
    rows = max(1, SCORES // max(1, items))
    for batch in steps(batches, column, SCORED_BYTES):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _table_of(best: Best, names: list[str]) -> pa.RecordBatch:
    every = [(item, r[3], -r[0]) for item, rows in enumerate(best.rows) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in every], pa.int64()) for j in range(3)], names=names)


def _thresholds(index: DataFrame, queries: Queries, corpus: Corpus, k: int) -> np.ndarray:
    """A score that k documents reach, for every item: the k-th exact score of those with the highest bounds, else 1."""
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "_row")
    first = _largest_bounds(index, queries, SEEDS * k).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SEEDS * k)
    chosen = first.select("_row").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.items), k, np.ones(len(queries.items), np.int64))
        for batch in scored_steps(batches, "text", len(queries.items)):
            scores = queries.scores(words_of(*joined_bytes(batch.column("text"))), corpus)
            for item in np.flatnonzero((scores >= best.floor).any(0)).tolist():
                held = np.flatnonzero(scores[:, item] >= best.floor[item])
                best.add(item, scores[held, item], held.tolist())
        yield _table_of(best, ["item", "_row", "score"])

    # SEEDS * k rows for every item of the block at most.
    texts = index.select("_row", "text").join(F.broadcast(chosen), "_row").select("text")
    kept = texts.mapInArrow(run, "item bigint, _row bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = kept.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == k)
    out = np.ones(len(queries.items), np.int64)
    for item, score in kth.select("item", "score").collect():
        out[item] = max(1, score)
    return out


def _exact_best(index: DataFrame, queries: Queries, corpus: Corpus, k: int, least: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: what each task holds of the ``k`` best; documents are scored while their bound reaches the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.items), k, least)
        for batch in scored_steps(batches, "text", len(queries.items)):
            bounds = queries.bounds(*joined_bytes(batch.column("sketch")))
            flat, offsets = joined_bytes(batch.column("text"))
            ids, scored = batch.column("doc_id").to_pylist(), np.zeros(batch.num_rows, bool)
            while True:
                reach = (bounds >= best.floor) & ~scored[:, None]
                items = np.flatnonzero(reach.any(0))
                if not len(items):
                    break
                # The highest bounds of every item come first; the threshold then rises for all.
                ahead = np.where(reach[:, items], bounds[:, items], -1)
                k_here = min(k, len(ahead))
                top = np.argpartition(-ahead, k_here - 1, axis=0)[:k_here]
                chosen = np.unique(top[np.take_along_axis(ahead, top, 0) >= 0])
                scored[chosen] = True
                sizes = np.diff(offsets)[chosen]
                texts = flat[ragged(offsets[:-1][chosen], sizes)]
                scores = queries.scores(words_of(texts, np.concatenate([[0], np.cumsum(sizes)])), corpus)
                for item in np.flatnonzero((scores >= best.floor).any(0)).tolist():
                    held = np.flatnonzero(scores[:, item] >= best.floor[item])
                    best.add(item, scores[held, item], [ids[j] for j in chosen[held].tolist()])
        yield _table_of(best, ["item", "doc_id", "score"])

    return index.select("doc_id", "sketch", "text").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def blocks_of_items(items: DataFrame, item_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with their distinct terms, in blocks of ``most_items`` and about ``most_terms``; read piece by piece."""
    block, size = [], 0
    chosen = items.select(items[item_col].cast("bigint").alias("_id"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("_text"))
    for item, text in chosen.orderBy("_id", "_text").toLocalIterator():
        raw = np.frombuffer(text.encode(), np.uint8)
        words = words_of(raw, np.array([0, len(raw)]))
        terms = sorted({words.word(i) for i in range(len(words.starts))})
        if block and (size + len(terms) > most_terms or len(block) == most_items):
            yield block
            block, size = [], 0
        block.append((item, terms))
        size += len(terms)
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for every item.

    The score sums floor(1000 ln((2N+2)/(2df+1))) * ((10^9 tf) div (1000 tf + 8 m)) over the item's
    distinct terms, with m = 10 + (90 n N) div L, in whole numbers. Items are answered in blocks of
    ``block_items`` items and ``block_terms`` distinct terms. For each block the sketches give every document an upper
    bound; the documents with the highest bounds give a threshold; then each task scores documents from
    their texts in descending order of the bound until no bound reaches its threshold, which rises as it goes.
    Results are exact.

    Equal scores go by the smaller id, null ids last. Null and empty texts have no term: such
    documents are in no result, such items get none. Whole texts count, however long. A row of
    either table that stands twice counts, and is answered, twice. An empty table gives an empty
    result. Other columns are not read.
    """
    spark, answers = docs.sparkSession, []
    corpus = corpus_statistics(docs, text_col=text_col)
    index = build_index(docs, corpus, id_col=id_col, text_col=text_col)
    for block in blocks_of_items(items, item_col, query_col, block_items, block_terms):
        queries = Queries(block)
        queries.weigh(corpus, document_frequency(index, queries))
        least = _thresholds(index, queries, corpus, k)
        held = _exact_best(index, queries, corpus, k, least).withColumn("_part", F.spark_partition_id() % 512)
        # What many tasks hold of one item meets in two steps.
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        held = held.withColumn("_n", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).filter(F.col("_n") <= k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order)).alias("rank")
        ranked = held.select("item", rank, "doc_id", "score").filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(queries.items)], "item bigint, item_id bigint")
        answers.append(cut_lineage(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "answers"))
    if not answers:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = answers[0]
    for more in answers[1:]:
        every = every.union(more)
    return every
