"""Cross-entropy difference of two language models, per document.

Models over bytes are tables of bounded size. Models over the ids of a tokenizer grow with the corpus: their counts are grouped
by context in Spark and come back to the documents, so neither driver nor task holds a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import as_text, give_back, id_and_text, joined_bytes, steps, task_number
from logloom.llm.tokens import ENCODED_BYTES, encoder
from logloom.operators.numbering import cut_lineage

# Both models know the same symbols: the 256 bytes of UTF-8, and one for the start of a text.
SYMBOLS, START = 257, 256
ORDER = 3
# Target ids that are sent to every task at most; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
PAD = np.full(ORDER - 1, START, np.int64)
# Bits of one token id in a trigram, which is one 64-bit number. The start of a text is the id above all others.
ID_BITS = 21
TOKEN_START = (1 << ID_BITS) - 1
# Token ids whose trigrams a task puts together before they are shuffled, and that a bucket of contexts has on average.
PART_IDS = 2 << 20
# Counts from this on take more than 16 bits.
LARGE = (1 << 16) - 1
MODELS = ("target", "total")
SCHEMA = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"
COLUMNS = [column.split()[0] for column in SCHEMA.split(", ")]


def grams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each byte of each text, as a number, and the text of each."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(flat)) - offsets[:-1][owner]
    code = flat.astype(np.int64)
    one = np.where(place >= 1, np.concatenate([PAD[:1], code[:-1]])[: len(code)], START)
    two = np.where(place >= 2, np.concatenate([PAD[:2], code[:-2]])[: len(code)], START)
    return (two * SYMBOLS + one) * SYMBOLS + code, owner


class Model:
    """An interpolated trigram model (Witten-Bell) from trigram counts.

    p(c | a b) = (n(abc) + t(ab) p(c | b)) / (n(ab) + t(ab)), where t counts the different
    symbols seen after a context; the same rule leads from pairs to single bytes and to 1/256.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        counts = counts.astype(np.float64)
        pair_of, last = keys // SYMBOLS, keys % SYMBOLS
        middle = pair_of % SYMBOLS
        single = np.bincount(last, counts, SYMBOLS)[:256]
        kinds = np.count_nonzero(single)
        base = (single + kinds / 256) / (single.sum() + kinds) if kinds else np.full(256, 1 / 256)
        bigram = np.bincount(middle * SYMBOLS + last, counts, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)[:, :256]
        seen, kinds = bigram.sum(axis=1, keepdims=True), np.count_nonzero(bigram, axis=1)[:, None]
        self.pairs = (bigram + np.maximum(kinds, 1) * base) / (seen + np.maximum(kinds, 1))
        self.total = np.bincount(pair_of, counts, SYMBOLS * SYMBOLS)
        self.kinds = np.maximum(np.bincount(pair_of, minlength=SYMBOLS * SYMBOLS), 1)
        self.keys, self.counts = keys, counts

    def losses(self, first: int) -> np.ndarray:
        """-log2 p(c | first b) for all b (257) and c (256)."""
        rows = slice(first * SYMBOLS, (first + 1) * SYMBOLS)
        own = np.zeros((SYMBOLS, SYMBOLS))
        a, b = np.searchsorted(self.keys, [first * SYMBOLS * SYMBOLS, (first + 1) * SYMBOLS * SYMBOLS])
        own.reshape(-1)[self.keys[a:b] - first * SYMBOLS * SYMBOLS] = self.counts[a:b]
        kinds = self.kinds[rows, None]
        return -np.log2((own[:, :256] + kinds * self.pairs) / (self.total[rows, None] + kinds))


def loss_tables(target: Model, background: Model) -> tuple[np.ndarray, np.ndarray]:
    """Losses of every trigram under both models (257 x 257 x 257 singles, 68 MB each at any input size)."""
    out = [np.zeros((SYMBOLS, SYMBOLS, SYMBOLS), np.float32) for _ in range(2)]
    for first in range(SYMBOLS):
        for table, model in zip(out, (target, background), strict=True):
            table[first, :, :256] = model.losses(first)
    return out[0].reshape(-1), out[1].reshape(-1)


def count_grams(rows: DataFrame) -> DataFrame:
    """``gram, target, total`` over all rows of ``(_id, _text, _in)``: summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(0, np.int64)] * 3

        def merged(keys: np.ndarray, inside: np.ndarray, every: np.ndarray) -> list[np.ndarray]:
            keys, which = np.unique(np.concatenate([totals[0], keys]), return_inverse=True)
            return [
                keys,
                np.bincount(which, np.concatenate([totals[1], inside]), len(keys)).astype(np.int64),
                np.bincount(which, np.concatenate([totals[2], every]), len(keys)).astype(np.int64),
            ]

        dense = np.zeros((2, SYMBOLS**ORDER), np.int32)
        waiting = 0
        for batch in steps(batches, limit=1 << 20):
            flat, offsets = joined_bytes(batch.column("_text"))
            keys, owner = grams(flat, offsets)
            inside = np.asarray(batch.column("_in").to_numpy(zero_copy_only=False), bool)[owner]
            for row, part in zip(dense, (keys[inside], keys), strict=True):
                found, n = np.unique(part, return_counts=True)
                row[found] += n.astype(np.int32)
            waiting += len(keys)
            if waiting > 1 << 30:  # before a 32-bit sum could overflow
                some = np.flatnonzero(dense[1])
                totals, waiting = merged(some, dense[0, some], dense[1, some]), 0
                dense[:] = 0
        some = np.flatnonzero(dense[1])
        totals = merged(some, dense[0, some], dense[1, some])
        if len(totals[0]):
            yield pa.RecordBatch.from_arrays([pa.array(t) for t in totals], names=["gram", "target", "total"])

    parts = rows.mapInArrow(run, "gram bigint, target bigint, total bigint")
    return parts.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("total").alias("total"))


def token_parts(rows: DataFrame, tokenizer: str, id_type: str) -> DataFrame:
    """``part, doc_ids, inside, sizes, ids``, stored: ``PART_IDS`` token ids or some more of the rows ``(_id, _text, _in)`` of a task."""
    limit = PART_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), task_number()[0] << 32
        held, waiting = [], 0

        def row() -> pa.RecordBatch:
            columns = [pa.concat_arrays([h[i] for h in held]) for i in range(3)]
            lists = [pa.ListArray.from_arrays([0, len(c)], c) for c in columns]
            ids = pa.array([zstandard.compress(b"".join(h[3] for h in held), 3)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([part]), *lists, ids], names=["part", "doc_ids", "inside", "sizes", "ids"])

        for batch in steps(batches, limit=ENCODED_BYTES):
            ids, ends = encode.encode(as_text(batch.column("_text")))
            held.append((batch.column("_id"), batch.column("_in"), pa.array(np.diff(ends)), ids.astype(id_type).tobytes()))
            waiting += len(ids)
            if waiting >= limit:
                yield row()
                part, held, waiting = part + 1, [], 0
        if held:
            yield row()
        # The same worker goes on to sort trigrams.
        encode.known.clear()
        give_back()

    return cut_lineage(rows.mapInArrow(run, "part bigint, doc_ids array<bigint>, inside array<boolean>, sizes array<bigint>, ids binary"), "token-ids")


def token_grams(ids: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` ids at each id of texts of ``sizes``, as one number."""
    code = ids.astype(np.int64)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = code.copy()
    for back in range(1, order):
        before = np.full(len(code), TOKEN_START, np.int64)
        before[back:] = code[:-back]
        out |= np.where(place >= back, before, TOKEN_START) << (ID_BITS * back)
    return out


def _read_parts(batches: Iterator[pa.RecordBatch], id_type: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, ids, sizes of its texts, and which ids are of the target."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, inside = (np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in ("sizes", "inside"))
            yield batch.column("part")[i].as_py(), np.frombuffer(zstandard.decompress(batch.column("ids")[i].as_buffer()), id_type), sizes, np.repeat(inside.astype(bool), sizes)
    give_back()


def _counted(grams: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams in order, how often each stands in the target, and how often at all."""
    # A gram has 63 bits; numbers are sorted much faster than places.
    held = np.sort(grams.astype(np.uint64) << np.uint64(1) | inside)
    keys = held >> np.uint64(1)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    before = np.append(0, np.cumsum((held & np.uint64(1)).astype(np.int64)))
    ends = np.append(heads[1:], len(held))[: len(heads)]
    return keys[heads].astype(np.int64), before[ends] - before[heads], ends - heads


def part_pairs(parts: DataFrame, id_type: str) -> DataFrame:
    """``part, gram, target, total`` for each pair of ids in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, sizes, inside in _read_parts(batches, id_type):
            found, target, total = _counted(token_grams(ids, sizes, 2), inside)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(found), part), found, target, total)], names=["part", "gram", *MODELS])

    return parts.mapInArrow(run, "part bigint, gram bigint, target bigint, total bigint")


def _contexts(grams: DataFrame, name: str) -> DataFrame:
    """``name``, and for both models how often a context was seen and with how many different ids (1 if with none)."""
    sums = [F.sum(m).alias(f"{m}_seen") for m in MODELS]
    kinds = [F.greatest(F.count_if(F.col(m) > 0), F.lit(1)).alias(f"{m}_kinds") for m in MODELS]
    return grams.groupBy(F.shiftright("gram", ID_BITS).alias(name)).agg(*sums, *kinds)


def _smoothed(model: str, shorter: Column) -> Column:
    """Witten-Bell: the counts of a gram, and the probability of its shorter one as often as its context has kinds."""
    kinds = F.col(f"{model}_kinds")
    return (F.col(model) + kinds * shorter) / (F.col(f"{model}_seen") + kinds)


def pair_probabilities(pairs: DataFrame, symbols: int) -> DataFrame:
    """``gram, target, total``: p(c | b) under both models from the stored counts of all pairs, over a uniform base of ``symbols`` ids.

    A context has at most as many rows here as there are ids, whatever the input.
    """
    last = F.col("gram").bitwiseAND((1 << ID_BITS) - 1)
    single = pairs.groupBy(last.alias("gram")).agg(*[F.sum(m).alias(m) for m in MODELS])
    # One row: the sums over all ids.
    single = single.join(F.broadcast(_contexts(single, "_all").drop("_all")))
    single = single.select(F.col("gram").alias("_last"), *[_smoothed(m, F.lit(1.0) / F.lit(symbols)).alias(f"{m}_p") for m in MODELS])
    found = pairs.withColumns({"_last": last, "_first": F.shiftright("gram", ID_BITS)}).join(_contexts(pairs, "_first"), "_first").join(single, "_last")
    return found.select("gram", *[_smoothed(m, F.col(f"{m}_p")).cast("float").alias(m) for m in MODELS])


def _planes(values: np.ndarray) -> bytes:
    """The first byte of all numbers, then the second of all, and so on: like bytes stand together."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(dtype).reshape(n).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, compressed: 16 bits of each number, and the whole number where it needs more."""
    return zstandard.compress(b"".join(_planes(np.minimum(c, LARGE).astype("<u2")) + _planes(c[c >= LARGE].astype("<i8")) for c in columns), 1)


def _unpacked(data: pa.Scalar, *sizes: int) -> Iterator[np.ndarray]:
    held, at = zstandard.decompress(data.as_buffer()), 0
    for n in sizes:
        out = _from_planes(held, "<u2", n, at)
        large = out == LARGE
        more = np.count_nonzero(large)
        out[large] = _from_planes(held, "<i8", more, at + 2 * n)
        at += 2 * n + 8 * more
        yield out


def _buckets_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """All grams of a context fall into one bucket."""
    mixed = (grams >> ID_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(found: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its grams, in order."""
    bucket = _buckets_of(found, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for i, (low, high) in enumerate(zip([0, *ends], ends)):
        if high > low:
            yield i, order[low:high]


def _runs(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of sorted grams, and how many grams each has."""
    return np.unique(grams >> ID_BITS, return_counts=True)


def _trigram_counts(parts: DataFrame, id_type: str, buckets: int) -> DataFrame:
    """``part, bucket, counts``: for the trigrams of a part in a bucket, in order, how often each was seen in all parts, and for
    their contexts how often those were seen and with how many ids (1 if with none), all for both models.

    The trigrams of a context meet in one bucket. A part sends each of its trigrams once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, sizes, inside in _read_parts(batches, id_type):
            found, target, total = _counted(token_grams(ids, sizes, ORDER), inside)
            rows = []
            for bucket, some in _by_bucket(found, buckets):
                contexts, runs = _runs(found[some])
                gaps = _planes(np.diff(contexts, prepend=0))
                rows.append((bucket, part, len(some), zstandard.compress(gaps, 1), _packed(runs, found[some] & TOKEN_START, target[some], total[some])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "part", "n", "contexts", "numbers"])

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sizes = rows["n"].to_pylist()
        grams, counts = [], [[], []]
        for i, n in enumerate(sizes):
            gaps = zstandard.decompress(rows["contexts"][i].as_buffer())
            contexts = np.cumsum(_from_planes(gaps, "<i8", len(gaps) // 8, 0))
            runs, last, *each = _unpacked(rows["numbers"][i], len(contexts), n, n, n)
            grams.append(np.repeat(contexts, runs) << ID_BITS | last)
            for held, more in zip(counts, each, strict=True):
                held.append(more)
        found, which = np.unique(np.concatenate(grams), return_inverse=True)
        contexts, context = np.unique(found >> ID_BITS, return_inverse=True)
        own = [np.bincount(which, np.concatenate(c), len(found)).astype(np.int64) for c in counts]
        seen = [np.bincount(context, c).astype(np.int64) for c in own]
        kinds = [np.maximum(np.bincount(context, c > 0), 1).astype(np.int64) for c in own]
        told, start = [], 0
        for each, n in zip(grams, sizes, strict=True):
            here, start = which[start : start + n], start + n
            at = np.searchsorted(contexts, _runs(each)[0])
            told.append(_packed(*[c[here] for c in own], *[c[at] for c in (*seen, *kinds)]))
        give_back()
        return pa.Table.from_arrays([rows["part"], rows["bucket"], pa.array(told, pa.binary())], names=["part", "bucket", "counts"])

    sent = parts.mapInArrow(send, "bucket bigint, part bigint, n bigint, contexts binary, numbers binary")
    return sent.groupBy("bucket").applyInArrow(answer, "part bigint, bucket bigint, counts binary")


def score_tokens(rows: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of :func:`score_documents` for ``(_id, _text, _in)``, in bits per token id of ``tokenizer``.

    The rule is that of :class:`Model`. Pairs of ids are counted in one table, which parts join for p(c | b). Trigrams go once
    from each part to the bucket of their context, of ``PART_IDS`` ids on average, and what their counts say comes back; a part puts both
    together and sums them per document.
    """
    from tokenizers import Tokenizer

    symbols = Tokenizer.from_file(tokenizer).get_vocab_size()
    if symbols >= TOKEN_START:
        raise ValueError(f"a tokenizer of fewer than {TOKEN_START} ids is needed")
    id_type = "<u2" if symbols <= 1 << 16 else "<u4"
    parts = token_parts(rows, tokenizer, id_type)
    n_ids = parts.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_ids // (np.dtype(id_type).itemsize * PART_IDS)))
    in_parts = part_pairs(parts, id_type)
    pairs = cut_lineage(in_parts.groupBy("gram").agg(*[F.sum(m).alias(m) for m in MODELS]), "pairs")
    of_pairs = in_parts.select("part", "gram").join(pair_probabilities(pairs, symbols), "gram").select("part", F.col("gram").alias("key"), *MODELS)
    of_grams = _trigram_counts(parts, id_type, buckets).withColumnRenamed("bucket", "key")
    answers = of_pairs.unionByName(of_grams, allowMissingColumns=True)

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs, told = docs.combine_chunks(), told.combine_chunks()
        [(_, ids, sizes, _)] = _read_parts(docs.to_batches(), id_type)
        is_pair = told["counts"].is_null()
        pairs, grams = told.filter(is_pair).sort_by("key"), told.filter(pc.invert(is_pair))
        found, at_gram = np.unique(token_grams(ids, sizes, ORDER), return_inverse=True)
        at_pair = np.searchsorted(pairs["key"].to_numpy(), found & ((1 << 2 * ID_BITS) - 1))
        # What the counts of a trigram add to p(c | a b), and the weight of p(c | b).
        adds, weights = np.zeros((2, len(MODELS), len(found)))
        of_bucket = dict(zip(grams["key"].to_pylist(), grams["counts"].to_pylist(), strict=True))
        for bucket, some in _by_bucket(found, buckets):
            _, runs = _runs(found[some])
            counts = list(_unpacked(pa.scalar(of_bucket[bucket]), *[len(some)] * 2, *[len(runs)] * 4))
            for k, (own, seen, kinds) in enumerate(zip(counts[:2], counts[2:4], counts[4:], strict=True)):
                adds[k, some] = own / np.repeat(seen + kinds, runs)
                weights[k, some] = np.repeat(kinds / (seen + kinds), runs)
        owner, losses = np.repeat(np.arange(len(sizes)), sizes), []
        for model, add, weight in zip(MODELS, adds, weights, strict=True):
            p = add + weight * pairs[model].to_numpy()[at_pair] if len(ids) else np.zeros(0)
            losses.append(np.bincount(owner, -np.log2(p)[at_gram], len(sizes)) / np.maximum(sizes, 1))
        own, other = losses
        empty = sizes == 0
        return pa.Table.from_arrays(
            [docs["doc_ids"][0].values, pa.array(sizes), pa.array(own, mask=empty), pa.array(other, mask=empty), pa.array(own - other, mask=empty)],
            names=COLUMNS,
        )

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, SCHEMA)


def score_documents(
    docs: DataFrame, in_target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score``: bits per token under both models, and their difference.

    The background model is counted over all documents, the target model over those whose id is in
    ``in_target`` (one column); order, symbols and smoothing are the same. A lower score is
    closer to the target. Tokens are the ids of the file ``tokenizer``, without special tokens, or bytes. Byte
    trigrams are at most 257^3 whatever the input, so their counts pass the driver within a fixed bound; those of ids
    stay in tables. Empty or null text has no tokens and null losses. An empty target gives a uniform target
    model. A row per input row.
    """
    chosen = in_target.select(F.col(in_target.columns[0]).cast("bigint").alias("_t")).filter("_t is not null").distinct()
    chosen = cut_lineage(chosen, "target-ids")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    rows = id_and_text(docs, id_col, text_col)
    marked = rows.join(chosen, rows["_id"] == chosen["_t"], "left").select("_id", "_text", F.col("_t").isNotNull().alias("_in"))
    if tokenizer is not None:
        return score_tokens(marked, tokenizer)
    counts = count_grams(marked).orderBy("gram").toArrow()
    keys, target, total = (np.asarray(counts.column(c).combine_chunks()) for c in ("gram", "target", "total"))
    some = target > 0
    session = docs.sparkSession
    models = session.sparkContext.broadcast((keys[some], target[some], keys, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in steps(batches, limit=1 << 20):
            if tables is None:
                a, b, c, d = models.value
                tables = loss_tables(Model(a, b), Model(c, d))
            flat, offsets = joined_bytes(batch.column("_text"))
            keys, owner = grams(flat, offsets)
            sizes = np.diff(offsets)
            own, other = (np.bincount(owner, t[keys], len(sizes)) / np.maximum(sizes, 1) for t in tables)
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes), pa.array(own, mask=empty), pa.array(other, mask=empty), pa.array(own - other, mask=empty)],
                names=COLUMNS,
            )

    return rows.mapInArrow(run, SCHEMA)
