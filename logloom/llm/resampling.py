"""Target-distribution importance resampling: hashed n-gram weights, and the highest perturbed weights by radix sort."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import id_and_text, joined_bytes, steps
from logloom.llm.radix_sort import sorted_positions
from logloom.llm.words import crc32_of, runs_of_words, words_of
from logloom.operators.numbering import cut_lineage


def bucket_counts(docs: DataFrame, text_col: str, longest_run: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in steps(batches):
            words = words_of(*joined_bytes(batch.column("_text")))
            starts, sizes, _ = runs_of_words(words, longest_run)
            total += np.bincount(crc32_of(words.text, starts, sizes) % buckets, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    texts = docs.select(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("_text"))
    out = np.zeros(buckets, np.int64)
    # At most ``buckets`` rows, a parameter.
    for bucket, n in texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, one added to each count."""
    buckets, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_corpus + buckets) / ((s + 1) * (all_target + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def perturbation(seed: int, doc_id: int | None) -> int:
    """floor(1000 times a Gumbel number) that depends on seed and id alone; a null id counts as an empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest_run: int, seed: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document: the sum of its features' gains, and that plus the perturbation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = words_of(*joined_bytes(batch.column("_text")))
            starts, sizes, owner = runs_of_words(words, longest_run)
            each = gain[crc32_of(words.text, starts, sizes) % len(gain)]
            features = np.bincount(owner, minlength=batch.num_rows)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, owner, each)
            ids = batch.column("_id")
            score = weight + np.array([perturbation(seed, i) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (words.counts.astype(np.int64), features.astype(np.int64), weight, score))],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    kinds = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, kinds)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    longest_run: int = 2,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    **sort,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn.

    Features are runs of 1 to ``longest_run`` words, hashed into ``buckets``. A document's
    weight sums floor(1000 ln(share in ``target`` / share in ``docs``)) over its features. Of the
    documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) with the
    highest weight plus Gumbel noise are drawn, that is, without replacement in proportion to
    their weights; equal scores go by the smaller id, null ids after all others. Ranks come from
    :func:`sorted_positions`, which takes ``sort``.

    Null and empty texts have no features and weight 0; whole texts count, however long. A
    row that stands twice is weighed and drawn twice. Empty ``docs`` give no row; an empty
    ``target`` makes frequent features cheap. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, longest_run, buckets), bucket_counts(target, target_col, longest_run, buckets))
    scored = cut_lineage(weigh(docs, gain, longest_run, seed, id_col=id_col, text_col=text_col), "weighed")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    keyed = scored.filter(able).withColumns(
        {"_down": -F.col("score"), "_null": F.col("doc_id").isNull().cast("int"), "_id": F.coalesce("doc_id", F.lit(0)).cast("bigint")}
    )
    ranked = sorted_positions(keyed, ["_down", "_null", "_id"], **sort)
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).cast("bigint").alias("rank")
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*scored.columns, rank).unionByName(rest)
