"""Vectors of texts and their distance from the centroid.

Sparse TF-IDF vectors are long tables ``(template_idx, term, weight)``; dense ones
are an array column. ``texts`` is any table with ``template_idx`` and ``template``.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.vectors import dot, unit

MAX_TERMS = 500
# Terms whose tables may go to every task.
BROADCAST_TERMS = 100_000
_WORD = r"(?U)(\w+)"


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tfidf(texts: DataFrame, stop_words: list[str] | None = None, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(template_idx, term, weight)``: TF-IDF with smoothed idf, at length 1 per text.

    The ``max_terms`` most frequent terms stay, ties by name. They are found first,
    so that only their occurrences are shuffled by text; the term tables hold at most
    ``max_terms`` rows and are broadcast up to ``BROADCAST_TERMS`` of them.
    """
    stop = english_stop_words() if stop_words is None else list(stop_words)
    words = texts.select(
        "template_idx", F.explode(F.regexp_extract_all(F.lower("template"), F.lit(_WORD), F.lit(1))).alias("term")
    )
    if stop:
        words = words.filter(~F.col("term").isin(stop))
    kept = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(max_terms)
    small = F.broadcast if max_terms <= BROADCAST_TERMS else (lambda df: df)
    counts = (
        words.join(small(kept.select("term")), "term", "left_semi")
        .groupBy("template_idx", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.ln((F.lit(1) + total) / (F.lit(1) + F.col("df"))) + 1
    raw = counts.join(small(df), "term").select("template_idx", "term", (F.col("tf") * idf).alias("w"))
    # At most max_terms rows per text, summed in the order of terms: equal texts get equal weights to the last bit.
    by_term = Window.partitionBy("template_idx").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_term))
    return raw.select("template_idx", "term", (F.col("w") / norm).alias("weight"))


def sparse_distances(weights: DataFrame, texts: DataFrame) -> DataFrame:
    """``(template_idx, template, distance)`` to the normalised centroid of all texts.

    A text without any kept term has a zero vector, hence distance 1.
    """
    total = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    mean = weights.groupBy("term").agg((F.sum("weight") / total).alias("c"))
    length = mean.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l")).scalar()
    # One row per kept term: its size decides the join.
    centroid = mean.select("term", (F.col("c") / length).alias("c"))
    along = weights.join(centroid, "term").groupBy("template_idx").agg(F.sum(F.col("weight") * F.col("c")).alias("s"))
    return texts.join(along, "template_idx", "left").select(
        "template_idx", "template", (F.lit(1.0) - F.coalesce("s", F.lit(0.0))).alias("distance")
    )


def dense_from_sparse(weights: DataFrame, texts: DataFrame) -> DataFrame:
    """``(template_idx, template, vector)`` with one position per kept term, in term order."""
    # At most max_terms names.
    terms = weights.select("term").distinct().agg(F.array_sort(F.collect_list("term")).alias("t")).scalar()
    packed = weights.groupBy("template_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("by_term")
    )
    zero = F.lit(0.0)
    return texts.join(packed, "template_idx", "left").withColumn("terms", terms).select(
        "template_idx",
        "template",
        F.transform("terms", lambda t: F.coalesce(F.element_at("by_term", t), zero)).alias("vector"),
    )


def dense_vectors(df: DataFrame, idx: str, vector: str, template: Column | str | None = None) -> DataFrame:
    """``(template_idx, template, vector)`` from given embeddings, each scaled to length 1."""
    text = F.lit("") if template is None else (F.col(template) if isinstance(template, str) else template)
    return df.select(
        F.col(idx).cast("bigint").alias("template_idx"), text.alias("template"), unit(F.col(vector)).alias("vector")
    )


def _mean() -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))))


def centroid_by_label(vectors: DataFrame, label: str = "label") -> DataFrame:
    """``(label, centroid)``, normalised; labels below 0 are noise and have none."""
    named = vectors.filter(F.col(label) >= 0)
    return named.groupBy(F.col(label).alias("label")).agg(unit(_mean()).alias("centroid"))


def label_distances(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Add ``distance`` to the centroid of the own label; null for noise."""
    centroids = centroid_by_label(vectors, label).withColumnRenamed("label", "_label")
    joined = vectors.join(centroids, F.col(label) == F.col("_label"), "left")
    return joined.select(*vectors.columns, (F.lit(1.0) - dot(F.col("vector"), F.col("centroid"))).alias("distance"))


def dense_distances(vectors: DataFrame) -> DataFrame:
    """Add ``distance`` to the normalised centroid of all vectors."""
    # A column of its own first: a subquery may not stand inside a function over arrays.
    joined = vectors.withColumn("_center", vectors.agg(unit(_mean()).alias("c")).scalar())
    return joined.select(*vectors.columns, (F.lit(1.0) - dot(F.col("vector"), F.col("_center"))).alias("distance"))


def semantic_outliers(distances: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``is_outlier`` for distances above the threshold."""
    return distances.withColumn("is_outlier", F.col("distance") > threshold)


def semantic_anomalies(distances: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``(template_idx, template, distance, severity)`` of the rows beyond the threshold.

    Beyond one and a half times the threshold the severity is high.
    """
    far = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") > threshold)
    return distances.filter(far).select(
        "template_idx",
        "template",
        "distance",
        F.when(F.col("distance") > threshold * 1.5, "high").otherwise("medium").alias("severity"),
    )
