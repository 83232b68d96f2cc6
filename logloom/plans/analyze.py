"""One call from a log to all of its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import bursts as B
from logloom.operators import clustering as C
from logloom.operators import semantics as E
from logloom.operators import stats as S
from logloom.operators import templates as T
from logloom.operators import timeseries as W
from logloom.operators.numbering import cut_lineage
from logloom.sources.detect import read_numbered

SEMANTIC_SCHEMA = "template_idx bigint, template string, distance double, severity string"
MEMBER_SCHEMA = "template_idx bigint, template string, cluster bigint"


@dataclass
class Analysis:
    """The tables of one run: entries and findings stored, distributions and series lazy."""

    source: str
    entries: DataFrame
    template_stats: DataFrame
    time_series: DataFrame
    anomaly_windows: DataFrame
    bursts: DataFrame
    semantic_anomalies: DataFrame
    level_dist: DataFrame
    component_dist: DataFrame
    hour_dist: DataFrame
    cluster_members: DataFrame
    cluster_summaries: DataFrame
    summary: DataFrame


def analyze(
    entries: DataFrame,
    source: str = "log",
    similarity: float = 0.75,
    minutes: int = 5,
    threshold: float = 2.5,
    min_repeats: int = 5,
    burst_seconds: int = 10,
    semantic_threshold: float = 0.4,
    per: str = "version",
    cluster: bool = True,
    semantic: bool = True,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    stop_words: list[str] | None = None,
    lines_are_unique: bool = False,
) -> Analysis:
    """Mine templates, then derive every table from the stored entries.

    ``encoder`` maps ``(template_idx, template)`` to the same with a ``vector`` column
    of given embeddings; without it the vectors are TF-IDF. Vectors are made once and
    serve both the clusters and the semantic anomalies. ``lines_are_unique`` says that the lines need no check.
    """
    spark = entries.sparkSession
    parsed = cut_lineage(entries, "parsed")
    mined = T.mine_templates(parsed, similarity, lines_are_unique=lines_are_unique)
    rows = cut_lineage(W.temporal_features(T.attach_templates(parsed, mined), minutes), "entries")

    semantics = spark.createDataFrame([], SEMANTIC_SCHEMA)
    members = spark.createDataFrame([], MEMBER_SCHEMA)
    if cluster or semantic:
        texts = cut_lineage(T.distinct_templates(rows, per).select("template_idx", "template"), "texts")
        if encoder is None:
            weights = cut_lineage(E.tfidf(texts, stop_words), "weights")
            some = not weights.isEmpty()
            distances = E.sparse_distances(weights, texts) if some else None
            vectors = cut_lineage(E.dense_from_sparse(weights, texts), "vectors") if some and cluster else None
        else:
            vectors = cut_lineage(E.dense_vectors(encoder(texts), "template_idx", "vector", "template"), "vectors")
            distances = E.dense_distances(vectors)
        if semantic and distances is not None:
            semantics = E.semantic_anomalies(distances, semantic_threshold)
        if cluster and vectors is not None:
            labels = C.kmeans(vectors).withColumn("cluster", F.col("cluster").cast("bigint"))
            members = cut_lineage(texts.join(labels, "template_idx"), "members")

    # Results are small next to the log; stored, they serve the summary and the reports.
    stats = cut_lineage(S.template_stats(rows), "stats")
    anomalies = cut_lineage(W.anomaly_windows(rows, minutes, threshold), "anomalies")
    repeats = cut_lineage(B.repetition_bursts(rows, min_repeats, burst_seconds), "bursts")
    semantics = cut_lineage(semantics, "semantics")
    clusters = cut_lineage(S.cluster_summary(members), "clusters")
    summary = S.run_summary(S.pattern_summary(rows, stats), anomalies, repeats, semantics)
    return Analysis(
        source=source,
        entries=rows,
        template_stats=stats,
        time_series=W.time_series(rows, minutes),
        anomaly_windows=anomalies,
        bursts=repeats,
        semantic_anomalies=semantics,
        level_dist=S.level_distribution(rows),
        component_dist=S.component_distribution(rows),
        hour_dist=S.hour_distribution(rows),
        cluster_members=members,
        cluster_summaries=clusters,
        summary=cut_lineage(summary, "summary"),
    )


def analyze_path(spark: SparkSession, path: str | list[str], year: int | None = None, readers=None, **options) -> Analysis:
    """The same from a log of any known format: a file, a folder, a glob, or a list of them."""
    name = (path if isinstance(path, str) else path[0]).rstrip("/").rsplit("/", 1)[-1]
    entries, unique = read_numbered(spark, path, year, readers=readers)
    return analyze(entries, name, **{"lines_are_unique": unique, **options})


def write_entries(entries: DataFrame, path: str) -> None:
    """Store entries as Parquet by day, so that time filters read only their days."""
    entries.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").mode("overwrite").parquet(path)
