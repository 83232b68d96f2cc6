"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.ann_forest import nearest_by_product
from logloom.llm.arrow_files import read_documents, write_sequence_files
from logloom.llm.byte_bpe import decode_documents, encode_documents
from logloom.llm.common import table
from logloom.llm.embedding_dedup import near_duplicate_vectors
from logloom.llm.language_id import fit, identify
from logloom.llm.lexical_search import search
from logloom.llm.license_scan import scan_licenses
from logloom.llm.lm_score import score_documents
from logloom.llm.oracle import ORACLE  # noqa: F401
from logloom.llm.packing import pack_documents
from logloom.llm.resampling import resample
from logloom.llm.secret_scan import listed, scan_secrets
from logloom.llm.simhash import near_duplicates
from logloom.llm.suffix_dedup import remove_repeats

WORD_BPE = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_product(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op4_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_sequence_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return read_documents(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    encoded = encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    return decode_documents(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def of(kind: str) -> F.Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return score_documents(table(spark, sf_dir, "documents"), good, tokenizer=public_tokenizers.path(WORD_BPE))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, ~held_out())
    return identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    start = F.transform(base, lambda s: s["first_word"])

    def labels(spans: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    share = F.transform("spans", lambda s: F.lit(1.0) - s["edits"] / F.length(s["notice"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])), ",").alias("spans"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest_run=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_ann_forest": op3_ann_forest,
    "op4_arrow_files": op4_arrow_files,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash": op7_simhash,
    "op8_lm_score": op8_lm_score,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_license_scan": op12_license_scan,
    "op13_importance_resampling": op13_importance_resampling,
}
