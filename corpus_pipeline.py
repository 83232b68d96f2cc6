"""The corpus pipeline: language ID, SimHash near-dedup, repeated passages, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table
from logloom.llm.language_id import UNDECIDED, fit, language_column
from logloom.llm.packing import pack_documents
from logloom.llm.queries import WORD_BPE, held_out
from logloom.llm.secret_scan import redact
from logloom.llm.simhash import near_duplicates
from logloom.llm.suffix_dedup import remove_repeats
from logloom.operators.numbering import cut_lineage
from logloom.packaging import ship

# A document stays if the network gives one language at least this share of its positions.
LEAST_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language the network can tell, go; without a label to learn from, only the former."""
    ship(spark)
    net = fit(docs, ~held_out())
    if net is None:
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    told = docs.select(F.struct("*").alias("row"), language_column(net, docs["text"]).alias("told"))
    return told.filter((F.col("told.lang") != UNDECIDED) & (F.col("told.score") >= LEAST_SCORE)).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose fingerprints are connected, the one with the smallest id stays; a null id stays."""
    ship(spark)
    classes = near_duplicates(docs)
    dropped = classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped"], "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has as well are cut out; documents left with nothing go."""
    ship(spark)
    others = [c for c in docs.columns if c != "text"]
    # A cut can fall inside a character; what is left of it goes too.
    cut = remove_repeats(docs, carry=others, whole_characters=True)
    text = F.when(F.col("carried.no_text"), None).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    left = cut.withColumn("text", text).filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    columns = [F.col("text") if c == "text" else F.col("carried").getField(f"c_{c}").alias(c) for c in docs.columns]
    return _with_size(left.select(*columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    ship(spark)
    return _with_size(redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path(WORD_BPE))


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language ID", keep_known_language),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("suffix-array dedup", drop_repeated_passages),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
# The trained network, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_lineage(docs, f"stage-{number}")
    return docs
