"""Byte-level BPE by a rank file: encoding of whole texts and decoding back to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import id_and_text, steps

# Characters that are encoded at a time; longer texts are split first.
SPLIT_CHARS = 100_000
CUT = re.compile(r"(?<=\S)[ \n]")
# White space as the pattern counts it, and runs of it that are one match by themselves.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN_CHARS = 4096
# Bytes of text that are encoded before the ids go back to Spark.
BATCH_BYTES = 2 << 20

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The encoding of this Python worker; ranks come from the file alone."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def split_safely(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """Parts of about ``size`` characters whose matches are those of the whole text.

    No match of the pattern has white space after something else, and nothing looks
    back, so a cut between a character that is no white space and a space or line end
    always falls between two matches. Without such a place the part grows on.
    """
    start = 0
    while len(text) - start > size:
        place = CUT.search(text, start + size)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:]


def encode_text(enc, text: str, size: int = SPLIT_CHARS, run: int = RUN_CHARS) -> np.ndarray:
    """Ids of a text of any length, in time that grows with the length.

    The pattern takes a run of white space as one match, all but its last character if
    something follows. The library would look ahead from each character of it, so runs of ``run``
    characters or more go to its merges directly, as that one match.
    """
    out, start = [], 0
    if len(text) >= run:
        for found in re.finditer(f"[{WHITE}]{{{run},}}", text):
            end = found.end() if found.end() == len(text) else found.end() - 1
            out += [enc.encode_ordinary(part) for part in split_safely(text[start : found.start()], size)]
            out.append(enc._encode_single_piece(text[found.start() : end]))
            start = end
    out += [enc.encode_ordinary(part) for part in split_safely(text[start:], size)]
    return np.concatenate([np.array(ids, "<u4") for ids in out])


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text; ids are little-endian unsigned 32-bit integers.

    Null text counts as empty and has no ids. Bytes that are no UTF-8 become U+FFFD first.
    Texts of any length are encoded whole, long runs of one character included. Rows keep their
    partition; repeated rows give repeated results, an empty table none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in steps(batches, limit=BATCH_BYTES):
            ids = [encode_text(enc, v.decode("utf-8", "replace")) for v in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the raw bytes of its ids (null ids: null), whatever cuts they were encoded with. An empty table gives an empty result."""

    @F.arrow_udf("binary")
    def decoded(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks, pattern)
        for part in values:
            raw = [None if v is None else enc.decode_bytes(np.frombuffer(v, "<u4").tolist()) for v in part.to_pylist()]
            yield pa.array(raw, pa.binary())

    return encoded.withColumn("decoded", decoded(F.col(ids_col)))
