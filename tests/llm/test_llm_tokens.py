"""Packing, Arrow sequence files and byte-level BPE against the plain libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from logloom.llm import queries
from logloom.llm.arrow_files import SequenceFile, read_documents, write_sequence_files
from logloom.llm.byte_bpe import decode_documents, encode_documents, encode_text, split_safely
from logloom.llm.packing import best_cuts, pack_documents
from logloom.llm.tokens import TextEncoder

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "a", "It's THE end. isn't it?", "naïve ÉCOLE Straße ΟΔΟΣ İstanbul", "H̱ello é É ́x", "tab\tline\r\nend \x0b\x0c \x1c \x85 \xa0  x",
    "<|endoftext|> word<|startoftext|>", "日本語の文。 もう一つ", "🙂🙂 a🙂b", "12 345 6,7.8", "-- ...!?? x's' 'tis", "x" * 3000, " " * 3000, "ab" * 500 + " 1" * 500, "\x00\x01null",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranks():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def odd_docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", 1), (None, "no id. here", "y", 2), (99, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _id int").repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def test_encoder_equals_library_on_odd_texts(plain):
    ids, ends = TextEncoder(WORDS).encode(pa.array(ODD))
    for k, text in enumerate(ODD):
        assert ids[ends[k] : ends[k + 1]].tolist() == plain(text), text


def test_added_tokens_have_their_own_ids(plain):
    text = "end of file <|endoftext|> next one"
    ids, ends = TextEncoder(WORDS).encode(pa.array(["a", text, "<|ENDOFTEXT|>", "b"]))
    assert ids[ends[1] : ends[2]].tolist() == plain(text) == [806, 539, 4512, 49407, 1131, 637]
    assert ids[ends[2] : ends[3]].tolist() == plain("<|ENDOFTEXT|>") and len(ends) == 5


def test_encoder_equals_library_on_random_texts(plain):
    parts = [*"abstmdrevl'  12.,-ASTREVLM\n\t\x0b\x0c\x1c\x85\xa0éÉßñİıŉ×÷ſŁž²½K", "'s", "'LL", "'re", "''", "é", "̧", "日", "—", "🙂", "​"]
    parts += ["<|endoftext|>", "<|startoftext|>", "İ,", "ẞ", "Σ", "ΟΔΟΣ", "가", "ﬁ", "\xad", " ", "٣", "\x00", "\x7f"]
    rng, encoder = random.Random(1), TextEncoder(WORDS)
    for _ in range(20):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(200)]
        ids, ends = encoder.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == plain(text), text


def test_forgotten_pieces_are_encoded_again(plain, monkeypatch):
    monkeypatch.setattr("logloom.llm.tokens.CACHED_PIECES", 10)
    encoder = TextEncoder(WORDS)
    text = " ".join(f"word{chr(97 + i)}" for i in range(26))
    for _ in range(3):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == plain(text) and len(encoder.known) <= 36


@pytest.mark.parametrize("text", ["x" * 1_000_000, " " * 3_000_000, "\n" * 3_000_000, " " * 1_000_000 + "a", "日" * 300_000, "1" * 300_000, "'s" * 300_000, "é, " * 300_000], ids=range(8))
def test_very_long_texts(plain, ranks, text):
    ids, _ = TextEncoder(WORDS).encode(pa.array([text]))
    assert np.array_equal(ids, plain(text))
    got = encode_text(ranks, text)
    assert ranks.decode_bytes(got.tolist()) == text.encode()
    if text.strip():
        tail = text.lstrip(" ")
        white = len(text) - len(tail)
        head = [ranks.encode_single_token(b" ")] * (white - 1)
        assert got.tolist() == head + ranks.encode_ordinary(" " * bool(white) + tail)
    else:  # one match; the ranks have no token of two of these
        assert got.tolist() == [ranks.encode_single_token(text[:1].encode())] * len(text)


def test_encoder_of_other_kind_of_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    encoder = TextEncoder(path)
    assert not encoder.by_piece
    ids, ends = encoder.encode(pa.array(ODD))
    for k, text in enumerate(ODD):
        assert ids[ends[k] : ends[k + 1]].tolist() == other.encode(text, add_special_tokens=False).ids


def check_pieces(pieces, docs, plain, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(np.array([*plain(text), 1], "<u4").tobytes())
    for doc_id, texts in want.items():
        got = sorted(by_doc.pop(doc_id), key=lambda p: p["start"])
        if len(texts) == 1:
            at = 0
            for p in got:
                assert p["start"] == at and p["doc_tokens"] * 4 == len(texts[0]) and len(p["ids"]) == 4 * p["length"]
                at += p["length"]
            assert b"".join(p["ids"] for p in got) == texts[0]
        else:
            assert sum(len(p["ids"]) for p in got) == sum(map(len, texts))
    assert not by_doc
    filled = []
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= length
        filled.append(at)
    return filled


def test_packing_query_against_library(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    filled = check_pieces(pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), WORDS).collect(), docs, plain, 2048)
    assert sum(filled) / (2048 * len(filled)) > 0.97
    digest = queries.op2_packing(spark, SMALL).collect()
    ids = {d: np.array([*plain(t), 1], "<u4") for d, t in docs}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in digest)


@pytest.mark.parametrize("block", [64, 5000, 1 << 20])
def test_packing_odd_rows(spark, plain, block):
    docs = odd_docs(spark)
    pieces = pack_documents(docs, WORDS, length=32, block=block).collect()
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()], plain, 32)
    assert pack_documents(empty_docs(spark), WORDS).collect() == []


def test_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        ends = np.cumsum([rng.randint(1, 7) for _ in range(rng.randint(1, 9))])
        price = np.array([rng.choice([0.0, 2.0, 8.0]) for _ in ends])
        length = rng.randint(7, 15)

        def cost(cuts, ends=ends, price=price, length=length):
            starts = [0, *[int(ends[c]) for c in cuts[:-1]]]
            sizes = [int(ends[c]) - s for c, s in zip(cuts, starts, strict=True)]
            return sum(length - s for s in sizes) + sum(price[c] for c in cuts) if max(sizes) <= length else float("inf")

        last = len(ends) - 1
        every = [[k for k in range(last) if bits >> k & 1] + [last] for bits in range(1 << last)]
        assert cost(best_cuts(ends, price, length).tolist()) == min(map(cost, every))


def test_files_give_back_what_the_library_encodes(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op4_arrow_files(spark, SMALL).collect()}
    at = 0
    for doc_id, text in sorted(docs):
        ids = np.array([*plain(text), 2], "<u4")
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_files_of_odd_rows(spark, plain, tmp_path):
    docs = odd_docs(spark)
    files = write_sequence_files(docs, WORDS, str(tmp_path / "out"), length=16)
    back = sorted(read_documents(spark, files).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], np.array([*plain(r["text"]), 2], "<u4").tobytes()) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    assert [(r["doc_id"], bytes(r["ids"])) for r in back] == want
    assert [r["start"] for r in back] == np.cumsum([0, *[len(x[1]) // 4 for x in want]])[:-1].tolist()
    assert not list((tmp_path / "out").glob("*.tmp"))
    file = SequenceFile(files[0]["folder"], files[0]["path"])
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == 16 and ids.base is not None
    assert np.array_equal(file.read(3, 40), np.concatenate([file.batch(i) for i in range(file.reader.num_record_batches)])[3:43])
    assert write_sequence_files(empty_docs(spark), WORDS, str(tmp_path / "none")) == []
    assert read_documents(spark, []).collect() == []


def test_byte_bpe_query_against_library(spark, ranks):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op5_byte_bpe(spark, SMALL).collect()}
    for doc_id, text in docs:
        ids = np.array(ranks.encode_ordinary(text), "<u4")
        digests = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"], got[doc_id]["decoded_sha256"]) == (len(ids), *digests)


def test_byte_bpe_odd_rows_and_round_trip(spark, ranks):
    docs = odd_docs(spark)
    rows = decode_documents(encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((r["text"] or "").encode() for r in docs.collect())
    assert encode_documents(empty_docs(spark), RANKS, public_tokenizers.PATTERN).collect() == []
    cut = spark.createDataFrame([(b"",), (np.array(ranks.encode_ordinary("é🙂"), "<u4").tobytes()[:4],), (None,)], "ids binary")
    assert [r["decoded"] is None for r in decode_documents(cut, RANKS, public_tokenizers.PATTERN).collect()] == [False, False, True]


def test_split_texts_encode_alike(ranks):
    rng = random.Random(5)
    for seed in range(40):
        text = "".join(rng.choice(["a", "b1", " ", "  ", "\n", "　", "'s", "é", "!?", "\t", "ſ"]) for _ in range(200))
        assert "".join(split_safely(text, 7)) == text
        assert encode_text(ranks, text, 7).tolist() == ranks.encode_ordinary(text), seed
        assert encode_text(ranks, text, 7, 2).tolist() == ranks.encode_ordinary(text), seed
