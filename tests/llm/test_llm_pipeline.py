"""The pipeline: stage by stage, and as a whole."""

import public_tokenizers
import pytest
from test_llm_documents import brute_classes, brute_repeats, plain_fingerprint
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from logloom.llm.common import without_broken_characters

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def chain(spark):
    """The result of every stage on the result of the one before."""
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, out[-1], SMALL)
        out.append(spark.createDataFrame(df.collect(), df.schema))
    return out


def test_stages_keep_the_columns(chain):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "secret scans", "packing"]
    assert all(df.schema.simpleString() == chain[0].schema.simpleString() for df in chain[1:-1])


def test_stages_do_what_brute_force_does(chain):
    start, known, single, cut, clean = map(texts, chain[:5])
    assert all(start[i] == t for i, t in known.items()) and len(known) >= 0.99 * len(start)
    classes = brute_classes({i: plain_fingerprint(t) for i, t in known.items()}, 2)
    assert single == {i: t for i, t in known.items() if classes[i] == i}
    want = {i: kept.decode("utf-8", "ignore") for i, _, gone, _, kept in brute_repeats([(i, t.encode()) for i, t in single.items()], 50) if kept or not gone}
    assert cut == want
    assert set(clean) == set(cut)
    assert all(clean[i] == t or "<secret>" in clean[i] for i, t in cut.items())
    assert all(r["n_chars"] == len(r["text"]) for r in chain[4].collect())


def test_packing_holds_every_token(chain):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(chain[4]).items()}
    got = {}
    for r in chain[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_equals_the_stages(spark, chain):
    piece = lambda r: (r["doc_id"], r["start"], r["length"], bytes(r["ids"]))
    ran = __spark_entry__.queries()["pipeline"](spark, SMALL).collect()
    # Cuts follow the order of rows, which differs; documents and their ids do not.
    assert {r["doc_id"] for r in ran} == {r["doc_id"] for r in chain[5].collect()}
    assert sum(r["length"] for r in ran) == sum(r["length"] for r in chain[5].collect())
    assert len({piece(r) for r in ran}) == len(ran)


def test_stages_on_odd_rows_and_none(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", None, 5), (4, "the of and that with " * 9, "en", "s", 1),
        (4, "the of and that with " * 9, "en", "s", 1), (None, "in the of and to that for this with " * 5, None, "s", 3), (6, "x " * 30_000, "en", "s", 2), (7, "password = abcdefghijklmnop the and of", "en", "s", 9),
    ]
    odd = spark.createDataFrame([(*r, 1, "y") for r in rows], COLUMNS + ", _gone int, dropped string")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SMALL).collect()
        assert name == "packing" or all(set(r.asDict()) == set(odd.columns) for r in got)
        assert stage(spark, spark.createDataFrame([], COLUMNS), SMALL).collect() == []
    single = corpus_pipeline.keep_one_of_each_group(spark, odd, SMALL).collect()
    assert sum(r["doc_id"] is None for r in single) == 1 and {r["doc_id"] for r in single} == {None, 1, 4, 6, 7, 3}
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_secrets(spark, odd, SMALL).collect()}
    assert clean[7] == "<secret> the and of" and clean[1] is None
    cut = corpus_pipeline.drop_repeated_passages(spark, odd, SMALL).collect()
    assert len(cut) == len(rows) and sum(r["text"] is None for r in cut) == 1


def test_language_stage_keeps_lettered_texts_if_nothing_is_labelled(spark):
    rows = [(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "é", None, "s", 1)]
    kept = corpus_pipeline.keep_known_language(spark, spark.createDataFrame(rows, COLUMNS), SMALL).collect()
    assert {r["doc_id"] for r in kept} == {1, 4}


def test_only_characters_broken_by_a_cut_go(spark):
    shared = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    rows = [(1, f"a {shared}", "en", "s", 1), (2, f"caf\ufffd \u00e9{shared}\u00e9 tail \ufffd", "en", "s", 1), (3, f"\u00e9{shared[3:]}", "en", "s", 1)]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(rows, COLUMNS), SMALL).collect()}
    assert cut[1] == rows[0][1] and cut[2].startswith("caf\ufffd \u00e9") and cut[2].endswith(" tail \ufffd") and len(cut[2]) < 20
    assert without_broken_characters("\u00e9\u65e5".encode()[:3], [1]) == b"\xe6" and without_broken_characters(b"", [0]) == b""
    assert without_broken_characters("\u00e9a".encode() + "\u65e5".encode()[1:], [3]) == "\u00e9a".encode()
    assert without_broken_characters("\u00e9\u65e5x".encode(), []) == "\u00e9\u65e5x".encode()
