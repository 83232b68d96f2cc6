"""Secrets in texts: fixed patterns, and strings that neither their surroundings nor known names explain."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import as_text, id_and_text, steps

# The patterns of the three base kinds and their least lengths.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "novel")

# Words that make a string near them worth a measurement, and how far they reach (characters).
CONTEXT = r"(?i)(passw|passphrase|secret|token|api.?key|credential|private.?key|access.?key|auth|bearer|signature|client.?id|connection.?string|pwd)"
REACH = 80
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~.-]{{{LEAST},}}")
# Characters of a candidate that are measured at a time; a longer one is reported whole if any of its blocks is novel.
BLOCK = 200
# Characters around a candidate that prime the compressor.
AROUND = 512
# A candidate is reported if its marginal bits, and its bits by letters in a row, are at least so many times the
# bits of a random string of its alphabet.
NOVELTY, UNWORDED = 1.0, 1.1
# Names and words that a secret is not made of; they prime the compressor before the surroundings do.
IDENTIFIERS = (
    "password secret token api_key apikey access_key client_id client_secret authorization bearer basic username localhost example.com"
    " https://www. http:// .com/ .org/ index.html config settings environment variable default value string number boolean true false null none undefined"
    " function return class import from export const public private static void self this new object request response header content-type"
    " application/json text/html charset=utf-8 user-agent accept-encoding session cookie database connection server host port path file name"
    " abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 ---------------- ================ ________________"
    " your_api_key_here insert_token_here placeholder changeme xxxxxxxxxxxxxxxx test example sample dummy version release build master main"
)
# Common words, joined by nothing or by signs in names, paths and the like; only their letters in a row count.
WORDS = (
    " the of and to in is that for it with as was on be at by this have from or one had not but what all were when we there can an your which"
    " their said if do will each about how up out them then she many some so these would other into has more her two like him see time could"
    " no make than first been its who now people my made over did down only way find use may water long little very after words called just"
    " where most know get through back much before go good new write our used me man too any day same right look think also around another"
    " came come work three word must because does part even place well such here take why things help put years different away again off went"
    " old number great tell men say small every found still between name should home big give air line set own under read last never us left"
    " end along while might next sound below saw something thought both few those always looked show large often together asked house world"
    " going want school important until form food keep children feet land side without boy once animals life enough took sometimes four head"
    " above kind began almost live page got earth need far hand high year mother light country father let night following picture being study"
    " second eyes soon times story boys since white days ever paper hard near sentence better best across during today others however sure"
    " means knew try told young miles sun ways thing whole hear example heard several change answer room sea against top turned learn point"
    " city play toward five using himself usually money seen car morning library local python packages service factory project framework"
    " security spring element class manager handler controller provider repository implementation interface abstract exception error message"
    " module package component template context property attribute parameter option setting process thread memory buffer stream network"
    " socket protocol filter format parser builder loader writer reader update delete create insert select query table column index usr lib"
    " bin var log sys etc tmp src dist node modules java com org net api users orders v1 v2 tar gz zip json xml yaml txt pdf png jpg html"
)
SPAN = "struct<kind:string,start:int,end:int,novelty:double>"


def base_spans(text: str, assign: re.Pattern, access: re.Pattern, hexes: re.Pattern) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by the three patterns: leftmost matches of each, then those of the least length."""
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    # [0-9a-f]+ takes maximal runs, so asking for the least length at once finds the same ones.
    return out + [(m.start(), 2, m.end()) for m in hexes.finditer(text)]


def marginal_bytes(candidate: bytes, known: bytes) -> int:
    """Bytes that ``candidate`` adds for a reader who has ``known``: compressed with it as dictionary, less an empty frame."""
    import zstandard as zstd

    shape = {"format": zstd.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    # A small window and tables: the dictionary is a few kilobytes.
    params = zstd.ZstdCompressionParameters(window_log=14, hash_log=12, chain_log=12, search_log=4, min_match=3, strategy=zstd.STRATEGY_BTOPT, **shape)
    packer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(known, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def alphabet_bits(s: str) -> float:
    """Bits per character of a random string over the classes of characters that ``s`` has."""
    if s.isdigit():
        return math.log2(10)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return 4.0
    if re.fullmatch(r"(?=.*[2-7])([A-Z2-7]+|[a-z2-7]+)=*", s):
        return 5.0
    classes = sum(n for p, n in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10)) if re.search(p, s))
    # A few signs alone make no random string.
    return math.log2(max(16, classes + len(set(re.findall(r"[^A-Za-z0-9]", s)))))


class Letters:
    """Counts of one, two and three characters in a row (case folded), and how often and before how many others each context stands."""

    def __init__(self, text: str, base: Letters | None = None) -> None:
        text = text.lower()
        self.base = base
        self.grams = Counter(text) + Counter(map("".join, zip(text, text[1:], strict=False))) + Counter(map("".join, zip(text, text[1:], text[2:], strict=False)))
        self.after: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in self.grams.items():
            self.after[gram[:-1]] += n
            self.kinds[gram[:-1]] += base is None or gram not in base.grams

    def of(self, table: str, key: str) -> int:
        return getattr(self, table)[key] + (getattr(self.base, table)[key] if self.base else 0)

    def bits(self, s: str) -> float:
        """Code length of ``s`` under these counts (interpolated), and of where its letters change case."""
        out, padded = 0.0, "  " + s.lower()
        for i in range(2, len(padded)):
            p = 1 / 64
            for context in ("", padded[i - 1], padded[i - 2 : i]):
                kinds = max(self.of("kinds", context), 1)
                p = (self.of("grams", context + padded[i]) + kinds * p) / (self.of("after", context) + kinds)
            out -= math.log2(p)
        upper = [c.isupper() for c in s if c.isalpha()]
        if any(upper):
            changes = [0, 0]
            for a, b in zip(upper, upper[1:], strict=False):
                out -= math.log2((changes[a != b] + 0.5) / (sum(changes) + 1))
                changes[a != b] += 1
        return out


@functools.cache
def known_letters() -> Letters:
    return Letters(IDENTIFIERS + WORDS)


def novelty_of(s: str, around: str) -> float | None:
    """Marginal bytes per character of a block, or none if its surroundings, known names or common words explain it."""
    random_bits = alphabet_bits(s) * len(s)
    size = marginal_bytes(s.encode(), IDENTIFIERS.encode() + around.encode("utf-8", "replace"))
    if size * 8 < NOVELTY * random_bits or Letters(around, known_letters()).bits(s) < UNWORDED * random_bits:
        return None
    return size / len(s)


def blocks(s: str) -> list[str]:
    """``s`` in blocks of ``BLOCK`` characters; the last one takes a rest too short for a measurement."""
    cuts = [0, *range(BLOCK, len(s) - LEAST + 1, BLOCK), len(s)]
    return [s[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _covered(start: int, end: int, taken: list[tuple[int, int]]) -> bool:
    """Whether the sorted spans leave no character between ``start`` and ``end``."""
    for a, b in taken:
        if a > start or start >= end:
            break
        start = max(start, b)
    return start >= end


def novel_spans(text: str, words: re.Pattern, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """Candidates that begin within reach of a sensitive word, reach beyond the base spans and stay incompressible.

    A candidate is a maximal run, whatever its length.
    """
    out, done, taken = [], 0, sorted((s, e) for s, _, e in taken)
    for word in words.finditer(text):
        limit = word.end() + REACH
        for m in CANDIDATE.finditer(text, max(word.end(), done), limit + LEAST - 1):
            if m.start() < done:
                continue
            # The reach may end inside the string; take it whole.
            whole = CANDIDATE.match(text, m.start())
            start, end = whole.span()
            done = end
            s = whole[0]
            if _covered(start, end, taken):
                continue
            around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
            measured = [n for n in (novelty_of(b, around) for b in blocks(s)) if n is not None]
            if measured:
                out.append((start, 3, end, max(measured)))
    return out


def scan_text(text: str, possible: tuple[bool, bool, bool, bool], patterns: tuple) -> list[dict]:
    assign, access, hexes, words = patterns
    base = base_spans(text, *(p if hit else NEVER for p, hit in zip((assign, access, hexes), possible, strict=False)))
    found = [(*b, None) for b in base]
    if possible[3]:
        found += novel_spans(text, words, base)
    return [{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in sorted(found, key=lambda x: x[:3])]


NEVER = re.compile(r"(?!)")
# Which texts can have a match at all, told by Arrow on a whole batch.
HINTS = (r"(?i)(password|passwd|secret|token|api_?key)", r"AKIA", r"[0-9a-f]{16}", CONTEXT)


def find_spans(texts: pa.Array) -> list[list[dict]]:
    patterns = (re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(f"[0-9a-f]{{{HEX_LEAST},}}"), re.compile(CONTEXT))
    hints = [pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in HINTS]
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(np.logical_or.reduce(hints)):
        out[i] = scan_text(texts[i].as_py(), tuple(bool(h[i]) for h in hints), patterns)
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: every secret of every whole text, in order of start, then kind as listed in ``KINDS``.

    Positions count code points, the end is exclusive. Null text counts as empty and has no
    spans; a row per input row, repeated rows repeated. ``novelty`` is the marginal
    compressed size per character of a ``novel`` span, null for base kinds. Bytes that are
    no UTF-8 count as one U+FFFD each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
        for batch in steps(batches):
            spans = find_spans(as_text(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, spans array<{SPAN}>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str, spans: list[dict], mark: str = "<secret>") -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; null stays null, other columns and rows stay."""

    @F.arrow_udf("string")
    def redacted(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in values:
            out: list[pa.Array] = []
            texts = pa.array(part, pa.string()) if not isinstance(part, pa.Array) else part
            spans = find_spans(pc.fill_null(texts, ""))
            hits = [i for i, s in enumerate(spans) if s]
            if not hits:
                yield texts
                continue
            at = 0
            for i in hits:
                out += [texts.slice(at, i - at), pa.array([redact_text(texts[i].as_py(), spans[i])], texts.type)]
                at = i + 1
            yield pa.concat_arrays([*out, texts.slice(at)])

    return docs.withColumn(text_col, redacted(docs[text_col]))
