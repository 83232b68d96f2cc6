"""Language of whole texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import as_text, joined_bytes, steps

UNDECIDED = "und"
# Bytes of a window; every position of a text is in exactly one window.
WINDOW = 64
# Windows that go through the network at a time.
BATCH = 2048
HIDDEN = 8
# Bounds of the training sample: texts of a language, characters of a text, and rows at which languages get fewer texts each.
SAMPLE_TEXTS, SAMPLE_CHARS, MOST_ROWS = 400, 512, 25_600
TRAINING_STEPS, TRAINING_BATCH, RATE = 300, 192, 0.02


@dataclass
class Network:
    """Weights of both directions; the first axis is the direction.

    ``table`` (2, 257, 3H): input of the three gates for each byte, row 256 is padding;
    ``loop`` (2, H, 3H): from the former state to update, reset and candidate;
    ``head`` (2H, C) and ``bias`` (C): from both states to a language.
    """

    languages: list[str]
    table: np.ndarray
    loop: np.ndarray
    head: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.loop, self.head, self.bias]


def new_network(languages: list[str], seed: int = 7, hidden: int = HIDDEN) -> Network:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    return Network(languages, small(2, 257, 3 * hidden), small(2, hidden, 3 * hidden), small(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # One pass of tanh is faster than exp and a division.
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(net: Network, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (2, length, windows, H) before and after which each byte of ``windows`` (windows, length) is read.

    Direction 1 reads from the end; its states are stored at the position they belong to.
    ``keep`` gets what backpropagation needs.
    """
    count, length = windows.shape
    hidden = net.loop.shape[1]
    codes = np.ascontiguousarray(windows.T)
    both = np.stack([codes, codes[::-1]])
    out = np.empty((2, length, count, hidden), np.float32)
    state = np.zeros((2, count, hidden), np.float32)
    gate_loop, new_loop = np.ascontiguousarray(net.loop[:, :, : 2 * hidden]), np.ascontiguousarray(net.loop[:, :, 2 * hidden :])
    for t in range(length):
        inputs = np.stack([net.table[0].take(both[0, t], axis=0), net.table[1].take(both[1, t], axis=0)])
        gates = np.matmul(state, gate_loop)
        gates += inputs[:, :, : 2 * hidden]
        _sigmoid(gates)
        update, reset = gates[:, :, :hidden], gates[:, :, hidden:]
        inner = np.matmul(state, new_loop)
        candidate = reset * inner
        candidate += inputs[:, :, 2 * hidden :]
        np.tanh(candidate, out=candidate)
        before = state
        state = before - candidate
        state *= update
        state += candidate
        out[0, t], out[1, length - 1 - t] = state
        if keep is not None:
            keep.append((both[:, t], before, update, reset, inner, candidate))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def labelled(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities (length, languages, windows) of every position: ``states`` and the head, laid out for long vectors."""
    count, length = windows.shape
    hidden, languages = net.loop.shape[1], len(net.languages)
    # sigmoid(x) = (1 + tanh(x / 2)) / 2: the halves of the gates are in the weights already.
    half = np.ones(3 * hidden, np.float32)
    half[: 2 * hidden] = 0.5
    table = np.ascontiguousarray((net.table * half).transpose(0, 2, 1))
    loop = np.ascontiguousarray((net.loop * half).transpose(0, 2, 1))
    heads = [np.ascontiguousarray(net.head[:hidden].T), np.ascontiguousarray(net.head[hidden:].T)]
    codes = np.ascontiguousarray(windows.T.astype(np.intp))
    logits = np.empty((length, languages, count), np.float32)
    logits[:] = net.bias[:, None]
    state = np.zeros((2, hidden, count), np.float32)
    inputs = np.empty((2, 3 * hidden, count), np.float32)
    inner, part = np.empty_like(inputs), np.empty((languages, count), np.float32)
    for t in range(length):
        for d, at in ((0, t), (1, length - 1 - t)):
            np.take(table[d], codes[at], axis=1, out=inputs[d], mode="clip")
        np.matmul(loop, state, out=inner)
        gates, candidate = inner[:, : 2 * hidden], inner[:, 2 * hidden :]
        gates += inputs[:, : 2 * hidden]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        candidate *= gates[:, hidden:]
        candidate += inputs[:, 2 * hidden :]
        np.tanh(candidate, out=candidate)
        state -= candidate
        state *= gates[:, :hidden]
        state += candidate
        for d, at in ((0, t), (1, length - 1 - t)):
            logits[at] += np.matmul(heads[d], state[d], out=part)
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions that are no padding, and its gradients by backpropagation through time."""
    kept: list = []
    found = states(net, windows, kept)
    _, length, count, hidden = found.shape
    real = (windows.T != 256).astype(np.float32)
    total = max(float(real.sum()), 1.0)
    joint = np.concatenate([found[0], found[1]], axis=-1)
    p = _softmax(joint @ net.head + net.bias)
    loss = -float((np.log(np.maximum(p[:, np.arange(count), target], 1e-9)) * real).sum()) / total
    p[:, np.arange(count), target] -= 1
    p *= real[:, :, None] / total
    flat = p.reshape(-1, p.shape[-1])
    d_head, d_bias = joint.reshape(-1, 2 * hidden).T @ flat, flat.sum(0)
    d_joint = p @ net.head.T
    d_out = [d_joint[:, :, :hidden], d_joint[::-1, :, hidden:]]  # in the order in which each direction reads
    d_table, d_loop = np.zeros_like(net.table), np.zeros_like(net.loop)
    d_state = np.zeros((2, count, hidden), np.float32)
    for t in range(length - 1, -1, -1):
        codes, before, update, reset, inner, candidate = kept[t]
        d_state = d_state + np.stack([d_out[0][t], d_out[1][t]])
        d_update = d_state * (before - candidate) * update * (1 - update)
        d_new = d_state * (1 - update) * (1 - candidate * candidate)
        d_reset = d_new * inner * reset * (1 - reset)
        d_inner = d_new * reset
        from_loop = np.concatenate([d_update, d_reset, d_inner], axis=-1)
        to_table = np.concatenate([d_update, d_reset, d_new], axis=-1)
        d_loop += np.matmul(before.transpose(0, 2, 1), from_loop)
        for k in range(2):
            np.add.at(d_table[k], codes[k], to_table[k])
        d_state = d_state * update + np.matmul(from_loop, net.loop.transpose(0, 2, 1))
    return loss, [d_table, d_loop, d_head, d_bias]


def windows_of(
    flat: np.ndarray, offsets: np.ndarray, window: int = WINDOW, first: int = 0, most: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts given by their bytes and offsets, and the text of each; short ones are padded with 256.

    Of all windows in order, ``most`` from number ``first`` on.
    """
    counts = -(-np.diff(offsets) // window)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    number = np.arange(first, total if most is None else min(first + most, total))
    owner = np.searchsorted(ends, number, "right")
    starts = (number - (ends - counts)[owner]) * window + offsets[:-1][owner]
    places = starts[:, None] + np.arange(window)
    inside = places < offsets[1:][owner][:, None]
    out = np.where(inside, flat[np.where(inside, places, 0)] if len(flat) else 256, 256)
    return out.astype(np.int16), owner


def train(texts: list[bytes], labels: list[str], *, steps_: int = TRAINING_STEPS, seed: int = 7) -> Network | None:
    """A network for the languages of ``labels``; batches draw languages evenly. None without rows."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net = new_network(languages, seed)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    windows, owner = windows_of(joined, np.cumsum([0, *map(len, texts)], dtype=np.int64))
    if len(languages) == 1 or not len(windows):
        return net
    index = {x: k for k, x in enumerate(languages)}
    of_window = np.array([index[x] for x in labels])[owner]
    groups = [np.flatnonzero(of_window == k) for k in range(len(languages))]
    groups = [g for g in groups if len(g)]
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps_ + 1):
        pick = np.concatenate([rng.choice(g, -(-TRAINING_BATCH // len(groups))) for g in groups])
        _, slopes = gradients(net, windows[pick], of_window[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        rate = RATE * min(1.0, 2.0 - 2.0 * step / (steps_ + 1))
        for w, g, m, v in zip(net.weights(), slopes, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-6))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of each language over all positions of each text (zeros for empty texts)."""
    n, c = len(offsets) - 1, len(net.languages)
    total = np.zeros((n, c))
    windows = int((-(-np.diff(offsets) // WINDOW)).sum())
    for at in range(0, windows, BATCH):  # a batch at a time, however long the texts are
        part, owner = windows_of(flat, offsets, first=at, most=BATCH)
        p = labelled(net, part)
        p *= (part.T != 256)[:, None, :]
        sums = p.sum(axis=0)
        for k in range(c):
            total[:, k] += np.bincount(owner, weights=sums[k], minlength=n)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def predict(net: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its pooled probability; ``und`` and 0 for null, texts without a letter, or without a network."""
    filled = pc.fill_null(texts, "")
    letters = pc.match_substring_regex(filled, r"\p{L}").to_numpy(zero_copy_only=False)
    score = np.zeros(len(texts))
    out = np.full(len(texts), UNDECIDED, object)
    if net is not None and letters.any():
        chosen = np.flatnonzero(letters)
        p = pooled(net, *joined_bytes(filled.take(pa.array(chosen))))
        best = p.argmax(axis=1)
        out[chosen] = np.array(net.languages, object)[best]
        score[chosen] = np.clip(p[np.arange(len(p)), best], 0, 1)
    return out.tolist(), score


def fit(docs: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on a bounded sample of the rows that ``allowed`` marks and that have text and language.

    At most ``SAMPLE_TEXTS`` rows of each language, the first by a hash of id and text, with one
    stretch of ``SAMPLE_CHARS`` characters from a place that the same hash picks. Every language is
    learned: where all together are over ``MOST_ROWS`` rows, each has fewer, one at least. The rank
    limit is applied before the shuffle, so no language gathers in one task.
    """
    rows = docs.filter(allowed & docs[text_col].isNotNull() & docs[lang_col].isNotNull()).select(
        F.xxhash64(docs[id_col], docs[text_col]).alias("_h"), docs[text_col].alias("_text"), docs[lang_col].cast("string").alias("_lang")
    )
    place = F.pmod("_h", F.greatest(F.length("_text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    part = rows.select("_h", "_lang", F.col("_text").substr(place, F.lit(SAMPLE_CHARS)).alias("_text")).filter(F.col("_text").rlike(r"\p{L}"))
    ranked = part.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))).filter(F.col("_r") <= SAMPLE_TEXTS)
    sample = ranked.orderBy("_r", "_lang").limit(MOST_ROWS).select("_r", "_text", "_lang").collect()
    if len(sample) == MOST_ROWS and sample[-1]["_r"] == 1:  # more languages than rows
        sample = ranked.filter("_r = 1").select("_r", "_text", "_lang").collect()
    sample.sort(key=lambda r: (r["_lang"], r["_r"]))
    return train([r["_text"].encode() for r in sample], [r["_lang"] for r in sample])


RESULT = "struct<lang:string,score:double>"


def language_column(net: Network | None, text: Column) -> Column:
    """The prediction of a string column as ``struct<lang, score>``; state it once per query."""

    @F.arrow_udf(RESULT)
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in values:
            lang, score = predict(net, part)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return run.asNondeterministic()(text)


def identify(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, a row per input row.

    Null or letterless text is ``und`` with score 0, as is everything if no row could be
    learned from. Only the text is read.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("_id"), docs[text_col].cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = as_text(pc.fill_null(batch.column("_text"), b""))
                for part in steps(iter([pa.RecordBatch.from_arrays([batch.column("_id"), texts], names=["_id", "_text"])])):
                    lang, score = predict(net, part.column("_text"))
                    yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
