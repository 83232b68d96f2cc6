"""Event templates: masked templates, and similarity templates that evolve.

Similarity mining is first fit in line order: a message joins the oldest cluster of
its length whose merged template keeps enough words, and the template generalises.
That looks sequential, but three facts make it a Spark job with the same result:

* A message that repeats changes nothing, so only distinct token arrays are mined.
* Members agree with their founder in all but ``m`` positions, so after cutting the
  positions into ``m + 1`` segments they share one. Arrays linked by shared segments
  form components that never meet each other and are mined apart.
* Templates only lose words. An array that its first accepting cluster already
  covers will join it whatever comes before its turn, so it leaves at once.

Each round mines a bounded batch per block. An inverted index then joins the arrays that are left to
the new and changed clusters: what its oldest taker covers leaves, and what takers remain is
all that the next batch of a block needs to know. Where the first round leaves a few clusters per
length, as most logs do, they go to the arrays instead, which then stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.patterns import STAMP, WILDCARD
from logloom.functions.text import masked_template, may_hold_stamp, n_literal_wildcards, n_words, spaced_words, tokenize, words
from logloom.operators.components import connected_components
from logloom.operators.numbering import cut_lineage, dense_number, tables_go_after

BATCH = 20_000  # distinct arrays mined in order by one task and round
SPLIT_AFTER = 1  # rounds before what is left is cut into components, after each further round
DEAL = 500_000  # lines of a block that one task puts in order
MASKS = 16  # sets of positions per length that have index keys of their own
FEW = 16  # states of a length, at most, that are compared with its arrays where those are
# A message with more than this share of all lines is joined where its lines are; so many of them, of so many characters, at most.
FREQUENT_SHARE, MOST_FREQUENT, FREQUENT_CHARS = 0.001, 1000, 2000
TEXTS = "zstd"  # how tables of texts are compressed: in half the room

_MINED = "n_tok int, block bigint, kind string, id bigint, founder bigint, tokens array<string>"


def masked_template_ids(entries: DataFrame) -> DataFrame:
    """Add ``template`` (masked) and ``event_id``, numbered by first appearance; 0 if empty."""
    # Stored: both the numbering and the join read it, and masking is the dear part.
    masked = cut_lineage(entries.withColumn("template", masked_template(F.col("message_raw"))), "masked")
    # Null for the empty template: a filter on the template itself would repeat the masking.
    first = F.min(F.when(F.col("template") != "", F.col("line")))
    firsts = masked.groupBy("template").agg(first.alias("_first")).filter(F.col("_first").isNotNull())
    # Stored, its size is known: few templates are broadcast, many are joined by shuffle.
    ids = cut_lineage(dense_number(firsts, "_first", "event_id").select("template", "event_id"), "template_ids")
    joined = masked.join(ids, "template", "left").withColumn("event_id", F.coalesce("event_id", F.lit(0)))
    return joined.select(*entries.columns, "event_id", "template")


def tolerated(n: Column, threshold: float) -> Column:
    """Most wildcards a template of ``n`` words may have: largest d with 1 - d/n >= threshold."""
    n = F.greatest(n, F.lit(1))
    guess = F.floor((1.0 - F.lit(threshold)) * n).cast("int")
    fits = lambda d: F.lit(1.0) - d / n >= F.lit(threshold)
    return F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)


def _literal_wildcards(tokens: Column) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, WILDCARD))


def _never_joins(tokens: Column, threshold: float) -> Column:
    # Its own literal wildcards exceed the tolerance: each occurrence is its own event.
    return _literal_wildcards(tokens) > tolerated(F.size(tokens), threshold)


def _lone_rows(entries: DataFrame, threshold: float) -> DataFrame:
    # The two cheap tests come first: without them no token is a literal wildcard.
    message = F.col("message_raw")
    can = F.contains(message, F.lit(WILDCARD)) | (may_hold_stamp(message) & message.rlike(STAMP))
    # In a function of the words: the filter would repeat the search for them, and the parse of the message, for each use.
    return entries.filter(can).filter(F.exists(F.array(tokenize(message)), lambda t: (F.size(t) > 0) & _never_joins(t, threshold)))


class _Clusters:
    """Templates of one length as integer columns, oldest first."""

    def __init__(self, length: int, threshold: float, founders, arrays):
        d = np.arange(length + 1)
        self.fits = (1.0 - d / length) >= threshold
        self.length = length
        self.codes: dict[str, int] = {}
        self.words: list[str] = []
        self.founders = list(founders)
        self.size = len(self.founders)
        self.grid = np.zeros((length, max(64, 2 * self.size)), dtype=np.int32)
        # One stretch more than may differ: a cluster shares one of them, word by word, with all that it takes.
        parts = int(np.flatnonzero(self.fits).max(initial=0)) + 1
        self.cuts = [s * length // parts for s in range(parts + 1)] if parts <= length else []
        self.index: dict[tuple[int, bytes], list[int]] = {}
        for i, array in enumerate(arrays):
            self.grid[:, i] = self.encode(array, -1)
            self.list(i)

    def encode(self, tokens, wildcard: int) -> np.ndarray:
        out = np.empty(self.length, dtype=np.int32)
        for i, token in enumerate(tokens):
            if token == WILDCARD:
                out[i] = wildcard
                continue
            code = self.codes.get(token)
            if code is None:
                code = self.codes[token] = len(self.words)
                self.words.append(token)
            out[i] = code
        return out

    def decode(self, i: int) -> list[str]:
        return [WILDCARD if c < 0 else self.words[c] for c in self.grid[:, i]]

    def keys(self, x: np.ndarray) -> list[tuple[int, bytes]]:
        """The stretches of ``x`` that hold no wildcard."""
        data, size, whole = x.tobytes(), x.itemsize, x.min() >= 0
        stretches = zip(self.cuts, self.cuts[1:])
        return [(low, data[low * size : high * size]) for low, high in stretches if whole or x[low:high].min() >= 0]

    def list(self, i: int) -> None:
        """Put a cluster under its stretches. It may lose words later: they then propose it in vain."""
        for key in self.keys(np.ascontiguousarray(self.grid[:, i])):
            self.index.setdefault(key, []).append(i)

    def first_fit(self, x: np.ndarray) -> int:
        if not self.size:
            return -1
        near = np.arange(self.size)
        if self.cuts:
            lists = [found for key in self.keys(x) if (found := self.index.get(key))]
            if not lists:
                return -1
            # Long lists cost more to put together than all clusters cost to compare.
            if sum(map(len, lists)) * 32 < self.size * self.length:
                near = np.array(sorted(set().union(*lists)))
        columns = self.grid[:, near] if len(near) < self.size else self.grid[:, : self.size]
        ok = self.fits[self.length - (columns == x[:, None]).sum(axis=0)]
        i = int(ok.argmax())
        return int(near[i]) if ok[i] else -1

    def found(self, line: int, x: np.ndarray) -> int:
        if self.size == self.grid.shape[1]:
            self.grid = np.concatenate([self.grid, np.zeros_like(self.grid)], axis=1)
        self.grid[:, self.size] = np.where(x == -2, -1, x)
        self.founders.append(line)
        self.size += 1
        self.list(self.size - 1)
        return self.size - 1

    def generalise(self, i: int, x: np.ndarray) -> bool:
        column = self.grid[:, i]
        change = (column != x) & (column >= 0)
        column[change] = -1
        return bool(change.any())


def _mine_batch(threshold: float):
    def mine(key: tuple, batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n_tok, block = int(key[0]), int(key[1])
        known = known.sort_values("founder")
        clusters = _Clusters(n_tok, threshold, known["founder"].tolist(), known["state"])
        rows = []
        batch = batch.sort_values("first_line")
        for line, tokens in zip(batch["first_line"].tolist(), batch["tokens"]):
            # A literal wildcard in a message never counts as agreement, hence its own code.
            x = clusters.encode(tokens, -2)
            i = clusters.first_fit(x)
            if i < 0:
                i = clusters.found(line, x)
                changed = True
            else:
                changed = clusters.generalise(i, x)
            founder = clusters.founders[i]
            rows.append((n_tok, block, "member", line, founder, None))
            if changed:
                rows.append((n_tok, block, "version", line, founder, clusters.decode(i)))
        return pd.DataFrame(rows, columns=["n_tok", "block", "kind", "id", "founder", "tokens"])

    return mine


def _mine_first(threshold: float):
    mine = _mine_batch(threshold)
    nothing = pd.DataFrame({"founder": pd.Series([], dtype="int64"), "state": pd.Series([], dtype="object")})

    def first(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        return mine(key, batch, nothing)

    return first


@dataclass
class MinedTemplates:
    """Result of the mining, as DataFrames.

    ``assignments(tokens, token_hash, rows, event_id, text)`` holds each distinct token array once, and as spaced text;
    ``versions(event_id, valid_from, template)`` each template state with the line
    from which it holds; ``lone(line, event_id)`` the rows that are their own event, if any.
    """

    assignments: DataFrame
    versions: DataFrame
    lone: DataFrame | None
    threshold: float
    rounds: int


def _fixed(tokens: Column) -> Column:
    """Positions, from 0, of the words that are no wildcard."""
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.element_at(tokens, i + 1) != WILDCARD)


def _part_keys(tokens: Column, positions: Column, parts: Column, mask: Column) -> Column:
    """A hash of the words in each of ``parts`` stretches of ``positions``; null for a stretch with a wildcard."""
    n, size = F.size(tokens), F.size(positions)

    def key(s: Column) -> Column:
        low, high = F.floor(s * size / parts), F.floor((s + 1) * size / parts)
        stretch = F.slice(positions, (low + 1).cast("int"), (high - low).cast("int"))
        words = F.transform(stretch, lambda p: F.element_at(tokens, p + 1))
        return F.when(~F.array_contains(words, WILDCARD), F.xxhash64(n, mask, s, words))

    return F.transform(F.sequence(F.lit(0), parts - 1), key)


def _segment_keys(tokens: Column, n: Column, parts: Column) -> Column:
    """The keys of all ``n`` positions cut in ``parts``, one more than may differ: who accepts an array has one of its keys.

    Both counts should be columns: an expression would be evaluated for every key.
    """

    # The same hashes as those of ``_part_keys`` over all positions, without a look-up per word.
    def key(s: Column) -> Column:
        low, high = F.floor(s * n / parts), F.floor((s + 1) * n / parts)
        words = F.slice(tokens, (low + 1).cast("int"), (high - low).cast("int"))
        return F.when(~F.array_contains(words, WILDCARD), F.xxhash64(n, F.lit(0).cast("bigint"), s, words))

    return F.transform(F.sequence(F.lit(0), parts - 1), key)


def accepting(arrays: DataFrame, states: DataFrame, threshold: float, masks: int = MASKS) -> DataFrame:
    """``(first_line, founder, covered)``: every array with each cluster whose state would take it.

    ``arrays(n_tok, first_line, tokens)`` meet ``states(n_tok, founder, tokens)`` through an inverted
    index. A state with k wildcards may still lose m - k words, so its other positions are
    cut into m - k + 1 parts, one of which an array must match whole; a state that has lost all it may
    is one key. The ``masks`` most frequent sets of such positions of a length have keys of
    their own; the rest share the keys of all positions. Keys only propose pairs, the words decide.
    ``covered`` arrays would not change the state.
    """
    n, m = F.col("n_tok"), tolerated(F.col("n_tok"), threshold)
    whole = (n, F.col("all_parts"))
    shaped = states.select("n_tok", "founder", "tokens", _fixed(F.col("tokens")).alias("fixed"), (m + 1).alias("all_parts"))
    shaped = shaped.withColumns({"mask": F.xxhash64("fixed"), "parts": F.col("all_parts") - n + F.size("fixed")})
    by_use = Window.partitionBy("n_tok").orderBy(F.desc("uses"), "mask")
    used = shaped.groupBy("n_tok", "mask").agg(F.count(F.lit(1)).alias("uses"), F.first("fixed").alias("fixed"), F.first("parts").alias("parts"))
    ranked = used.withColumn("rank", F.row_number().over(by_use)).filter(F.col("rank") <= masks + 1)
    # At most ``masks`` entries in a list.
    own = F.when(F.col("rank") <= masks, F.struct("mask", "fixed", "parts"))
    lists = ranked.groupBy("n_tok").agg(F.collect_list(own).alias("shapes"), (F.max("rank") > masks).alias("more"))
    known = F.exists("shapes", lambda s: s["mask"] == F.col("mask"))
    state_keys = F.when(known, _part_keys(F.col("tokens"), F.col("fixed"), F.col("parts"), F.col("mask"))).otherwise(_segment_keys(F.col("tokens"), *whole))
    of_states = shaped.join(lists, "n_tok").select("founder", F.explode(state_keys).alias("key"))
    array_keys = F.flatten(F.transform("shapes", lambda s: _part_keys(F.col("tokens"), s["fixed"], s["parts"], s["mask"])))
    array_keys = F.when(F.col("more"), F.concat(array_keys, _segment_keys(F.col("tokens"), *whole))).otherwise(array_keys)
    of_arrays = arrays.withColumn("all_parts", m + 1).join(lists, "n_tok").select("first_line", F.explode(array_keys).alias("key"))
    pairs = of_arrays.filter("key IS NOT NULL").join(of_states.filter("key IS NOT NULL"), "key").select("first_line", "founder").distinct()
    apart = F.size(F.filter(F.zip_with("tokens", "state", lambda a, b: (a != b) | (b == WILDCARD)), lambda x: x))
    wild = F.size("state") - F.size(F.array_remove("state", WILDCARD))
    met = pairs.join(arrays.select("first_line", "n_tok", "tokens"), "first_line")
    met = met.join(states.select("founder", F.col("tokens").alias("state")), "founder").withColumn("apart", apart)
    taken = met.filter(F.lit(1.0) - F.col("apart") / F.col("n_tok") >= F.lit(threshold))
    return taken.select("first_line", "founder", (F.col("apart") == wild).alias("covered"))


def _few_states(states: DataFrame, few: int, threshold: float) -> DataFrame | None:
    """``(n_tok, states)``, the states of a length in one list; None if a length has over ``few``."""
    if (states.groupBy("n_tok").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > few:
        return None
    # A wildcard agrees with nothing, and no word is empty.
    apart = F.transform("tokens", lambda w: F.when(w == WILDCARD, "").otherwise(w))
    wild = _literal_wildcards(F.col("tokens"))
    # A state that has lost all it may only takes texts with its first words: a test that spares most comparisons.
    at = F.array_position("tokens", WILDCARD).cast("int")
    first = F.array_join(F.when(at > 0, F.slice("tokens", 1, at - 1)).otherwise(F.col("tokens")), " ")
    start = F.when(wild >= tolerated(F.size("tokens"), threshold), first).otherwise("")
    # At most ``few`` entries in a list; stored: a row per length, whose size decides the join.
    one = F.struct("founder", apart.alias("state"), wild.alias("wild"), start.alias("start"))
    return cut_lineage(states.groupBy("n_tok").agg(F.collect_list(one).alias("states")), "few")


def _taken_where_they_are(arrays: DataFrame, few: DataFrame, threshold: float) -> DataFrame:
    """``arrays`` with ``takers``, the pairs ``(founder, covered)`` that :func:`accepting` gives, without moving an array."""

    def met(s: Column) -> Column:
        apart = F.size(F.filter(F.zip_with("tokens", s["state"], lambda a, b: a != b), lambda x: x))
        return F.struct(s["founder"].alias("founder"), apart.alias("apart"), s["wild"].alias("wild"))

    near = F.filter("states", lambda s: F.startswith("text", s["start"]))
    fits = F.filter(F.transform(near, met), lambda s: F.lit(1.0) - s["apart"] / F.col("n_tok") >= F.lit(threshold))
    takers = F.transform(fits, lambda s: F.struct(s["founder"].alias("founder"), (s["apart"] == s["wild"]).alias("covered")))
    # The words are split below the join, so once and not for each state.
    return arrays.join(few, "n_tok", "left").select(*arrays.columns, takers.alias("takers"))


def _with_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", words(F.col("text")))


def _component_blocks(left: DataFrame, accepted: DataFrame | None, threshold: float, batch: int) -> DataFrame:
    """``left`` with new blocks, so that arrays of different blocks can never share a cluster.

    Arrays are linked if one could found a cluster that takes the other, which needs a common segment, or if
    a known cluster would take both. Components are hashed into about as many blocks per
    length as there are half batches; a hash that joins two components costs time, not correctness.
    ``single`` arrays are linked to nothing: each is a cluster of its own that takes no other.
    """
    cut = _with_words(left).withColumn("parts", tolerated(F.col("n_tok"), threshold) + 1)
    keys = cut.select("first_line", F.explode(_segment_keys(F.col("tokens"), F.col("n_tok"), F.col("parts"))).alias("key"))
    # Stored: hashed once, read for the hubs and for the links to them.
    keys = cut_lineage(keys, "keys").filter("key IS NOT NULL")
    hubs = keys.groupBy("key").agg(F.min("first_line").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = keys.join(hubs, "key").select(F.col("first_line").alias("u"), F.col("hub").alias("v"))
    if accepted is not None:
        edges = edges.union(accepted.join(left.select("first_line"), "first_line", "left_semi").select("first_line", "founder"))
    components = connected_components(edges)
    sizes = left.groupBy("n_tok").agg(F.ceil(F.count(F.lit(1)) * 2 / batch).alias("n_blocks"))
    placed = left.drop("block").join(sizes, "n_tok")
    placed = placed.join(components, placed["first_line"] == components["node"], "left")
    block = F.pmod(F.xxhash64(F.coalesce("component", "first_line")), F.col("n_blocks")).cast("bigint")
    return placed.select("n_tok", block.alias("block"), "first_line", "text", "rows", F.col("component").isNull().alias("single"))


def _scattered(left: DataFrame, mined: DataFrame, limit: int) -> DataFrame:
    """``n_tok`` of the lengths that hold more than ``limit`` arrays, of which the first mostly founded clusters of their own."""
    own = (F.col("kind") == "member") & (F.col("id") == F.col("founder"))
    many = left.groupBy("n_tok").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("n_tok")
    found = mined.groupBy("n_tok").agg(F.count_if(F.col("kind") == "member").alias("members"), F.count_if(own).alias("own"))
    return found.filter(F.col("own") * 2 > F.col("members")).join(many, "n_tok", "left_semi").select("n_tok")


def _last_lines(left: DataFrame, keys: list[str], most: int, limit: int, deal: int = DEAL) -> DataFrame:
    """``keys`` and ``last``: the line up to which a block has its first ``limit`` arrays, or somewhat fewer.

    Only line numbers are put in order, and only those up to a bound: of the least lines of four times ``limit`` hashes,
    the one that stands at ``limit`` has as many arrays up to it, and seldom many more. What is left of
    a block, of ``most`` arrays at most, is dealt out by hash, each deal sends about
    twice its share, and what stands before the first line that was not sent is complete.
    """
    least = left.groupBy(*keys, F.pmod(F.xxhash64("first_line", F.lit(1)), F.lit(4 * limit)).alias("_hash")).agg(F.min("first_line").alias("_least"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_least"))
    # A row per block, stored: its size decides the join.
    bounds = cut_lineage(least.withColumn("_at", at).filter(F.col("_at") == limit).select(*keys, F.col("_least").alias("_bound")), "bounds")
    left = left.join(bounds, keys, "left").filter(F.col("_bound").isNull() | (F.col("first_line") <= F.col("_bound")))
    deals = max(1, -(-most // deal))
    each = 2 * limit // deals + 100
    dealt = left.select(*keys, "first_line", F.pmod(F.xxhash64("first_line"), F.lit(deals)).alias("_deal"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_deal").orderBy("first_line"))
    sent = dealt.withColumn("_rank", rank).filter(F.col("_rank") <= each + 1)
    unknown = F.min(F.when(F.col("_rank") > each, F.col("first_line"))).over(Window.partitionBy(*keys))
    whole = sent.withColumn("_unknown", unknown).filter(F.col("_unknown").isNull() | (F.col("first_line") < F.col("_unknown")))
    ordered = whole.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first_line")))
    return ordered.filter(F.col("_rank") <= limit).groupBy(*keys).agg(F.max("first_line").alias("last"))


def mine_templates(
    entries: DataFrame,
    threshold: float = 0.75,
    batch: int = BATCH,
    split_after: int = SPLIT_AFTER,
    masks: int = MASKS,
    lines_are_unique: bool = False,
) -> MinedTemplates:
    """Similarity templates of the messages, exactly as first fit in line order gives them.

    ``line`` must be unique over ``entries``; repeated lines are an error. Lines that :func:`read_lines` or
    ``dense_number`` made need no check: ``lines_are_unique`` saves the shuffle of one row per line.
    ``batch`` bounds what one task mines in sequence per round, along with the clusters that would take any of
    it. Messages of one length are one block at first; what outlasts ``split_after`` rounds is cut into
    components, and again after each further round. None of these parameters changes results.
    Only the tables of the result stay in the shared folder.
    """
    with tables_go_after(entries.sparkSession, ("assignments", "versions", "ids", "lone")):
        return _mined(entries, threshold, batch, split_after, masks, lines_are_unique)


def _mined(entries: DataFrame, threshold: float, batch: int, split_after: int, masks: int, lines_are_unique: bool) -> MinedTemplates:
    if not lines_are_unique:
        repeated = entries.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not repeated.isEmpty():
            raise ValueError("lines repeat: number the lines of all files together before mining")
    # Arrays move and are stored as text, which takes a third of the room; they are split where their words count.
    texts = entries.select("line", spaced_words(F.col("message_raw")).alias("text"))
    arrays = texts.groupBy("text").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("rows"))
    # Both marks are stored: as filters before the store they would repeat the search for words. The words are counted, not split.
    counted = arrays.select("*", n_words(F.col("text")).alias("n_tok"), n_literal_wildcards(F.col("text")).alias("literal"))
    counted = counted.withColumn("most", tolerated(F.col("n_tok"), threshold))
    joins = (F.col("n_tok") > 0) & (F.col("literal") <= F.col("most"))
    arrays = cut_lineage(counted.select("text", "first_line", "rows", "n_tok", joins.alias("joins"), (F.col("most") < 1).alias("alone")), "arrays", TEXTS)
    arrays = arrays.filter("joins")

    # Without tolerance every distinct array is a cluster of its own: nothing to mine.
    fixed = arrays.filter("alone")
    own = [F.col("first_line").alias("founder"), F.col("first_line").alias("valid_from"), "tokens"]
    members = []  # by the array's first line only
    placed = [fixed.select("text", "rows", F.col("first_line").alias("founder"))]
    versions = [_with_words(fixed).select(*own)]

    left = arrays.filter("not alone").select("n_tok", F.lit(0).cast("bigint").alias("block"), "first_line", "text", "rows")
    keys = ["n_tok", "block"]
    known = accepted = None
    rounds = 0

    def largest_block() -> int:
        return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def linked(rows: DataFrame, accepted: DataFrame | None) -> DataFrame:
        """``rows`` in blocks of components, without those that no other row can share a cluster with."""
        blocks = cut_lineage(_component_blocks(rows, accepted, threshold, batch), "left")
        single = blocks.filter("single")
        placed.append(single.select("text", "rows", F.col("first_line").alias("founder")))
        versions.append(_with_words(single).select(*own))
        return blocks.filter("not single").drop("single")

    most = largest_block()
    while most:
        if known is not None:
            if rounds >= split_after and most > batch:
                left = linked(left, accepted)
                most = largest_block()
                if not most:
                    break
            known = cut_lineage(known.join(accepted.select("founder").distinct(), "founder", "left_semi").select("n_tok", "founder", "tokens"), "known")
        rounds += 1
        # A short first batch: most logs repeat a few shapes, which it finds.
        limit = batch if most <= batch or rounds > 1 else max(1, batch // 4)
        # All of a block's arrays would not fit one task: only those of the batch are shuffled.
        head = left
        if most > limit:
            # One row per block, stored: its size decides the join.
            last = cut_lineage(_last_lines(left, keys, most, limit), "last")
            head = left.join(last, keys).filter(F.col("first_line") <= F.col("last")).select(left.columns)
        head = _with_words(head).select(*keys, "first_line", "tokens")
        if known is None:
            mined = head.groupBy(*keys).applyInPandas(_mine_first(threshold), _MINED)
        else:
            # States only lose words, so a cluster that takes no array of the batch now never will.
            needed = accepted.join(head.select("first_line", "block"), "first_line").select("founder", "block").distinct()
            open_known = known.join(needed, "founder").select(
                F.col("n_tok").alias("known_tok"), F.col("block").alias("known_block"), "founder", F.col("tokens").alias("state")
            )
            mined = head.groupBy(*keys).cogroup(open_known.groupBy("known_tok", "known_block")).applyInPandas(_mine_batch(threshold), _MINED)
        mined = cut_lineage(mined, "mined")
        if rounds == 1 and split_after <= 1 and most > limit:
            # Where the first arrays hardly meet, the clusters are as many as the arrays: those lengths are cut
            # into components before any of them counts as mined, and no array is joined to clusters.
            scattered = cut_lineage(_scattered(left, mined, limit), "scattered")
            if not scattered.isEmpty():
                mined = mined.join(F.broadcast(scattered), "n_tok", "left_anti")  # a row per length
                apart = linked(left.join(F.broadcast(scattered), "n_tok", "left_semi"), None)
                left = left.join(F.broadcast(scattered), "n_tok", "left_anti").select(apart.columns).unionByName(apart)
        done = mined.filter(F.col("kind") == "member").select("id", "founder")
        members.append(done)
        fresh = mined.filter(F.col("kind") == "version")
        versions.append(fresh.select("founder", F.col("id").alias("valid_from"), "tokens"))
        if most <= limit:
            break

        fresh = cut_lineage(fresh.groupBy("n_tok", "founder").agg(F.max_by("tokens", "id").alias("tokens")), "fresh")
        rest = left.join(done.select(F.col("id").alias("first_line")), "first_line", "left_anti")
        few = _few_states(fresh, FEW, threshold) if accepted is None else None
        if few is not None:
            # Each array is compared with the clusters of its length where it is.
            rest = _taken_where_they_are(_with_words(rest), few, threshold).drop("tokens")
            home = F.array_min("takers")
        else:
            now = accepting(_with_words(rest).select("n_tok", "first_line", "tokens"), fresh, threshold, masks)
            if accepted is not None:
                # What unchanged clusters would take is known from the rounds before.
                old = accepted.join(fresh.select("founder"), "founder", "left_anti").join(rest.select("first_line"), "first_line", "left_semi")
                now = now.unionByName(old)
                fresh = known.join(fresh.select("founder"), "founder", "left_anti").unionByName(fresh)
            accepted = cut_lineage(now, "accepted")
            oldest = accepted.groupBy("first_line").agg(F.min(F.struct("founder", "covered")).alias("home"))
            rest = rest.join(oldest, "first_line", "left")
            home = F.col("home")
        # The oldest cluster that takes an array: if it covers it, no turn of another array matters.
        homes = F.when(home["covered"], home["founder"]).alias("founder")
        more = [] if few is None else ["takers"]
        tested = cut_lineage(rest.select("n_tok", "block", "first_line", "text", "rows", *more, homes), "tested", TEXTS)
        covered = tested.filter("founder IS NOT NULL")
        placed.append(covered.select("text", "rows", "founder"))
        left = tested.filter("founder IS NULL").drop("founder", "takers")
        if few is None:
            accepted = accepted.join(covered.select("first_line"), "first_line", "left_anti")
        else:
            accepted = cut_lineage(tested.filter("founder IS NULL").select("first_line", F.inline("takers")), "accepted")
        known = fresh
        most = largest_block()

    def together(parts):
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    versions = together(versions)
    lone = cut_lineage(_lone_rows(entries, threshold).select("line"), "lone")
    starts = versions.select(F.col("founder").alias("line")).distinct().unionByName(lone)
    ids = cut_lineage(dense_number(starts, "line", "event_id"), "ids").select(F.col("line").alias("founder"), "event_id")
    if members:
        members = together(members)
        placed.append(arrays.join(members, arrays["first_line"] == members["id"]).select("text", "rows", "founder"))
    assignments = cut_lineage(together(placed).join(ids, "founder").select("text", "rows", "event_id"), "assignments", TEXTS)
    assignments = _with_words(assignments).select("tokens", F.xxhash64("tokens").alias("token_hash"), "rows", "event_id", "text")
    versions = versions.join(ids, "founder").select("event_id", "valid_from", F.array_join("tokens", " ").alias("template"))
    if lone.isEmpty():
        lone = None
    else:
        lone = ids.withColumnRenamed("founder", "line").join(lone, "line", "left_semi")
    return MinedTemplates(assignments, cut_lineage(versions, "versions", TEXTS), lone, threshold, rounds)


def _frequent(mined: MinedTemplates, share: float, most: int) -> DataFrame | None:
    """The token arrays that hold more than ``share`` of all lines each, at most ``most`` and none of great length; None without."""
    rows = mined.assignments
    total = rows.agg(F.sum("rows").alias("total")).scalar()
    short = F.length("text") <= FREQUENT_CHARS
    hot = rows.withColumn("total", total).filter(short & (F.col("rows") > share * F.col("total")))
    # Bounded by ``most`` rows of ``FREQUENT_CHARS`` characters.
    found = hot.orderBy(F.desc("rows"), "event_id").limit(most).select("text", "event_id").collect()
    return rows.sparkSession.createDataFrame(found, "text string, event_id bigint") if found else None


def attach_templates(entries: DataFrame, mined: MinedTemplates, *, frequent_share: float = FREQUENT_SHARE, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """Add ``event_id`` and ``template``, the template version in force at each line.

    The versions of an event are few (each takes a word away). Only the lines they start at
    travel with the rows of an event; they tell the number of the version, by which its text is joined.
    Messages that hold more than ``frequent_share`` of the log each, so ``1 / frequent_share`` or ``most_frequent`` at
    most, go to the rows, which then stay where they are; the others meet by a 64-bit hash of their words, and the
    words themselves decide.
    """
    in_order = Window.partitionBy("event_id").orderBy("valid_from")
    numbered = mined.versions.select("event_id", F.row_number().over(in_order).alias("_version"), "valid_from", F.col("template").alias("_text"))
    # Stored, their sizes are known: rows are not shuffled by event if versions are few.
    numbered = cut_lineage(numbered, "numbered")
    starts = cut_lineage(numbered.groupBy("event_id").agg(F.array_sort(F.collect_list("valid_from")).alias("_starts")), "starts")
    kept = [c for c in entries.columns if c not in ("event_id", "template")]
    base = entries.select(*kept, spaced_words(F.col("message_raw")).alias("_spaced"))
    if mined.lone is not None:
        base = base.filter(~F.coalesce(_never_joins(words(F.col("_spaced")), mined.threshold), F.lit(False)))
    version = F.size(F.filter("_starts", lambda s: s <= F.col("line")))

    def named(rows: DataFrame, starts: DataFrame, numbered: DataFrame) -> DataFrame:
        out = rows.join(starts, "event_id", "left").withColumn("_version", version).drop("_starts")
        out = out.join(numbered.drop("valid_from"), ["event_id", "_version"], "left")
        return out.select(*kept, F.coalesce("event_id", F.lit(0).cast("bigint")).alias("event_id"), F.coalesce("_text", F.lit("")).alias("template"))

    # The words as one text: no array is built for a row.
    base = base.withColumn("_hash", F.xxhash64("_spaced"))
    known = [F.xxhash64("text").alias("_hash"), F.col("text").alias("_known"), "event_id"]
    assigned = mined.assignments.select(*known)
    same = [F.col("_hash") == F.col("_other"), F.col("_spaced") == F.col("_known")]

    def by_words(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(some.withColumnRenamed("_hash", "_other"), same, how)

    hot = _frequent(mined, frequent_share, most_frequent)
    parts = []
    if hot is not None:
        # Bounded: ``most_frequent`` short messages; with them go the versions of as many events.
        of_hot = F.broadcast(hot.select(*known))
        events = hot.select("event_id").distinct()
        hot_starts, hot_numbered = (F.broadcast(df.join(events, "event_id", "left_semi")) for df in (starts, numbered))
        parts.append(named(by_words(base, of_hot, "inner").drop("_spaced", "_hash", "_other", "_known"), hot_starts, hot_numbered))
        base = by_words(base, of_hot.drop("event_id"), "left_anti")
    parts.append(named(by_words(base, assigned, "left").drop("_spaced", "_hash", "_other", "_known"), starts, numbered))
    if mined.lone is not None:
        alone = _lone_rows(entries.select(*kept), mined.threshold).join(mined.lone, "line")
        parts.append(alone.select(*kept, "event_id", F.array_join(tokenize(F.col("message_raw")), " ").alias("template")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drain_templates(entries: DataFrame, threshold: float = 0.75, batch: int = BATCH) -> DataFrame:
    """Entries with the ``event_id`` and ``template`` of similarity mining."""
    return attach_templates(entries, mine_templates(entries, threshold, batch))


def template_versions(mined: MinedTemplates) -> DataFrame:
    """``(event_id, version, valid_from, valid_to, template)``; the last one is open-ended."""
    w = Window.partitionBy("event_id").orderBy("valid_from")
    return mined.versions.select(
        "event_id",
        F.row_number().over(w).cast("bigint").alias("version"),
        "valid_from",
        F.lead("valid_from").over(w).alias("valid_to"),
        "template",
    )


def template_catalogue(entries: DataFrame) -> DataFrame:
    """``(event_id, template, count, first_line)``: final template and size of each event."""
    per_version = (
        entries.filter(F.col("event_id") != 0)
        .groupBy("event_id", "template")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    )
    return per_version.groupBy("event_id").agg(
        F.max_by("template", "hi").alias("template"),
        F.sum("n").alias("count"),
        F.min("lo").alias("first_line"),
    )


def distinct_templates(entries: DataFrame, per: str = "version") -> DataFrame:
    """``(template_idx, event_id, template, line)``: distinct templates in order of appearance.

    ``per='version'`` keeps every state of an evolving template, ``per='event'`` only
    the final one. The index starts at 0.
    """
    if per not in ("version", "event"):
        raise ValueError("per must be 'version' or 'event'")
    named = entries.filter(F.col("template") != "")
    if per == "version":
        found = named.groupBy("event_id", "template").agg(F.min("line").alias("line"))
    else:
        found = template_catalogue(named).select("event_id", "template", F.col("first_line").alias("line"))
    numbered = dense_number(found, "line", "_n")
    return numbered.select((F.col("_n") - 1).alias("template_idx"), "event_id", "template", "line")
