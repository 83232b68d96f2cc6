"""Expressions over message text: blanks, regex groups, tokens, templates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import patterns as P

_SEP = "\x01"


def strip(col: Column) -> Column:
    """Drop outer white space of any Unicode kind (``trim`` drops blanks only)."""
    plain = lambda c: F.ascii(c).between(33, 126)
    # Between two printable characters there is nothing to search for.
    return F.when(plain(col) & plain(F.substring(col, -1, 1)), col).otherwise(F.regexp_replace(col, P.OUTER_BLANKS, ""))


def split_groups(col: Column, pattern: str, n: int) -> Column:
    """The groups of a whole-line pattern in one pass, for :func:`match_groups`: the line is rewritten to its groups, and split."""
    return F.split(F.regexp_replace(col, pattern, _SEP.join(f"${i + 1}" for i in range(n))), _SEP, n)


def match_groups(col: Column, pattern: str, n: int, once: Column | None = None) -> Column:
    """The ``n`` groups of a whole-line pattern as one array; null without a match.

    The regex rewrites the line to its groups, joined by a separator, and the split undoes the join.
    Only lines that hold the separator themselves take the group-by-group way. ``once`` is a column of
    :func:`split_groups`, selected before: an expression inside a condition would run twice per line.
    """
    once = split_groups(col, pattern, n) if once is None else once
    each = F.when(
        col.rlike(pattern),
        F.array(*[F.regexp_extract(col, pattern, i + 1) for i in range(n)]),
    )
    return F.when(F.contains(col, F.lit(_SEP)), each).otherwise(F.when(F.size(once) == n, once))


def may_hold_stamp(message: Column) -> Column:
    """Whether both separators of an embedded date and time occur: cheaper than its pattern, and mostly false."""
    return F.contains(message, F.lit("/")) & F.contains(message, F.lit(":"))


def spaced_words(message: Column) -> Column:
    """The words of a message one blank apart; an embedded date and time becomes one wildcard word.

    No word holds a blank, so equal texts are equal words.
    """
    given = F.coalesce(message, F.lit(""))
    text = F.when(may_hold_stamp(given), F.regexp_replace(given, P.STAMP, f" {P.WILDCARD} ")).otherwise(given)
    # Single spaces and no other blank, as in most messages of any language, need no search by the dear pattern.
    # In a function of the text: an expression that parses it would be repeated for each of the blanks.
    odd = given.rlike(P.NOT_PLAIN) & F.exists(F.array(given), lambda t: reduce(or_, [F.contains(t, F.lit(c)) for c in P.ODD_BLANKS]))
    uneven = F.contains(text, F.lit("  ")) | odd
    return F.trim(F.when(uneven, F.regexp_replace(text, P.UNEVEN_BLANKS, " ")).otherwise(text))


def words(spaced: Column) -> Column:
    """The words of a text of :func:`spaced_words`. A split by one plain character compiles no pattern for the row."""
    return F.array_remove(F.split(spaced, " "), "")


def n_words(spaced: Column) -> Column:
    """How many words a text of :func:`spaced_words` has, without a split."""
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def n_literal_wildcards(spaced: Column) -> Column:
    """How many words of such a text are the wildcard; most texts are not split for it."""
    return F.when(F.contains(spaced, F.lit(P.WILDCARD)), F.size(words(spaced)) - F.size(F.array_remove(words(spaced), P.WILDCARD))).otherwise(0)


def tokenize(message: Column) -> Column:
    """Words of a message; an embedded date and time becomes one wildcard word."""
    return words(spaced_words(message))


def is_variable(token: Column) -> Column:
    return (token == "") | token.rlike(P.VARIABLE)


def mask_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(is_variable(t), P.WILDCARD).otherwise(t))


def masked_template(message: Column) -> Column:
    """The message with every value-like word replaced by the wildcard.

    The same as joining ``mask_tokens(tokenize(message))``, in one pass over the text.
    """
    return F.regexp_replace(spaced_words(message), P.VARIABLE_WORD, P.WILDCARD)


def merge_tokens(left: Column, right: Column) -> Column:
    """Position-wise merge: equal words stay, others become the wildcard.

    Where ``left`` is longer its tail is kept; where ``right`` is longer the tail
    becomes wildcards. ``zip_with`` pads the shorter side with nulls.
    """
    return F.zip_with(
        left,
        right,
        lambda a, b: F.when(b.isNull() | (a == b), a).otherwise(P.WILDCARD),
    )


def shorten(col: Column, n: int, mark: str = "") -> Column:
    """First ``n`` characters for display, with ``mark`` after a cut."""
    head = F.substring(col, 1, n)
    if not mark:
        return head
    return F.when(F.length(col) > n, F.concat(head, F.lit(mark))).otherwise(head)


def fixed(x: Column, digits: int) -> Column:
    """A number with ``digits`` (at most 3) decimals, as text, rounded half to even.

    The rounding sees the exact binary value, as C's ``printf`` does; ``round`` and
    ``format_string`` go by the shortest decimal text and differ on 20.15 and the
    like. The fraction is scaled by powers of two, which is exact, and split with
    whole-number arithmetic.
    """
    unit = 1 << 52
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(unit))
    bits = F.floor(scaled)
    tens = bits * F.lit(10**digits)
    rest = F.pmod(tens, F.lit(unit))
    kept = F.shiftright(tens - rest, 52)
    above = (rest * 2 > unit) | ((rest * 2 == unit) & ((scaled > bits) | (kept % 2 == 1)))
    number = whole * F.lit(10**digits) + kept + F.when(above, 1).otherwise(0)
    tail = F.pmod(number, F.lit(10**digits))
    head = ((number - tail) / F.lit(10**digits)).cast("bigint").cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    text = F.concat(sign, head) if digits == 0 else F.concat(sign, head, F.lit("."), F.lpad(tail.cast("string"), digits, "0"))
    return F.when(x.isNotNull(), text)
