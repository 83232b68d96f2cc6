"""Severity of a message, from its words and its component name."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import patterns as P

RULESETS = ("current", "legacy")


def _has_word(col: Column, words) -> Column:
    # A plain search rules most messages out before the word boundaries are looked at.
    some = reduce(or_, [F.contains(col, F.lit(w)) for w in words])
    return some & col.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")


def infer_level(message: Column, component: Column | None = None, ruleset: str = "current") -> Column:
    """``Error``, ``Warning`` or ``Info``; the first rule that holds decides.

    The ``legacy`` ruleset also counts ``E_FAIL`` as an error and lets an explicit
    information word win over a failed HRESULT.
    """
    if ruleset not in RULESETS:
        raise ValueError(f"ruleset must be one of {RULESETS}")
    message = F.coalesce(message, F.lit(""))
    upper = F.upper(message)
    legacy = ruleset == "legacy"
    level = F.when(_has_word(upper, P.ERROR_WORDS_LEGACY if legacy else P.ERROR_WORDS), "Error")
    level = level.when(_has_word(upper, P.WARNING_WORDS), "Warning")
    if legacy:
        level = level.when(_has_word(upper, P.INFO_WORDS), "Info")
    level = level.when(F.contains(message, F.lit("HRESULT")) & message.rlike(P.FAILED_HRESULT), "Error")
    if component is not None:
        name = F.upper(component)
        for word in ("Error", "Warning", "Info"):
            level = level.when(name == word.upper(), word)
    return level.otherwise("Info")
