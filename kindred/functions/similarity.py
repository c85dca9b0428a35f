"""Similarity features of a pair of records."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two arrays without repeats; 0 of two empty ones (F1)."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 of two empty texts (F2)."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


@lru_cache(65_536)
def jaro_winkler_of(a: str, b: str) -> float:
    """Winkler's form: prefix of at most 4, weight 0.1, only for a Jaro similarity over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left, right = [False] * len(b), [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + (prefix * 0.1 * (1 - jaro) if jaro > 0.7 else 0)


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """F3; Spark has no such function."""
    return _jaro_winkler(a, b)


def acronym(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def acronym_match(a_words: Column, b_words: Column) -> Column:
    """Whether one name is the acronym of the other's two or more words."""
    one = lambda x, y: (F.size(x) > 1) & (acronym(x) == F.array_join(y, ""))
    return one(a_words, b_words) | one(b_words, a_words)


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller of two arrays without repeats; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def same_known(a: Column, b: Column) -> Column:
    """Equal and known."""
    return (a == b) & (a != "")


def missing_pattern(*flags: Column) -> Column:
    """Flags as one text of 0 and 1."""
    return F.concat(*[f.cast("int").cast("string") for f in flags])
