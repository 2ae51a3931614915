"""Jaro and Jaro-Winkler similarity as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BOOST_FROM = 0.7
BOOST_CHARS = 4
BOOST = 0.1


def jaro(a: str, b: str) -> float:
    """Share of matching characters within half the longer length, less transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    matched_a, places = [], []
    for i, char in enumerate(a):
        at = b.find(char, max(i - reach, 0), i + reach + 1)
        while at >= 0 and not free[at]:
            at = b.find(char, at + 1, i + reach + 1)
        if at >= 0:
            free[at] = False
            matched_a.append(char)
            places.append(at)
    m = len(matched_a)
    if not m:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(matched_a, sorted(places), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    score = jaro(a, b)
    if score < BOOST_FROM:
        return score
    prefix = next((i for i, (x, y) in enumerate(zip(a[:BOOST_CHARS], b, strict=False)) if x != y), min(len(a), len(b), BOOST_CHARS))
    return score + prefix * BOOST * (1 - score)


@F.pandas_udf(DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either is."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
