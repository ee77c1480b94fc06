"""Jaro-Winkler similarity, which Spark has no function for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(a: str, b: str) -> tuple[bytearray, bytearray] | None:
    """Both strings with a byte for each character, never 0; None if they have more than 255 different ones."""
    try:
        x, y = a.encode("latin-1"), b.encode("latin-1")
        if 0 not in x and 0 not in y:
            return bytearray(x), bytearray(y)
    except UnicodeEncodeError:
        pass
    code = {c: i + 1 for i, c in enumerate(dict.fromkeys(a + b))}
    return (bytearray(code[c] for c in a), bytearray(code[c] for c in b)) if len(code) < 256 else None


def jaro(a: str, b: str) -> float:
    """Jaro's similarity. A character of a takes the first free one like it in b, not further off than half the longer
    string; what is taken becomes 0, so the search for the next is one call."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    codes = _codes(a, b)
    x, y = codes or (list(a), list(b))
    reach, left, found = max(0, max(len(a), len(b)) // 2 - 1), [], []
    for i, c in enumerate(x):
        low, high = max(0, i - reach), i + reach + 1
        if codes:
            j = y.find(c, low, high)
        else:
            j = next((k for k in range(low, min(len(y), high)) if y[k] == c), -1)
        if j >= 0:
            y[j] = 0
            left.append(c)
            found.append(j)
    if not left:
        return 0.0
    own = (codes and _codes(a, b)[1]) or list(b)
    swaps = sum(p != own[j] for p, j in zip(left, sorted(found), strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_similarity(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro's similarity; above 0.7 it gains weight for each of up to 4 common first characters."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + prefix * weight * (1 - s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either is null. Equal strings, most of the pairs in a block, aren't compared by character."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else jaro_winkler_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
