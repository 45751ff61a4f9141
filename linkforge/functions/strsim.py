"""Jaro-Winkler similarity, and vectors of similarities to anchor strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, and from 0.7 on a tenth of the rest for each of up to four equal first characters; 0 if a string is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    matched_a: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                matched_a.append(c)
                break
    m = len(matched_a)
    if not m:
        return 0.0
    matched_b = [c for c, f in zip(b, free) if not f]
    crossed = sum(x != y for x, y in zip(matched_a, matched_b)) // 2
    similarity = (m / len(a) + m / len(b) + (m - crossed) / m) / 3
    if similarity > 0.7:
        common = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        similarity += 0.1 * common * (1 - similarity)
    return similarity


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text in a row, 0 behind its end, and the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _in_order(chars: np.ndarray, some: np.ndarray, width: int) -> np.ndarray:
    """Of each row the characters marked, moved to the left."""
    out = np.zeros((len(chars), width), np.uint32)
    row, at = np.nonzero(some)
    out[row, (np.cumsum(some, axis=1) - 1)[row, at]] = chars[row, at]
    return out


def jaro_winkler_many(a: list[str], b: list[str], rows: int = 4096) -> np.ndarray:
    """The same of many pairs at once; all pairs' characters at two places are compared in one step."""
    out = np.zeros(len(a))
    for start in range(0, len(a), rows):
        (x, n), (y, m) = _codes(a[start : start + rows]), _codes(b[start : start + rows])
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        free, matched, widest = np.arange(y.shape[1]) < m[:, None], np.zeros(x.shape, bool), int(reach.max(initial=0))
        for i in range(x.shape[1]):
            open_ = i < n
            for j in range(max(0, i - widest), min(y.shape[1], i + widest + 1)):
                hit = open_ & free[:, j] & (x[:, i] == y[:, j]) & (abs(i - j) <= reach)
                free[:, j] &= ~hit
                open_ &= ~hit
                matched[:, i] |= hit
        k = matched.sum(axis=1)
        width = int(k.max(initial=0))
        crossed = (_in_order(x, matched, width) != _in_order(y, ~free & (np.arange(y.shape[1]) < m[:, None]), width)).sum(axis=1) // 2
        some = np.maximum(k, 1)
        similarity = np.where(k > 0, (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - crossed) / some) / 3, 0.0)
        four = min(4, x.shape[1], y.shape[1])
        alike = (x[:, :four] == y[:, :four]) & (np.arange(four) < np.minimum(n, m)[:, None])
        common = np.minimum.accumulate(alike, axis=1).sum(axis=1) if four else np.zeros(len(n), np.int64)
        out[start : start + rows] = np.where(similarity > 0.7, similarity + 0.1 * common * (1 - similarity), similarity)
    return out


def jaro_winkler_udf():
    """A pandas UDF of two string columns; null if either is."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.full(len(a), np.nan), dtype=object)
        known = (a.notna() & b.notna()).to_numpy()
        out[:] = None
        out[known] = jaro_winkler_many(a[known].tolist(), b[known].tolist())
        return out

    return f


def similarity_vector(anchors: list[str], scorer: Callable[[str, str], float] = jaro_winkler):
    """A pandas UDF from strings to their similarities to each anchor; the anchors, a bounded list, go with the function."""

    @F.pandas_udf("array<double>")
    def f(texts: pd.Series) -> pd.Series:
        if scorer is not jaro_winkler:
            return texts.map(lambda t: None if t is None else [scorer(t, a) for a in anchors])
        known = texts[texts.notna()]
        distinct = known.unique().tolist()
        scores = np.stack([jaro_winkler_many(distinct, [a] * len(distinct)) for a in anchors], axis=1) if anchors and distinct else np.zeros((len(distinct), 0))
        of = dict(zip(distinct, scores.tolist()))
        return texts.map(lambda t: None if t is None else of[t])

    return f
