"""Similarity of names: Jaro-Winkler and vendor similarity as Arrow UDFs over distinct pairs.

The comparison loops over character positions of whole batches, never over rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about a vendor.
NOISE = (
    "pvt ltd private limited llp inc india co corp corporation mktp mktplace us in the and neft rtgs imps upi nach ach "
    "dr cr pos payment pay services svc"
).split()
_NOISE = frozenset(NOISE)
_OTHER = re.compile(r"[^a-z0-9 ]+")


def tokens(name: str | None) -> list[str]:
    """The words of a name that may tell it apart: lower case, longer than one character, no noise, no digits."""
    words = _OTHER.sub(" ", (name or "").lower()).split(" ")
    return [w for w in words if len(w) > 1 and w not in _NOISE and not any("0" <= c <= "9" for c in w)]


def token_column(name: Column) -> Column:
    """``tokens`` as Spark expressions; null gives no tokens."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]+", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*NOISE) & ~w.rlike("[0-9]"))


def skeleton(word: str) -> str:
    """First letter and the consonants behind it."""
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def skeleton_column(word: Column) -> Column:
    return F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substring(word, 2, 1 << 20), "[aeiou]", ""))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0))), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, size


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler of each pair; the prefix bonus always applies and half transpositions count."""
    if not a:
        return np.zeros(0)
    x, nx = _matrix(a)
    y, ny = _matrix(b)
    n, wide = len(a), y.shape[1]
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    at = np.arange(wide)[None]
    free = at < ny[:, None]
    taken_x = np.zeros((n, x.shape[1]), bool)
    for i in range(x.shape[1] if wide else 0):
        fit = free & (at >= (i - reach)[:, None]) & (at <= (i + reach)[:, None]) & (y == x[:, i : i + 1]) & (i < nx)[:, None]
        got = fit.any(axis=1)
        rows = np.flatnonzero(got)
        free[rows, fit[rows].argmax(axis=1)] = False
        taken_x[rows, i] = True
    taken_y = (at < ny[:, None]) & ~free
    m = taken_x.sum(axis=1)
    # the k-th matched character of one side against the k-th of the other
    most = int(m.max(initial=0))
    left, right = np.zeros((n, most), np.int32), np.zeros((n, most), np.int32)
    for taken, chars, out in ((taken_x, x, left), (taken_y, y, right)):
        r, c = np.nonzero(taken)
        k = (np.cumsum(taken, axis=1) - 1)[r, c]
        out[r, k] = chars[r, c]
    swaps = (left != right).sum(axis=1)
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(nx, 1) + m / np.maximum(ny, 1) + (m - swaps / 2) / some) / 3, 0.0)
    prefix, same = np.zeros(n), np.ones(n, bool)
    for k in range(min(4, x.shape[1], wide)):
        same &= (k < nx) & (k < ny) & (x[:, k] == y[:, k])
        prefix += same
    out = np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return np.where([p == q for p, q in zip(a, b)], 1.0, out)


def vendor_similarity(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Similarity of vendor names, to two places: of the joined tokens, or .97 of the best pair of tokens.

    Tokens of three letters or more that share a consonant skeleton count at least .92; a name without
    tokens is similar to nothing.
    """
    left, right = [tokens(s) for s in a], [tokens(s) for s in b]
    pairs: dict[tuple[str, str], int] = {}
    rows, cols = [], []
    for i, (s, t) in enumerate(zip(left, right)):
        for p in s:
            for q in t:
                rows.append(i)
                cols.append(pairs.setdefault((p, q), len(pairs)))
    one, two = [p for p, _ in pairs], [q for _, q in pairs]
    score = jaro_winkler(one, two)
    for k, (p, q) in enumerate(pairs):
        if len(p) >= 3 and len(q) >= 3:
            sp, sq = skeleton(p), skeleton(q)
            if sp == sq or sp == q or p == sq:
                score[k] = max(score[k], 0.92)
    best = np.zeros(len(left))
    if rows:
        np.maximum.at(best, np.array(rows), score[np.array(cols)])
    full = jaro_winkler([" ".join(s) for s in left], [" ".join(t) for t in right])
    out = np.floor(np.maximum(full, best * 0.97) * 100 + 0.5) / 100
    empty = np.array([not s or not t for s, t in zip(left, right)], bool)
    return np.where(empty, 0.0, out) if len(out) else out


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler(a.fillna("").tolist(), b.fillna("").tolist()))


#: Pairs of names that a Python worker remembers.
REMEMBERED = 1 << 17
_known: dict[tuple[str | None, str | None], float] = {}


@F.pandas_udf(T.DoubleType())
def vendor_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Names repeat from row to row, so each distinct pair of a batch is compared once and remembered for the next."""
    pairs = list(zip(a.where(a.notna(), None), b.where(b.notna(), None)))
    fresh = [p for p in dict.fromkeys(pairs) if p not in _known]
    if len(_known) + len(fresh) > REMEMBERED:
        _known.clear()
        fresh = list(dict.fromkeys(pairs))
    _known.update(zip(fresh, vendor_similarity([p for p, _ in fresh], [q for _, q in fresh]).tolist()))
    return pd.Series([_known[p] for p in pairs], dtype=float)


def with_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Add the vendor similarity of two columns. Equal names are settled by Spark and others in Arrow batches, where they
    stand: no shuffle and no second reading of the pairs."""
    x, y = F.col(a), F.col(b)
    equal = x.eqNullSafe(y)
    same = F.when(F.size(token_column(x)) > 0, 1.0).otherwise(0.0)
    unequal = vendor_similarity_udf(F.when(~equal, x), F.when(~equal, y))
    return pairs.withColumn(out, F.when(equal, same).otherwise(unequal))
