"""Similarity of two compacted texts (Ratcliff/Obershelp, ``2*M/T``).

``M`` is found by taking the longest common block, then the longest ones to its left
and to its right, and so on; ``T`` is the number of characters of both texts. In a
second text of 200 characters or more, a character that makes up more than one
hundredth of it (and one occurrence) is *popular*: blocks can't begin with it, they
only grow over it. Of equally long blocks the one that starts first in the first
text is taken, then the one that starts first in the second. The order
(translation, fitted) matters: the score is not symmetric.

The matcher works on arrays, over many pairs of texts at a time. All places where two
texts have an unpopular character in common are made at once; neighbours on a diagonal
are one *run*. A range of both texts needs no new search: its blocks are the runs cut to
the range, so every step looks at the runs left in its range only. A step takes one block
in every open range of all pairs. Equal texts score 1.0 in Spark itself, without Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import compact_text

#: Length from which on a text has popular characters.
POPULAR_FROM = 200
#: About so many characters of first texts, and common places, are looked at together
#: (a longer pair is alone).
SLICE_CHARS, SLICE_PLACES = 1 << 18, 1 << 18
#: Bits of a character in a key; the places between two texts have keys of their own.
_CHAR, _GAP_A, _GAP_B = 22, 0, 1


def _slices(sizes: np.ndarray, most: int):
    """Stretches of a list whose sizes add up to ``most`` (a larger element is alone)."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _keys(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' characters as keys that no two texts have in common, with a gap before,
    between and after the texts; where texts start, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = 1 + np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    keys = np.full(1 + len(owner), gap, np.int64)
    keys[1:] += owner << _CHAR
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    keys[np.arange(len(codes)) + np.repeat(1 + np.arange(len(texts)), size)] += codes + np.int64(2 - gap)
    return keys, start, size


def _agree(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int = 1) -> np.ndarray:
    """How far a from i on and b from j on agree (backwards: ``way`` -1), at most ``most``."""
    n, live, step = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 1
    while len(live):
        at = np.arange(step)
        p, q = i[live] + way * n[live], j[live] + way * n[live]
        differ = a.take(p[:, None] + way * at, mode="clip") != b.take(q[:, None] + way * at, mode="clip")
        differ |= at >= (most[live] - n[live])[:, None]
        got = np.where(differ.any(1), differ.argmax(1), step)
        n[live] += got
        live = live[got == step]
        step = min(2 * step, max(8, (1 << 20) // max(1, len(live))))
    return n


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """M of every pair of texts: the characters in their matching blocks."""
    out = [np.empty(0, np.int64)]
    for i, j in _slices(np.fromiter(map(len, first), np.int64, len(first)), SLICE_CHARS):
        out += _matched_slice(first[i:j], second[i:j])
    return np.concatenate(out)


def _matched_slice(first: list[str], second: list[str]):
    (a, a0, la), (b, b0, lb) = _keys(first, _GAP_A), _keys(second, _GAP_B)
    order = np.argsort(b, kind="stable")
    chars, at, count = np.unique(b[order], return_index=True, return_counts=True)
    size = lb[chars >> _CHAR]
    usable = (size < POPULAR_FROM) | (count <= size // 100 + 1)
    own = np.minimum(np.searchsorted(chars, a), len(chars) - 1)
    common = (chars[own] == a) & usable[own]
    times = np.where(common, count[own], 0)
    # unpopular characters only; the others are equal to none
    plain_a, plain_b = np.where(common, a, -1), np.empty_like(b)
    plain_b[order] = np.where(np.repeat(usable, count), b[order], -2)
    places = np.add.reduceat(times, a0 - 1)
    for p, q in _slices(places, SLICE_PLACES):
        s, e = a0[p], a0[q - 1] + la[q - 1]
        t = times[s:e]
        i = np.repeat(np.arange(s, e), t)
        j = order[np.repeat(at[own[s:e]], t) + np.arange(len(i)) - np.repeat(np.cumsum(t) - t, t)]
        begins = plain_a[i - 1] != plain_b[j - 1]
        i, j = i[begins], j[begins]
        n = 1 + _agree(plain_a, plain_b, i + 1, j + 1, np.full(len(i), len(a)))
        yield _blocks(a, b, a0[p:q], a0[p:q] + la[p:q], b0[p:q], b0[p:q] + lb[p:q], i, j, n, (a[i] >> _CHAR) - p)


def _blocks(a, b, alo, ahi, blo, bhi, i, j, n, of) -> np.ndarray:
    """The characters in the matching blocks of ranges of a and b; i, j, n: starts and
    lengths of their runs, ``of``: the range of each, ascending."""
    total, pair = np.zeros(len(alo), np.int64), np.arange(len(alo))
    while len(alo):
        back = np.maximum(np.maximum(alo[of] - i, blo[of] - j), 0)
        i, j, n = i + back, j + back, n - back
        n = np.minimum(np.minimum(n, ahi[of] - i), bhi[of] - j)
        left = n > 0
        i, j, n, of = i[left], j[left], n[left], of[left]
        x, y, size = alo.copy(), blo.copy(), np.zeros(len(alo), np.int64)
        if len(n):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            longest = np.zeros(len(alo), np.int64)
            longest[of[starts]] = np.maximum.reduceat(n, starts)
            best = np.flatnonzero(n == longest[of])
            best = best[np.lexsort((j[best], i[best], of[best]))]
            best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])]
            x[of[best]], y[of[best]], size[of[best]] = i[best], j[best], n[best]
        before = _agree(a, b, x - 1, y - 1, np.minimum(x - alo, y - blo), -1)
        x, y, size = x - before, y - before, size + before
        size += _agree(a, b, x + size, y + size, np.minimum(ahi - x, bhi - y) - size)
        np.add.at(total, pair, size)
        x2, y2 = x + size, y + size
        low, high = (size > 0) & (alo < x) & (blo < y), (size > 0) & (x2 < ahi) & (y2 < bhi)
        in_low = low[of] & (i < x[of]) & (j < y[of])
        in_high = high[of] & (i + n > x2[of]) & (j + n > y2[of])
        i, j, n = (np.concatenate([v[in_low], v[in_high]]) for v in (i, j, n))
        of = np.concatenate([(np.cumsum(low) - 1)[of[in_low]], (low.sum() + np.cumsum(high) - 1)[of[in_high]]])
        alo, ahi = np.concatenate([alo[low], x2[high]]), np.concatenate([x[low], ahi[high]])
        blo, bhi = np.concatenate([blo[low], y2[high]]), np.concatenate([y[low], bhi[high]])
        pair = np.concatenate([pair[low], pair[high]])
    return total


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """2*M/T of every pair; 1.0 for two empty texts.

    If one text of a pair begins with the other one, M is the shorter's length: every run of
    other places has one at least as long, and begun no later, on the diagonal from the two
    beginnings, so the first block is taken there and grows over the whole shorter text.
    """
    both = np.fromiter(map(len, first), np.int64, len(first)) + np.fromiter(map(len, second), np.int64, len(second))
    return np.where(both > 0, 2.0 * matched(first, second) / np.maximum(both, 1), 1.0)


def ratio(a: str, b: str) -> float:
    """2*M/T; 1.0 for two empty texts."""
    return float(ratios([a], [b])[0])


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out[there] = ratios(a.iloc[there].tolist(), b.iloc[there].tolist())
    return pd.Series(out)


def with_match_score(df: DataFrame, left: str, right: str, out: str = "score") -> DataFrame:
    """Adds ``out`` = similarity of ``compact(left)`` and ``compact(right)``.

    One pass: the Python matcher receives the compacted pair only for rows
    whose texts differ and nulls otherwise (Arrow sends just the argument
    columns, so equal rows cost almost nothing there); equal pairs score 1.0
    natively. Where one text begins with the whole other one, that is the first block, and
    nothing is left to match (see ``ratios``), so these pairs are scored natively as well.
    Rows with a null side get a null score.
    """
    a, b, native = "_ms_a", "_ms_b", "_ms_n"
    there = F.col(left).isNotNull() & F.col(right).isNotNull()
    unlike = there & (F.col(left) != F.col(right))
    d = df.withColumn(a, F.when(unlike, compact_text(left))).withColumn(b, F.when(unlike, compact_text(right)))
    la, lb = F.length(a), F.length(b)
    begins = F.startswith(F.col(a), F.col(b)) | F.startswith(F.col(b), F.col(a))
    known = F.when(there & F.col(a).isNull(), F.lit(1.0)).when(F.col(a) == F.col(b), F.lit(1.0)).when(begins, F.lit(2.0) * F.least(la, lb) / (la + lb))
    d = d.withColumn(native, known)
    needs = F.col(a).isNotNull() & F.col(native).isNull()
    d = d.withColumn("_ms_r", _ratio_udf(F.when(needs, F.col(a)), F.when(needs, F.col(b))))
    return d.withColumn(out, F.when(there, F.coalesce(F.col(native), F.col("_ms_r")))).drop(a, b, native, "_ms_r")
