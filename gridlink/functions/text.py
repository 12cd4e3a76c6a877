"""Name functions: normal form, tokens, and the two classical similarities."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points whose case-folded form differs from lower case, from Python's own tables.
_FOLDS = {chr(c): chr(c).casefold() for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()}


def casefold(s: Column) -> Column:
    """Python's str.casefold; only texts beyond ASCII pay for more than lower()."""
    one = {k: v for k, v in _FOLDS.items() if len(v) == 1}
    folded = F.translate(F.lower(s), "".join(one), "".join(one.values()))
    many = F.create_map(*(F.lit(x) for k, v in _FOLDS.items() if len(v) > 1 for x in (k, v)))
    spread = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(many[c], c)), "")
    return F.when(s.rlike(r"[^\x00-\x7f]"), spread).otherwise(F.lower(s))


def normalise(name: Column) -> Column:
    """Case-folded, letters and digits only, single spaces; null is empty."""
    plain = F.regexp_replace(casefold(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}\s\x1c-\x1f\x85\p{Z}]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def clean(name: Column) -> Column:
    """The name, or null where it holds nothing but white space."""
    return F.when(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f]", "") != "", name)


def plain_normalise(name: str | None) -> str:
    """normalise() of one name, without Spark."""
    return " ".join("".join(c if c.isalnum() else " " for c in (name or "").casefold()).split())


def tokens(name: Column) -> Column:
    """Distinct words of the normal form; none for an empty name."""
    return F.array_distinct(F.array_remove(F.split(normalise(name), " "), ""))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
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
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    base, one, two = (" ".join(p) for p in (both, both + only_x, both + only_y))
    found = [_indel_ratio(one, two)]
    if both:
        found += [_indel_ratio(base, one), _indel_ratio(base, two)]
    return max(found)


#: Cells of one comparison matrix; longer names are compared in smaller groups.
_CELLS = 1 << 22


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows, filled up with zeros, and the lengths."""
    size = np.array([len(n) for n in names], np.int64)
    wide = max(1, int(size.max(initial=0)))
    return np.array(names, f"U{wide}").view(np.uint32).reshape(len(names), wide), size


def _in_groups(compare, a: list[str], b: list[str]) -> np.ndarray:
    """compare over groups of pairs of like lengths, so that one long name doesn't widen all rows."""
    sizes = np.array([len(x) * len(y) + 1 for x, y in zip(a, b, strict=True)])
    out, order, at = np.zeros(len(a)), np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 1 << 14 and (end + 1 - at) * sizes[order[end]] <= _CELLS:
            end += 1
        some = order[at:end]
        out[some] = compare([a[i] for i in some], [b[i] for i in some])
        at = end
    return out


def _jaro_winkler_group(a: list[str], b: list[str]) -> np.ndarray:
    x, n = _codes(a)
    y, m = _codes(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    place = np.arange(y.shape[1])
    real = place < m[:, None]
    taken, met, rows = np.zeros(y.shape, bool), np.zeros(x.shape, bool), np.arange(len(a))
    for i in range(x.shape[1]):
        free = (y == x[:, i : i + 1]) & real & ~taken & (np.abs(place - i) <= reach) & (i < n)[:, None]
        first = free.argmax(1)
        met[:, i] = free[rows, first]
        taken[rows, first] |= met[:, i]
    hits = met.sum(1)
    # the matched characters of either side, in order, at the front
    left = np.take_along_axis(x, np.argsort(~met, axis=1, kind="stable"), 1)
    right = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable"), 1)
    wide = min(x.shape[1], y.shape[1])
    swaps = ((left[:, :wide] != right[:, :wide]) & (np.arange(wide) < hits[:, None])).sum(1) // 2
    some = np.maximum(hits, 1)
    jaro = np.where(hits > 0, (hits / np.maximum(n, 1) + hits / np.maximum(m, 1) + (hits - swaps) / some) / 3, 0.0)
    head = min(4, wide)
    alike = (x[:, :head] == y[:, :head]) & (np.arange(head) < np.minimum(n, m)[:, None])
    prefix = np.cumprod(alike, axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def _indel_group(a: list[str], b: list[str]) -> np.ndarray:
    x, n = _codes(a)
    y, m = _codes(b)
    real = np.arange(y.shape[1]) < m[:, None]
    row = np.zeros((len(a), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        same = (y == x[:, i : i + 1]) & real & (i < n)[:, None]
        np.maximum(row[:, 1:], row[:, :-1] + same, out=row[:, 1:])
        np.maximum.accumulate(row, axis=1, out=row)
    total = n + m
    return np.where(total > 0, 2 * row[:, -1] / np.maximum(total, 1), 1.0)


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler() of each pair."""
    return _in_groups(_jaro_winkler_group, a, b)


def token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    """token_set_ratio() of each pair."""
    words = {n: frozenset(n.split()) for n in {*a, *b}}
    out, one, two, of = np.zeros(len(a)), [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = words[p], words[q]
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 1.0
        elif x and y:
            base = sorted(both)
            left, right = (" ".join(base + sorted(s - both)) for s in (x, y))
            pairs = [(left, right)]
            if base:
                head = " ".join(base)
                pairs += [(head, left), (head, right)]
            for s, t in pairs:
                one.append(s)
                two.append(t)
                of.append(i)
    if of:
        np.maximum.at(out, np.array(of), _in_groups(_indel_group, one, two))
    return out


def _distinct(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """The batch's distinct pairs, and which of them each row has."""
    pairs: dict[tuple[str, str], int] = {}
    of = np.array([pairs.setdefault((x or "", y or ""), len(pairs)) for x, y in zip(a, b, strict=True)], np.int64)
    return [p[0] for p in pairs], [p[1] for p in pairs], of


@F.pandas_udf(T.DoubleType())
def _fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right, of = _distinct(a, b)
    score = np.maximum(jaro_winkler_many(left, right), token_set_many(left, right))
    given = np.array([bool(x) and bool(y) for x, y in zip(left, right, strict=True)], bool)
    return pd.Series(np.where(given, score, 0.0)[of], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right, of = _distinct(a, b)
    return pd.Series(jaro_winkler_many(left, right)[of], dtype="float64")


def fuzzy(a: Column, b: Column) -> Column:
    """The larger of Jaro-Winkler and token-set ratio over normal forms; 0 where either is empty."""
    return _fuzzy(a, b)
