"""Longest common subsequences of two token lists: paths, contiguity, similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

RESULT = "que array<string>, loc1 array<int>, loc2 array<int>"


def length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a fold over a of rows of the table, each a fold over b."""
    n = F.size(b)

    def row(prev: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.get(b, j - 1) == x, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(acc, j - 1))))),
        )

    return F.when(n > 0, F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), n + 1), row), -1)).otherwise(0)


def lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of all beginnings of both, a row at a time."""
    number = {x: k for k, x in enumerate(dict.fromkeys(b))}
    right = np.array([number[x] for x in b], int)
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        best[i, 1:] = np.maximum.accumulate(np.where(right == number.get(x, -1), best[i - 1, :-1] + 1, best[i - 1, 1:]))
    return best


def table_path(a: list, b: list) -> tuple[list, list, list]:
    """One longest common subsequence with its 0-based places; backtracking steps left only where that is strictly better, otherwise up."""
    best = lengths(a, b)
    i, j, path = len(a), len(b), []
    while best[i, j]:
        if a[i - 1] == b[j - 1]:
            path.append((a[i - 1], i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j - 1] > best[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return tuple([p[k] for p in reversed(path)] for k in range(3))


def contiguous(que: list, one: list, two: list, mode: str = "both") -> tuple[list, list, list]:
    """Points with a neighbour at distance 1: in both lists (`both`) or in either (`any`)."""
    pick = max if mode == "both" else min
    gap = [pick(one[k + 1] - one[k], two[k + 1] - two[k]) for k in range(len(one) - 1)]
    keep = [k for k in range(len(one)) if (k > 0 and gap[k - 1] == 1) or (k < len(gap) and gap[k] == 1)]
    return [que[k] for k in keep], [one[k] for k in keep], [two[k] for k in keep]


def mean_gap(one: list, two: list) -> float:
    """Mean distance of neighbours over both lists; NaN below two points."""
    gaps = [y - x for loc in (one, two) for x, y in zip(loc, loc[1:], strict=False)]
    return sum(gaps) / len(gaps) if gaps else float("nan")


def unique(a: list, b: list, keep: bool = True, mode: str = "both") -> tuple[list, list, list]:
    """The same subsequence in either order of the arguments: of both orders' candidates the more contiguous one; the second also wins where a mean gap is NaN."""
    q1, x1, y1 = table_path(a, b)
    q2, y2, x2 = table_path(b, a)
    if keep:
        q1, x1, y1 = contiguous(q1, x1, y1, mode)
        q2, x2, y2 = contiguous(q2, x2, y2, mode)
    if q1 == q2 or mean_gap(x1, y1) <= mean_gap(x2, y2):
        return q1, x1, y1
    return q2, x2, y2


def peeled(a: list, b: list) -> list[tuple[str, list, list]]:
    """One result for each deepest cell of the co-occurrence matrix, in row-major order; each path takes, depth by depth, the first cell strictly below and right of its end."""
    after = lengths(a[::-1], b[::-1])[::-1, ::-1]  # of the ends from each place on
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    level: dict = {}
    for i, x in enumerate(a):
        for j in places.get(x, []):
            level.setdefault(1 + int(after[i + 1, j + 1]), []).append((i, j))
    top = max(level, default=0)
    out = []
    for root in level.get(top, []):
        path = [root]
        for d in range(top - 1, 0, -1):
            path.append(next(c for c in level[d] if c[0] > path[-1][0] and c[1] > path[-1][1]))
        out.append(("".join(a[i] for i, _ in path), [i for i, _ in path], [j for _, j in path]))
    return out


def _udf(f, kind: str):
    @pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)], columns=["que", "loc1", "loc2"])

    return run


def path(a: Column, b: Column) -> Column:
    return _udf(table_path, RESULT)(a, b)


def unique_path(a: Column, b: Column, keep: bool = True, mode: str = "both") -> Column:
    return _udf(lambda x, y: unique(x, y, keep, mode), RESULT)(a, b)


def peeled_paths(a: Column, b: Column) -> Column:
    """Array of structs (text, loc1, loc2)."""

    @pandas_udf("array<struct<text:string,loc1:array<int>,loc2:array<int>>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "loc1": i, "loc2": j} for t, i, j in peeled(list(p) if p is not None else [], list(q) if q is not None else [])] for p, q in zip(x, y, strict=True)])

    return run(a, b)


def keep_points(one: Column, two: Column, mode: str = "both") -> Column:
    """Indexes (0-based) of the points that contiguous() keeps, as a column."""
    pick = F.greatest if mode == "both" else F.least
    gap = lambda k: pick(F.get(one, k + 1) - F.get(one, k), F.get(two, k + 1) - F.get(two, k))
    all_k = F.when(F.size(one) > 0, F.sequence(F.lit(0), F.size(one) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(all_k, lambda k: F.coalesce((k > 0) & (gap(k - 1) == 1), F.lit(False)) | F.coalesce((k < F.size(one) - 1) & (gap(k) == 1), F.lit(False)))


def gap_mean(one: Column, two: Column) -> Column:
    """mean_gap() as a column; null below two points. The sum of a list's gaps is its last place less its first."""
    total = F.element_at(one, -1) - F.get(one, F.lit(0)) + F.element_at(two, -1) - F.get(two, F.lit(0))
    return F.when(F.size(one) > 1, total / (2.0 * (F.size(one) - 1)))


def first_wins(mean1: Column, mean2: Column) -> Column:
    """Whether the first candidate is at least as contiguous; false where a mean is missing."""
    return F.coalesce(mean1 <= mean2, F.lit(False))


def distance(len1: Column, len2: Column, loc1: Column, loc2: Column, credible: int = 10) -> Column:
    """Similarity that weighs early places more, reduced if too few points agree: no points give 0."""
    weight = lambda n: n * (n + 1) / 2.0
    share = lambda n, loc: F.aggregate(loc, F.lit(0.0), lambda s, x: s + (n - x)) / weight(n)
    n = F.size(loc1)
    need, half = F.ceil(F.least(len1, len2) * 0.75), F.ceil(F.greatest(len1, len2) * 0.5)
    decay = F.when((n >= need) & ((n >= half) | (n >= credible)), 1.0).otherwise(n / F.greatest(need, half))
    return F.when(n > 0, F.greatest(share(len1, loc1), share(len2, loc2)) * decay).otherwise(0.0)
