"""Special functions that Spark SQL lacks, and small combinatorics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chisq_upper(x: float, dof: int) -> float:
    """P(X > x) for a chi-squared variable: NaN for dof <= 0, 1 for x <= 0; series below the mean, continued fraction above."""
    if dof <= 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    a, y = dof / 2, x / 2
    lead = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - total * lead)
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def two_sided_p(z: Column) -> Column:
    """P(|Z| > |z|) of a normal variable, null for null or NaN."""

    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))

    return p(z)


def unrank(rank: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-subsets of range(n) with these ranks in lexicographic order, one in each row."""
    out = np.zeros((len(rank), k), np.int64)
    left = rank.astype(np.int64).copy()
    low = np.zeros(len(rank), np.int64)
    for j in range(k):
        table = np.array([math.comb(n - 1 - v, k - 1 - j) for v in range(n)], np.int64)
        before = np.concatenate(([0], np.cumsum(table)))
        at = np.searchsorted(before, left + before[low], "right") - 1
        left -= before[at] - before[low]
        out[:, j] = at
        low = at + 1
    return out


def rounded(c: Column | str, digits: int = 8) -> Column:
    """Rounded, with NaN as null and no negative zero: how results are compared across engines (the small shift keeps exact halves from being rounded two ways)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(F.round(c + F.lit(1.7e-12), digits) + F.lit(0.0))
