"""Similarities of strings that no built-in expresses; they take and give whole Arrow batches."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE, DOUBLES = T.DoubleType(), T.ArrayType(T.DoubleType())


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; the rows of the table are bits of one number."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words alone and shared words with either rest; a shared word with no rest on one side is 1."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_a and only_b):
        return 1.0
    join = lambda rest: " ".join(p for p in (both, rest) if p)
    found = [indel_ratio(join(only_a), join(only_b))]
    if both:
        found += [indel_ratio(both, join(only_a)), indel_ratio(both, join(only_b))]
    return max(found)


def guarded_ratio(a: str, b: str) -> float:
    """Ratio of two names without signs; 0 unless digits, words with digits and first letter agree and lengths differ by 4 at most."""
    a, b = re.sub(r"\W+", "", a), re.sub(r"\W+", "", b)
    if not a or not b or a[0] != b[0] or abs(len(a) - len(b)) > 4:
        return 0.0
    if re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return 0.0
    mixed = [{w for w in re.findall(r"[a-z]*\d+[a-z]*", x) if not w.isdigit()} for x in (a, b)]
    return indel_ratio(a, b) if mixed[0] == mixed[1] else 0.0


def _each(fn):
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return of


ratio = F.pandas_udf(_each(indel_ratio), DOUBLE)
token_set = F.pandas_udf(_each(token_set_ratio), DOUBLE)
matcher_ratio = F.pandas_udf(_each(lambda a, b: SequenceMatcher(None, a, b).ratio()), DOUBLE)


@F.pandas_udf(DOUBLES)
def best_guarded(parts: pd.Series, names: pd.Series) -> pd.Series:
    """For each part the best :func:`guarded_ratio` over all names."""
    return pd.Series([[max((guarded_ratio(p, n) for n in ns), default=0.0) for p in ps] for ps, ns in zip(parts, names, strict=True)])


@F.pandas_udf(DOUBLES)
def pair_ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of every left text with every right text, left by left."""
    return pd.Series([[SequenceMatcher(None, a, b).ratio() for a in xs for b in ys] for xs, ys in zip(left, right, strict=True)])
