"""String similarity kernels as Arrow UDFs: normalised LCS ratio and its partial, sorted-token and token-set forms, and the matching-blocks ratio.

They are for candidate pairs only: a join comes first, the kernel after it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


#: Signs whose places are put in bit rows together: rows grow with the text, so they aren't changed once a sign.
PLACED = 512


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-wide bit row per character of the shorter one. Equal beginnings and ends are part of one."""
    if len(a) < len(b):
        a, b = b, a
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(b))
    a, b = a[: len(a) - end], b[: len(b) - end]
    masks: dict[str, int] = {}
    for at in range(0, len(a), PLACED):
        part: dict[str, int] = {}
        for i, c in enumerate(a[at : at + PLACED]):
            part[c] = part.get(c, 0) | (1 << i)
        for c, bits in part.items():
            masks[c] = masks.get(c, 0) | (bits << at)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if c in masks:
            hit = row & masks[c]
            row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 LCS / (len a + len b); two empty strings are 100."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(first, second), ratio(both, first) if both else 0.0, ratio(both, second) if both else 0.0)


def blocks_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def kernel(f):
    """A two-string function as a column function; null with a null is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run
