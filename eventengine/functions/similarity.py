"""Title similarity: the normalised insert/delete distance, and its token-set form. Arrow-batched; no Spark function has them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - d/(m+n)) with d the insert/delete distance; bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    if a == b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - row.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def title_ratio(a: str | None, b: str | None) -> float:
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    return indel_ratio(a, b) if a and b else 0.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best of the ratios between the common tokens and each side with its own tokens added; 100 on a subset."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    common, only_a, only_b = (" ".join(sorted(x)) for x in (left & right, left - right, right - left))
    if common and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (f"{common} {x}".strip() for x in (only_a, only_b))
    found = [indel_ratio(with_a, with_b)]
    if common:
        found += [indel_ratio(common, with_a), indel_ratio(common, with_b)]
    return max(found)


@pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_ratio(x, y) for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def token_set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])
