"""One frame from many of the same shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def union_all(parts: Iterable[DataFrame | None]) -> DataFrame | None:
    """Union by name, pairwise: every step re-checks its whole plan, so a long chain is slow to
    build.  Missing parts are left out; None when there is no part at all."""
    left = [p for p in parts if p is not None]
    while len(left) > 1:
        pairs = zip(left[::2], left[1::2], strict=False)
        odd = left[-1:] if len(left) % 2 else []
        left = [a.unionByName(b) for a, b in pairs] + odd
    return left[0] if left else None
